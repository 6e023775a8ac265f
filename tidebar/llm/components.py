"""Connected components of a link table by contraction.

Each round every component takes its smallest neighbour's label where that is smaller,
chains of labels are shortened until they end, and links are rewritten between the labels
that are left; links inside a component disappear. A hub's links are reduced to one row
before each shuffle. Tables of a round are written to the shared folder, so a lost executor
costs files read again, not earlier rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidebar.session import staged


def _between(links: DataFrame) -> DataFrame:
    """Distinct links between different nodes, the larger first."""
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all nodes with a link; the label is the smallest node of the component."""
    links = staged(_between(links), "links")
    labels: DataFrame | None = None
    while not links.isEmpty():
        # the larger end may take the smaller's label, so labels only fall and can't go round
        hook = staged(links.groupBy("a").agg(F.min("b").alias("to")).withColumnRenamed("a", "node"), "hooks")
        while True:
            nxt = hook.select(F.col("node").alias("to"), F.col("to").alias("far"))
            jumped = staged(hook.join(nxt, "to", "left").select("node", F.coalesce("far", "to").alias("to"),
                                                               F.col("far").isNotNull().alias("moved")), "jumps")
            moved = not jumped.where("moved").isEmpty()
            hook = jumped.select("node", "to")
            if not moved:
                break
        if labels is None:
            ends = links.select(F.col("b").alias("node")).distinct().join(hook, "node", "left_anti")
            labels = hook.select("node", F.col("to").alias("label")).unionByName(ends.select("node", F.col("node").alias("label")))
        else:
            labels = labels.join(hook.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        labels = staged(labels, "labels")
        for end in ("a", "b"):
            links = links.join(hook.withColumnRenamed("node", end).withColumnRenamed("to", f"to_{end}"), end, "left") \
                .withColumn(end, F.coalesce(f"to_{end}", end)).drop(f"to_{end}")
        links = staged(_between(links), "links")
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("a").alias("label"))
    return labels
