"""Exact percentiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidebar.session import staged

SLICES = 64
SLICE_VALUES = 1_000_000  # a slice with more different values is cut again before it is sorted


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, fractions: Sequence[float], out: str = "percentiles",
    most: int = SLICE_VALUES,
) -> DataFrame:
    """Keys and an array of interpolated percentiles, one per fraction.

    The built-in exact ``percentile`` holds a whole group in one task. Here equal values
    are counted first, a sketch cuts each group into slices of similar size (a poor cut
    costs balance, never exactness), and the slice sizes say which slices hold the wanted
    ranks. Those with more than ``most`` different values are cut again in the same way, so
    what one task sorts does not grow with the group; only then the slices are sorted.
    """
    keys = list(keys)
    part = [*keys, "_part"]
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    rows = staged(counted.withColumn("_part", F.lit(0).cast("long")), "value-counts")
    parts, before = None, None
    while True:
        cuts = rows.groupBy(*part).agg(
            F.percentile_approx("_v", [i / SLICES for i in range(1, SLICES)], 1000).alias("_cuts"), F.sum("_c").alias("_n")
        )
        if parts is None:  # whole groups: the wanted ranks come from their sizes
            cuts = staged(cuts, "value-cuts")
            asked = [_ranks(float(q)) for q in dict.fromkeys(fractions)]
            parts = cuts.select(*part, F.lit(0).cast("long").alias("_start"), "_n", F.concat(*asked).alias("_wanted"))
        sliced = rows.join(cuts.drop("_n"), part).select(
            *part, "_v", "_c", F.size(F.filter("_cuts", lambda x: x < F.col("_v"))).alias("_slice")
        )
        sizes = sliced.groupBy(*part, "_slice").agg(F.sum("_c").alias("_size"), F.count(F.lit(1)).alias("_values"))
        earlier = Window.partitionBy(*part).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.withColumn("_earlier", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
        wanted = sizes.join(parts, part).withColumn("_start", F.col("_start") + F.col("_earlier"))
        held = F.filter("_wanted", lambda r: (r["_rank"] >= F.col("_start")) & (r["_rank"] < F.col("_start") + F.col("_size")))
        wanted = wanted.withColumn("_wanted", held).where(F.size("_wanted") > 0)
        wanted = staged(wanted.select(*part, "_slice", "_start", "_n", "_wanted", "_values"), "value-slices")
        largest = wanted.agg(F.max("_values")).first()[0] or 0
        if largest <= most or before is not None and largest >= before:
            break
        before, deeper = largest, F.col("_part") * SLICES + F.col("_slice")
        parts = wanted.withColumn("_part", deeper).drop("_slice", "_values")
        kept = sliced.join(wanted.select(*part, "_slice"), [*part, "_slice"], "left_semi")
        rows = staged(kept.withColumn("_part", deeper).drop("_slice"), "value-counts")
    in_slice = Window.partitionBy(*part, "_slice").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = sliced.join(wanted.drop("_values"), [*part, "_slice"]).withColumn(
        "_end", F.col("_start") + F.sum("_c").over(in_slice)
    )
    hits = placed.withColumn(
        "_hit",
        F.explode(
            F.filter(
                "_wanted",
                lambda r: (r["_rank"] >= F.col("_end") - F.col("_c")) & (r["_rank"] < F.col("_end")),
            )
        ),
    )
    ends = hits.groupBy(*keys, F.col("_hit._q").alias("_q")).agg(
        F.min_by("_v", "_hit._rank").alias("_low"),
        F.max_by("_v", "_hit._rank").alias("_high"),
        F.max("_n").alias("_n"),
    )
    point = F.col("_q") * (F.col("_n") - 1)
    ends = ends.withColumn("_p", F.col("_low") + (F.col("_high") - F.col("_low")) * (point - F.floor(point)))
    found = ends.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_q", "_p"))).alias("_m"))
    return found.select(
        *keys, F.array(*[F.col("_m")[F.lit(float(q))] for q in fractions]).alias(out)
    )


def _ranks(q: float) -> Column:
    """The one or two ranks that a fraction of ``_n`` values lies between."""
    point = F.lit(q) * (F.col("_n") - 1)
    return F.transform(
        F.array_distinct(F.array(F.floor(point), F.ceil(point))), lambda r: F.struct(F.lit(q).alias("_q"), r.alias("_rank"))
    )
