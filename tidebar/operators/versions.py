"""Newest version per key, upserts, top rows and even samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidebar.operators.series import number_rows


def latest_per_key(df: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """One row per key: the one with the highest version. Combines before the shuffle,
    so any number of versions of one key is fine."""
    keys = list(keys)
    rest = [n for n in df.columns if n not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*version)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*df.columns)


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Insert or replace by key; at equal versions the change wins."""
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return latest_per_key(both, keys, [*version, "_new"]).drop("_new")


def top_rows(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def tail_rows(df: DataFrame, n: int, key: str = "asset", position: str = "_rn") -> DataFrame:
    """The last ``n`` rows of each numbered series."""
    last = df.groupBy(key).agg(F.max(position).alias("_last"))
    chunk = F.floor(F.col(position) / 16384)
    # By (series, chunk), so that a long series is not one join key.
    spans = last.withColumn(
        "_part",
        F.explode(
            F.sequence(
                F.floor(F.greatest(F.col("_last") - (n - 1), F.lit(0)) / 16384), F.floor(F.col("_last") / 16384)
            )
        ),
    )
    joined = df.withColumn("_part", chunk).join(spans, [key, "_part"])
    return joined.where(F.col(position) > F.col("_last") - n).drop("_last", "_part")


def last_rows_by_time(df: DataFrame, n: int, key: str = "asset", ts: str = "datetime") -> DataFrame:
    return tail_rows(number_rows(df, [key], ts), n, key).drop("_rn")


def last_row(df: DataFrame, key: str = "asset", ts: str = "datetime") -> DataFrame:
    """The newest row of each series."""
    return latest_per_key(df, [key], [ts])


def even_sample(df: DataFrame, keys: Sequence[str], order: str, runs: int) -> DataFrame:
    """Every k-th row per key, k = rows // runs, and at most ``runs`` of them.

    Meant for small tables such as the splits of a backtest.
    """
    by_key = Window.partitionBy(*keys)
    total = F.count(F.lit(1)).over(by_key)
    place = F.row_number().over(by_key.orderBy(order)) - 1
    step = F.greatest(F.floor(F.col("_total") / runs), F.lit(1))
    return (
        df.withColumns({"_total": total, "_place": place})
        .where((F.col("_place") % step == 0) & (F.floor(F.col("_place") / step) < runs))
        .drop("_total", "_place")
    )
