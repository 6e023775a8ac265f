"""One series next to another one."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidebar.operators.series import Series, chunked
from tidebar.session import staged


def join_other(
    features: DataFrame,
    pairs: DataFrame,
    columns: dict[str, str],
    lead_rows: int = 0,
) -> Series:
    """Each row of ``features`` with the other series' columns at the same time.

    ``pairs`` (asset, other_asset) lists which series meet, so the work grows with the
    listed pairs only. Columns come as ``other_<name>`` and are carried over times at
    which the other series has no row. The result is a series per pair.
    """
    names = [f"other_{n}" for n in columns]
    # Written, so that its size is known and decides whether it is broadcast.
    pairs = staged(pairs.select("asset", "other_asset").distinct(), "pairs")
    other = features.select(
        F.col("asset").alias("other_asset"),
        "datetime",
        *[F.col(source).alias(f"other_{n}") for n, source in columns.items()],
    )
    joined = features.join(pairs, "asset").join(other, ["other_asset", "datetime"], "left")
    rows = staged(joined, "pair-rows")
    series = chunked(rows, keys=("asset", "other_asset"), lead_rows=lead_rows)
    return series.carry_forward({n: n for n in names})


def named_for_pair(df: DataFrame, asset: str, other: str) -> DataFrame:
    """Columns named after one pair: ``corr_other_24h`` becomes ``corr_<other>_24h``."""
    fixed = {"price_other_ratio": f"{asset}_{other}_ratio"}
    fixed |= {n: n.replace("to_other", f"{asset}_to_{other}") for n in df.columns if n.startswith("to_other_")}
    renamed = {n: fixed.get(n, n.replace("other", other)) for n in df.columns if n != "other_asset"}
    rows = df.where((F.col("asset") == asset) & (F.col("other_asset") == other))
    return rows.drop("other_asset").withColumnsRenamed(renamed)
