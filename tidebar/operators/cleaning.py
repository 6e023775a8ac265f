"""Cleaning of wide feature tables. Missing values are NULL before and after."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidebar import settings
from tidebar.functions.scalars import finite
from tidebar.operators.series import Series

# Name parts that mark a column for the narrow cap.
RATIO_NAME_PARTS = ("_ratio", "_vs_", "divergence", "correlation")


def nullify_nonfinite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({n: finite(n) for n in columns})


def three_sigma(
    df: DataFrame,
    columns: Sequence[str],
    key: str = "asset",
    *,
    position: str = "_rn",
    deviations: float = 3.0,
    keep_flags: Sequence[str] = (),
    chunk_rows: int = settings.CHUNK_ROWS,
) -> DataFrame:
    """NULL for values more than three sample deviations from their series' mean.

    Faithful to the whole-series rule, so a rare 0/1 flag loses its ones; name columns
    in ``keep_flags`` to spare them. The statistics combine before the shuffle. They come
    back by (series, chunk), so a long series is not one join key.
    """
    columns = [n for n in columns if n not in set(keep_flags)]
    aggs: list[Column] = [F.max(position).alias("_last")]
    for n in columns:
        aggs += [F.avg(n).alias(f"_m_{n}"), F.stddev_samp(n).alias(f"_d_{n}")]
    stats = (
        df.groupBy(key)
        .agg(*aggs)
        .withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_last") / chunk_rows))))
        .drop("_last")
    )
    joined = df.withColumn("_part", F.floor(F.col(position) / chunk_rows)).join(stats, [key, "_part"])
    cleaned = {}
    for n in columns:
        spread = F.col(f"_d_{n}")
        outside = (spread > 0) & (F.abs(F.col(n) - F.col(f"_m_{n}")) > deviations * spread)
        cleaned[n] = F.when(~F.coalesce(outside, F.lit(False)), F.col(n))
    helpers = [h for n in columns for h in (f"_m_{n}", f"_d_{n}")]
    return joined.withColumns(cleaned).drop("_part", *helpers)


def cap_values(
    df: DataFrame, columns: Sequence[str], limit: float = 1e10, ratio_limit: float = 1000.0
) -> DataFrame:
    """NULL above a limit; the limit is narrow for ratios, divergences and correlations."""
    out = {}
    for n in columns:
        narrow = any(part in n for part in RATIO_NAME_PARTS)
        bound = min(limit, ratio_limit) if narrow else limit
        out[n] = F.when(F.abs(n) <= bound, F.col(n))
    return df.withColumns(out)


def fill_gaps(series: Series, columns: Sequence[str], causal: bool = False) -> Series:
    """Last known value, else the first known one (not if ``causal``), else zero."""
    filled = series.carry_forward({n: n for n in columns}, back_fill=not causal)
    return filled.with_columns({n: F.coalesce(F.col(n), F.lit(0)) for n in columns})


def audit(df: DataFrame, columns: Sequence[str], key: str = "asset") -> DataFrame:
    """Per series: how many cells are infinite or not a number, and how many missing."""
    nan = [F.sum(F.isnan(F.col(n).cast("double")).cast("long")) for n in columns]
    infinite = [
        F.sum((F.abs(F.col(n).cast("double")) == F.lit(float("inf"))).cast("long")) for n in columns
    ]
    missing = [F.sum(F.col(n).isNull().cast("long")) for n in columns]
    zero = F.lit(0).cast("long")
    add = lambda parts: sum((F.coalesce(p, zero) for p in parts), zero)
    return df.groupBy(key).agg(
        add(infinite).alias("infinite_cells"),
        (add(missing) + add(nan)).alias("missing_cells"),
    )


def training_rows(df: DataFrame, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Rows with known targets; missing features become 0, rows with huge values go."""
    known = df.dropna(subset=list(targets)).fillna(0, subset=list(features))
    cells = F.array(*[F.col(n).cast("double") for n in features])
    return known.where(F.forall(cells, lambda x: ~F.isnan(x) & (F.abs(x) <= 1e15)))
