"""Ticks to bars, and readers for landed bar tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidebar.functions.clock import to_utc
from tidebar.functions.scalars import ColumnOrName, c


def ticks_to_bars(
    ticks: DataFrame,
    *,
    asset: ColumnOrName,
    ts: str,
    price: ColumnOrName,
    volume: ColumnOrName,
    tiebreak: ColumnOrName,
    unit: str = "hour",
    volume_digits: int | None = 6,
) -> DataFrame:
    """One bar per asset and hour (or day): last price, summed volume, high and low.

    Every aggregate combines before the shuffle, so an asset with most of the ticks
    sends at most one row per task and hour.
    """
    ticks = to_utc(ticks, ts)
    price, total = c(price), F.sum(c(volume))
    bars = ticks.groupBy(c(asset).alias("asset"), F.date_trunc(unit, ts).cast("timestamp_ntz").alias("datetime")).agg(
        F.max_by(price, F.struct(F.col(ts), c(tiebreak))).alias("price"),
        (total if volume_digits is None else F.round(total, volume_digits)).alias("volume"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
    )
    return with_market_cap(bars)


def with_market_cap(bars: DataFrame, factor: float = 1e6) -> DataFrame:
    """The stand-in market cap that bar tables without one get."""
    return bars.withColumn("market_cap", F.col("price") * F.lit(factor))


def read_ohlc(table: DataFrame, asset: ColumnOrName = "asset") -> DataFrame:
    """A landed table with Datetime, Close, Volume (any case) as bars."""
    named = {f.name.lower(): f.name for f in table.schema.fields}
    columns: list[Column] = [
        c(asset).alias("asset"),
        F.col(named["datetime"]).alias("datetime"),
        F.col(named["close"]).cast("double").alias("price"),
        F.col(named["volume"]).cast("double").alias("volume"),
    ]
    columns += [F.col(named[n]).cast("double").alias(n) for n in ("high", "low") if n in named]
    return with_market_cap(to_utc(table.select(*columns), "datetime"))


def lookback(df: DataFrame, as_of: Column, days: int, ts: str = "datetime") -> DataFrame:
    """Rows of the last ``days`` days before ``as_of``; the filter reaches the scan."""
    start = as_of - F.expr(f"INTERVAL '{days}' DAY")
    return df.where((F.col(ts) >= start) & (F.col(ts) <= as_of))


def one_bar_per_time(bars: DataFrame, version: ColumnOrName) -> DataFrame:
    """Keep the newest version of each (asset, datetime)."""
    others = [n for n in bars.columns if n not in ("asset", "datetime")]
    best = F.max_by(F.struct(*others), c(version)).alias("_r")
    return bars.groupBy("asset", "datetime").agg(best).select("asset", "datetime", "_r.*")


def latest_price(bars: DataFrame, ts: str = "datetime") -> DataFrame:
    """The newest price of each asset."""
    return bars.groupBy("asset").agg(
        F.max_by("price", ts).alias("price"), F.max(ts).alias(ts)
    )
