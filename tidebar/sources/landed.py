"""Readers for landed files: price arrays, economic observations, market tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidebar.functions.clock import to_utc

PRICE_JSON = (
    "prices array<array<double>>, market_caps array<array<double>>, total_volumes array<array<double>>, "
    "asset string"
)
OBSERVATION_JSON = "observations array<struct<date: string, value: string>>, indicator string"


def read_price_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Files below ``path/asset=<name>/`` with three parallel arrays of [ms, value]."""
    docs = spark.read.schema(PRICE_JSON).option("multiLine", multi_line).json(path)
    zipped = F.inline(F.arrays_zip("prices", "market_caps", "total_volumes"))
    rows = docs.select("asset", zipped)
    at = F.timestamp_millis(F.col("prices")[0].cast("long"))
    bars = rows.select(
        "asset",
        at.alias("datetime"),
        F.col("prices")[1].alias("price"),
        F.col("market_caps")[1].alias("market_cap"),
        F.col("total_volumes")[1].alias("volume"),
    )
    return to_utc(bars, "datetime")


def read_observations_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Files below ``path/indicator=<name>/``; values that are no numbers are dropped."""
    docs = spark.read.schema(OBSERVATION_JSON).option("multiLine", multi_line).json(path)
    rows = docs.select("indicator", F.inline("observations"))
    return rows.select(
        F.to_timestamp_ntz("date").alias("datetime"),
        "indicator",
        F.expr("try_cast(value AS double)").alias("value"),
    ).dropna(subset=["value"])


def stack_markets(tables: dict[str, DataFrame]) -> DataFrame:
    """One long table from a table per symbol."""
    out = None
    for symbol, one in tables.items():
        part = to_utc(one, "datetime").select(
            "datetime", F.lit(symbol).alias("symbol"), "Open", "High", "Low", "Close", "Volume"
        )
        out = part if out is None else out.unionByName(part)
    return out


def read_markets(spark: SparkSession, path: str) -> DataFrame:
    """A table partitioned by symbol, read in one scan."""
    return to_utc(spark.read.parquet(path), "datetime").select(
        "datetime", "symbol", "Open", "High", "Low", "Close", "Volume"
    )
