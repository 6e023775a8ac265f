"""Registry of runnable queries and the bar tables they start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidebar.functions.scalars import rounded
from tidebar.operators.series import Series, chunked
from tidebar.plans import features as fx
from tidebar.session import staged
from tidebar.sources.bars import ticks_to_bars, with_market_cap

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and the SQL that gives the same rows where there is one."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# -- output columns -------------------------------------------------------------------------

Spec = dict[str, int | None]


def spec(text: str) -> Spec:
    """``"a b:6"``: column a as it is, column b rounded to 6 digits."""
    out: Spec = {}
    for item in text.split():
        name, _, digits = item.partition(":")
        out[name] = int(digits) if digits else None
    return out


# Both engines move a value by this much before rounding, so that exact halves, which
# they would round differently, fall on the same side.
NUDGE = "1.000000000001"


def emit(df: DataFrame, columns: Spec) -> DataFrame:
    def one(name: str, digits: int | None) -> Column:
        if digits is None:
            return F.col(name)
        return rounded(F.col(name) * F.lit(float(NUDGE)), digits).alias(name)

    return df.select(*[one(n, d) for n, d in columns.items()])


def emit_sql(columns: Spec, source: str) -> str:
    items = [
        n if d is None else f"round({n} * {NUDGE}::double, {d}) + 0.0 as {n}" for n, d in columns.items()
    ]
    return f"select {', '.join(items)} from {source}"


# -- bar tables ------------------------------------------------------------------------------


def event_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly bars, one asset per event type."""
    return ticks_to_bars(
        table(spark, sf, "events"),
        asset="event_type",
        ts="ts",
        price="value",
        volume="value",
        tiebreak="event_id",
    )


EVENT_BARS = """
bars as (
  select event_type as asset, date_trunc('hour', ts) as datetime,
         arg_max(value, ts) as price, round(sum(value), 6) as volume,
         max(value) as high, min(value) as low, arg_max(value, ts) * 1e6 as market_cap,
         row_number() over (partition by event_type order by date_trunc('hour', ts)) - 1 as rn
  from events group by 1, 2)"""


def daily_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars, one asset per return flag: long enough for 720-row frames."""
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    bars = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_returnflag").alias("asset"), F.col("l_shipdate").alias("datetime"))
        .agg(
            F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 6).alias("price"),
            F.sum("l_quantity").alias("volume"),
            F.max(unit).alias("high"),
            F.min(unit).alias("low"),
        )
    )
    return with_market_cap(bars)


DAILY_BARS = """
bars as (
  select l_returnflag as asset, l_shipdate as datetime,
         round(sum(l_extendedprice) / sum(l_quantity), 6) as price, sum(l_quantity) as volume,
         max(l_extendedprice / l_quantity) as high, min(l_extendedprice / l_quantity) as low,
         round(sum(l_extendedprice) / sum(l_quantity), 6) * 1e6 as market_cap,
         row_number() over (partition by l_returnflag order by l_shipdate) - 1 as rn
  from lineitem group by 1, 2)"""


def event_series(spark: SparkSession, sf: str, lead_rows: int = 0) -> Series:
    bars = staged(event_bars(spark, sf), "event-bars")
    return fx.pad_prices(chunked(bars, lead_rows=lead_rows))


def daily_series(spark: SparkSession, sf: str, lead_rows: int = 0) -> Series:
    bars = staged(daily_bars(spark, sf), "daily-bars")
    return fx.pad_prices(chunked(bars, lead_rows=lead_rows))


def daily_series_with_memory(spark: SparkSession, sf: str) -> Series:
    return fx.series_with_memory(staged(daily_bars(spark, sf), "daily-bars"))


# -- SQL building blocks for the oracles -------------------------------------------------------

BY_ASSET = "partition by asset order by rn"


def frame(k: int) -> str:
    return f"over ({BY_ASSET} rows between {k - 1} preceding and current row)"


def full(agg: str, counted: str, k: int) -> str:
    return f"case when count({counted}) {frame(k)} = {k} then {agg} {frame(k)} end"


def mean(x: str, k: int) -> str:
    return full(f"avg({x})", x, k)


def std(x: str, k: int) -> str:
    return full(f"stddev_samp({x})", x, k)


def total(x: str, k: int) -> str:
    return full(f"sum({x})", x, k)


def corr(a: str, b: str, k: int) -> str:
    pairs = f"count(case when {a} is not null and {b} is not null then 1 end) {frame(k)}"
    value = f"corr({a}, {b}) {frame(k)}"
    return f"case when {pairs} = {k} and not isnan({value}) then {value} end"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) over ({BY_ASSET})"


def lead(x: str, n: int = 1) -> str:
    return f"lead({x}, {n}) over ({BY_ASSET})"


def change(x: str, n: int = 1) -> str:
    return f"({x} / nullif({lag(x, n)}, 0) - 1)"


def flag_sql(condition: str) -> str:
    return f"cast(coalesce({condition}, false) as integer)"


def opposite_sql(a: str, b: str) -> str:
    return flag_sql(f"(({a}) > 0 and ({b}) < 0) or (({a}) < 0 and ({b}) > 0)")


def clip_sql(x: str, low: str, high: str) -> str:
    return f"case when ({x}) is not null then least(greatest({x}, {low}), {high}) end"


def last_known(x: str) -> str:
    return (
        f"last_value({x} ignore nulls) over ({BY_ASSET} rows between unbounded preceding and current row)"
    )


def rank_sql(x: str, k: int) -> str:
    """Average rank of the current row among its last k rows, over k."""
    frame_list = f"list({x}) {frame(k)}"
    less = f"len(list_filter({frame_list}, lambda v: v < {x}))"
    same = f"len(list_filter({frame_list}, lambda v: v = {x}))"
    return f"case when count({x}) {frame(k)} = {k} then ({less} + ({same} + 1) / 2.0) / {k}.0 end"


def ewm_adjusted(out: str, x: str, span: int, source: str = "bars") -> str:
    """A CTE (asset, rn, out): weights (1 - alpha) ** age, closed form."""
    a = f"(1 - 2.0::double / {span + 1})"
    return f"""{out}_t as (
  select t.asset, t.rn, sum(p.{x} * pow({a}, t.rn - p.rn)) / sum(pow({a}, t.rn - p.rn)) as {out}
  from {source} t join {source} p on p.asset = t.asset and p.rn <= t.rn and p.{x} is not null
  group by 1, 2)"""


def ewm_plain(out: str, x: str, alpha: str, first: int, source: str = "bars") -> str:
    """A CTE (asset, rn, out): the first value counts whole, later ones alpha."""
    return f"""{out}_t as (
  select t.asset, t.rn,
         sum(p.{x} * (case when p.rn = {first} then 1 else {alpha} end) * pow(1 - {alpha}, t.rn - p.rn)) as {out}
  from {source} t join {source} p on p.asset = t.asset and p.rn <= t.rn and p.{x} is not null
  group by 1, 2)"""
