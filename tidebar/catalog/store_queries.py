"""Sources, sinks, stored tables and whole flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar import settings
from tidebar.catalog.accuracy_queries import AS_OF_SQL, all_evaluations, as_of, naive_predictions, _PREDS
from tidebar.catalog.base import EVENT_BARS, emit, emit_sql, event_bars, query, spec, table
from tidebar.catalog.joined_queries import _CASES
from tidebar.plans import accuracy as acc
from tidebar.session import scratch_path, staged
from tidebar.sources.bars import one_bar_per_time, read_ohlc, ticks_to_bars
from tidebar.sources.landed import read_markets, read_observations_json, read_price_json, stack_markets
from tidebar.sources.tables import Store, write_json, write_lines

_BAR_OUT = spec("asset datetime price:6 volume:4 high:6 low:6 market_cap:2")


@query("bars_from_ticks", f"with {EVENT_BARS} {emit_sql(_BAR_OUT, 'bars')}")
def bars_from_ticks(spark, sf):
    return emit(event_bars(spark, sf), _BAR_OUT)


@query(
    "hot_ticks_to_daily_bars",
    """with b as (select case when event_id % 3 = 0 then 'hot' else cast(user_id as varchar) end as asset,
  date_trunc('day', ts) as datetime, arg_max(value, ts) as price, round(sum(value), 6) as volume from events group by 1, 2)
select asset, datetime, price, round(volume, 4) + 0.0 as volume from b""",
)
def hot_ticks_to_daily_bars(spark, sf):
    """One asset with a third of all ticks, and a few ticks for each user."""
    hot = F.when(F.col("event_id") % 3 == 0, "hot").otherwise(F.col("user_id").cast("string"))
    bars = ticks_to_bars(
        table(spark, sf, "events"), asset=hot, ts="ts", price="value", volume="value", tiebreak="event_id", unit="day"
    )
    return emit(bars, spec("asset datetime price volume:4"))


_JSON_OUT = spec("asset datetime price:6 market_cap:2 volume:4")


@query("landed_price_json", f"with {EVENT_BARS} {emit_sql(_JSON_OUT, 'bars')}")
def landed_price_json(spark, sf):
    """Bars landed as JSON, one document per asset and 30 days, and read back."""
    ms = F.timestamp_diff("MILLISECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col("datetime"))
    month = F.floor(ms / (30 * 86_400_000))
    items = F.array_sort(F.collect_list(F.struct(ms.alias("ms"), "price", "market_cap", "volume")))
    # At most 720 hourly bars per document.
    docs = event_bars(spark, sf).groupBy("asset", month.alias("_month")).agg(items.alias("_items"))
    pairs = lambda n: F.transform("_items", lambda i: F.array(i["ms"].cast("double"), i[n]))
    path = scratch_path(spark, "price-json")
    docs.select(
        "asset", pairs("price").alias("prices"), pairs("market_cap").alias("market_caps"), pairs("volume").alias("total_volumes")
    ).write.partitionBy("asset").json(path)
    return emit(read_price_json(spark, path), _JSON_OUT)


@query(
    "landed_observation_json",
    """select date_trunc('month', o_orderdate) as datetime, o_orderpriority as indicator,
  round(avg(o_totalprice) * 1.000000000001::double, 3) + 0.0 as value from orders
where month(o_orderdate) <> 6 group by 1, 2""",
)
def landed_observation_json(spark, sf):
    """Monthly averages landed as JSON text; June has a value that is no number."""
    monthly = (
        table(spark, sf, "orders")
        .groupBy(F.col("o_orderpriority").alias("indicator"), F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("at"))
        .agg(F.avg("o_totalprice").alias("value"))
    )
    text = F.when(F.month("at") == 6, F.lit(".")).otherwise(F.col("value").cast("string"))
    item = F.struct(F.date_format("at", "yyyy-MM-dd").alias("date"), text.alias("value"))
    path = scratch_path(spark, "observations")
    # One document per indicator and year: at most twelve values each.
    monthly.groupBy("indicator", F.year("at").alias("_year")).agg(F.collect_list(item).alias("observations")).drop(
        "_year"
    ).write.partitionBy("indicator").json(path)
    return emit(read_observations_json(spark, path), spec("datetime indicator value:3"))


@query(
    "landed_ohlc_table",
    """with b as (select event_type as asset, date_trunc('hour', ts) as datetime, arg_max(value, ts) as price,
  round(sum(value), 6) as volume from events group by 1, 2)
select asset, datetime, price, round(volume, 4) + 0.0 as volume, round(price * 1e6 * 1.000000000001::double, 2) + 0.0 as market_cap from b""",
)
def landed_ohlc_table(spark, sf):
    path = scratch_path(spark, "ohlc")
    event_bars(spark, sf).select(
        "asset", F.col("datetime").alias("Datetime"), F.col("price").alias("Close"), F.col("volume").alias("Volume")
    ).write.parquet(path)
    return emit(read_ohlc(spark.read.parquet(path)), spec("asset datetime price volume:4 market_cap:2"))


_OHLC = """arg_min(value, ts) as Open, max(value) as High, min(value) as Low, arg_max(value, ts) as Close, round(sum(value), 4) as Volume"""


def _ohlc(spark, sf):
    symbol = F.element_at(
        F.array(*[F.lit(s) for s in settings.MARKET_SYMBOLS]), (F.col("user_id") % 8 + 1).cast("int")
    )
    return (
        table(spark, sf, "events")
        .groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("datetime"), symbol.alias("symbol"))
        .agg(
            F.min_by("value", "ts").alias("Open"), F.max("value").alias("High"), F.min("value").alias("Low"),
            F.max_by("value", "ts").alias("Close"), F.round(F.sum("value"), 4).alias("Volume"),
        )
    )


_OHLC_OUT = spec("datetime symbol Open High Low Close Volume")
_OHLC_SQL = f"""select date_trunc('hour', ts) as datetime, case user_id % 8 {_CASES} end as symbol, {_OHLC}
from events group by 1, 2"""


@query("market_tables_by_symbol", _OHLC_SQL)
def market_tables_by_symbol(spark, sf):
    """Market bars kept in one folder per symbol, read in one scan."""
    path = scratch_path(spark, "markets")
    _ohlc(spark, sf).write.partitionBy("symbol").parquet(path)
    return read_markets(spark, path)


@query("market_tables_stacked", _OHLC_SQL)
def market_tables_stacked(spark, sf):
    rows = staged(_ohlc(spark, sf), "ohlc")
    return stack_markets({s: rows.where(F.col("symbol") == s).drop("symbol") for s in settings.MARKET_SYMBOLS})


@query(
    "one_bar_per_time",
    """select event_type as asset, date_trunc('hour', ts) as datetime, arg_max(value, event_id) as price, max(event_id) as version
from events group by 1, 2""",
)
def one_bar_per_time_query(spark, sf):
    versions = table(spark, sf, "events").select(
        F.col("event_type").alias("asset"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("datetime"),
        F.col("value").alias("price"), F.col("event_id").alias("version"),
    )
    return one_bar_per_time(versions, "version")


# -- stored tables -------------------------------------------------------------------------------------


def _store(spark):
    return Store(spark, scratch_path(spark, "store")).ensure()


@query(
    "stored_predictions",
    f"with {_PREDS} {emit_sql(spec('prediction_id asset horizon predicted_price:6 confidence:6 target_timestamp created_at'), 'predictions')}",
)
def stored_predictions(spark, sf):
    """Predictions appended in two rounds."""
    store, rows = _store(spark), naive_predictions(spark, sf)
    for first in (True, False):
        store.append("predictions", rows.where((F.hour("created_at") < 12) == F.lit(first)))
    out = spec("prediction_id asset horizon predicted_price:6 confidence:6 target_timestamp created_at")
    return emit(store.read("predictions"), out)


@query(
    "stored_actual_prices",
    f"""with {EVENT_BARS} select asset, datetime as target_timestamp,
  round(case when hour(datetime) % 3 = 0 then price * 2 else price end, 6) + 0.0 as actual_price from bars""",
)
def stored_actual_prices(spark, sf):
    """Prices upserted twice; the second round replaces every third hour."""
    store = _store(spark)
    rows = event_bars(spark, sf).select("asset", F.col("datetime").alias("target_timestamp"), F.col("price").alias("actual_price"))
    store.upsert("actual_prices", rows)
    again = rows.where(F.hour("target_timestamp") % 3 == 0)
    store.upsert("actual_prices", again.withColumn("actual_price", F.col("actual_price") * 2))
    return emit(store.read("actual_prices"), spec("asset target_timestamp actual_price:6"))


@query(
    "cleared_predictions",
    f"""with {_PREDS} select 'predictions' as table_name, (select count(*) from predictions) as rows_before, 0::bigint as rows_after
union all select 'bars', (select count(*) from bars), (select count(*) from bars)
union all select t, 0, 0 from (values ('evaluations'), ('actual_prices'), ('accuracy_summary'), ('timeseries'), ('markets'), ('economic')) v(t)""",
)
def cleared_predictions(spark, sf):
    store = _store(spark)
    store.append("predictions", naive_predictions(spark, sf))
    store.append("bars", event_bars(spark, sf))
    return store.clear_predictions(confirm=True)


@query("results_as_json", "select event_type as asset, count(*) as n, max(value) as top from events group by 1")
def results_as_json(spark, sf):
    path = scratch_path(spark, "results")
    rows = table(spark, sf, "events").groupBy(F.col("event_type").alias("asset")).agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("top")
    )
    write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("report_as_text")
def report_as_text(spark, sf):
    """The accuracy report written as text lines and read back."""
    path = scratch_path(spark, "report")
    done = all_evaluations(spark, sf)
    write_lines(acc.report(acc.accuracy_metrics(acc.since(done, as_of(), 30)), event_bars(spark, sf)), path)
    return spark.read.text(path)


@query(
    "series_lookback_from_store",
    f"""with {EVENT_BARS} select asset, count(*) as bars from bars where datetime >= {AS_OF_SQL} - interval 3 day
  and datetime <= {AS_OF_SQL} group by 1""",
)
def series_lookback_from_store(spark, sf):
    store = _store(spark)
    store.append("bars", event_bars(spark, sf))
    return store.lookback("bars", as_of(), 3).groupBy("asset").agg(F.count(F.lit(1)).alias("bars"))
