"""Streaming jobs, replayed over the whole tables until nothing is left."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidebar.catalog.accuracy_queries import _PREDS, naive_predictions
from tidebar.catalog.base import EVENT_BARS, ORACLES, change, emit, emit_sql, event_bars, mean, query, spec
from tidebar.catalog.learning_queries import AT, FEATURES, ONE, PRED_OUT, event_features
from tidebar.functions.clock import moment, to_utc
from tidebar.plans import features as fx, linear, model_store
from tidebar.session import scratch_path, staged
from tidebar.sources.tables import Store
from tidebar.streaming import jobs

_TICKS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def stream_ticks(spark, sf):
    return spark.readStream.schema(_TICKS).option("pathGlobFilter", "events.parquet").parquet(sf)


def stream_bars(spark, sf):
    return jobs.hourly_bars(
        stream_ticks(spark, sf), asset="event_type", ts="ts", price="value", volume="value", tiebreak="event_id"
    )


def as_stream(df, name, files=4):
    """A written table, read as a stream of a few files at a time."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(path)


def in_order(df, arrival, name, bounds, files=2):
    """A table that arrives as one micro-batch per time range of the column ``arrival``, which is
    not passed on: range after range is written, and a stream takes files in that order."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    rows, schema = staged(df, f"{name}-rows"), df.drop(arrival).schema
    for first, last in zip(bounds, bounds[1:]):
        part = rows.where((F.col(arrival) >= F.lit(first)) & (F.col(arrival) < F.lit(last))).drop(arrival)
        part.repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def time_ranges(df, ts, n):
    """The ends of n time ranges of one length that hold all rows (two values go to the driver)."""
    first, last = df.agg(F.min(ts), F.max(ts)).first()
    step = (last - first) / n
    return [*[first + i * step for i in range(n)], last + dt.timedelta(microseconds=1)]


def landed(writer, spark, schema):
    """Run the stream to its end into parquet files and read them."""
    path = scratch_path(spark, "stream-out")
    jobs.run_available(writer.format("parquet").option("path", path), scratch_path(spark, "stream-state"))
    return spark.read.schema(schema).parquet(path)


_OUT = spec("asset datetime price:6 volume:4 high:6 low:6 market_cap:2")


@query(
    "streamed_hourly_bars",
    f"""with {EVENT_BARS}, closed as (select * from bars where datetime + interval 1 hour <=
  (select max(ts) from events) - interval 10 minute) {emit_sql(_OUT, 'closed')}""",
)
def streamed_hourly_bars(spark, sf):
    bars = stream_bars(spark, sf)
    return emit(landed(bars.writeStream.outputMode("append"), spark, bars.schema), _OUT)


_FEAT_OUT = spec("asset datetime sma_7:6 sma_30:6 momentum_24h:5 velocity_3h:6")


@query(
    "streamed_features",
    f"""with {EVENT_BARS}, closed as (select * from bars where datetime + interval 1 hour <=
  (select max(ts) from events) - interval 10 minute),
f as (select *, {mean('price', 7)} as sma_7, {mean('price', 30)} as sma_30, {change('price', 24)} * 100 as momentum_24h,
  price - lag(price, 3) over (partition by asset order by rn) as velocity_3h from closed) {emit_sql(_FEAT_OUT, 'f')}""",
)
def streamed_features(spark, sf):
    """Ticks to bars to features, per micro-batch, with the stored bars as history."""
    store, sink = scratch_path(spark, "bar-store"), scratch_path(spark, "feature-store")
    job = jobs.features_job(store, sink, lambda s: fx.add_momentum(fx.add_moving_averages(s)))
    jobs.run_available(
        stream_bars(spark, sf).writeStream.outputMode("append").foreachBatch(job), scratch_path(spark, "stream-state")
    )
    return emit(spark.read.option("basePath", sink).parquet(sink), _FEAT_OUT)


@query("streamed_scores", ORACLES["trained_model_predictions"])
def streamed_scores(spark, sf):
    """Feature rows as a stream of five micro-batches, scored from the model registry."""
    rows, sink = event_features(spark, sf), scratch_path(spark, "scores")
    store = Store(spark, scratch_path(spark, "model-store")).ensure()
    model_store.register(store, *linear.train(rows, FEATURES, ["1h"], ONE), FEATURES, moment(AT))
    stream = as_stream(rows, "feature-stream", files=10)
    writer = stream.writeStream.foreachBatch(jobs.scoring_job(staged(model_store.usable(store), "usable"), sink, only_last=False))
    jobs.run_available(writer, scratch_path(spark, "stream-state"))
    return emit(spark.read.option("basePath", sink).parquet(sink).drop("batch"), PRED_OUT)


_MATCH_OUT = spec("prediction_id asset horizon target_timestamp predicted_price:6 actual_price:6")


@query(
    "streamed_matches",
    f"""with {_PREDS}, m as (select p.*, b.price as actual_price from predictions p
  join bars b on b.asset = p.asset and b.datetime = p.target_timestamp) {emit_sql(_MATCH_OUT, 'm')}""",
)
def streamed_matches(spark, sf):
    """Predictions and prices as two streams, in the order of time and six micro-batches, joined
    around the target time."""
    made = naive_predictions(spark, sf).withColumn("_arrives", F.col("created_at"))
    prices = staged(event_bars(spark, sf).select("asset", "datetime", "price", F.col("datetime").alias("_arrives")), "prices")
    ranges = time_ranges(prices, "_arrives", 6)
    matched = jobs.match_predictions(
        in_order(made, "_arrives", "prediction-stream", ranges), in_order(prices, "_arrives", "price-stream", ranges))
    rows = landed(matched.writeStream.outputMode("append"), spark, matched.schema)
    nearest = jobs.nearest_match(rows)
    return emit(to_utc(nearest, "target_timestamp"), _MATCH_OUT)


@query(
    "streamed_matches_once",
    f"""with {_PREDS} select count(*) as matches, count(distinct prediction_id) as predictions from predictions p
  join bars b on b.asset = p.asset and b.datetime = p.target_timestamp""",
)
def streamed_matches_once(spark, sf):
    """Every prediction arrives twice, the second time one micro-batch later, and is kept once."""
    made = naive_predictions(spark, sf).withColumn("_arrives", F.col("created_at"))
    prices = staged(event_bars(spark, sf).select("asset", "datetime", "price", F.col("datetime").alias("_arrives")), "prices")
    ranges = time_ranges(prices, "_arrives", 6)
    later = int((ranges[1] - ranges[0]).total_seconds())
    again = made.withColumn("_arrives", F.col("_arrives") + F.expr(f"INTERVAL '{later}' SECOND"))
    twice = in_order(made.unionByName(again), "_arrives", "prediction-stream", ranges)
    once = jobs.match_predictions(twice, in_order(prices, "_arrives", "price-stream", ranges))
    rows = landed(once.writeStream.outputMode("append"), spark, once.schema)
    return rows.agg(F.count(F.lit(1)).alias("matches"), F.count_distinct("prediction_id").alias("predictions"))


@query(
    "streamed_upserts",
    f"with {EVENT_BARS} select asset, datetime as target_timestamp, round(price, 6) + 0.0 as actual_price from bars",
)
def streamed_upserts(spark, sf):
    """Prices arrive twice in micro-batches; the table keeps one row per key."""
    rows = event_bars(spark, sf).select("asset", F.col("datetime").alias("target_timestamp"), F.col("price").alias("actual_price"))
    store = Store(spark, scratch_path(spark, "store")).ensure()
    stream = as_stream(rows.unionByName(rows), "price-stream")
    writer = stream.writeStream.foreachBatch(jobs.upsert_job(store, "actual_prices"))
    jobs.run_available(writer, scratch_path(spark, "stream-state"))
    return emit(store.read("actual_prices"), spec("asset target_timestamp actual_price:6"))
