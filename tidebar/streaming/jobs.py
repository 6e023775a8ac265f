"""Streaming forms of the batch jobs.

Bars are windowed aggregates with a watermark: ticks later than the watermark are
dropped, and a batch run over the tick table corrects such bars. Features, scores and
upserts run per micro-batch with the batch code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tidebar import settings
from tidebar.functions.scalars import ColumnOrName, c
from tidebar.operators.series import Series, chunked, number_rows
from tidebar.operators.versions import latest_per_key
from tidebar.plans import features as fx, learning, model_store
from tidebar.session import scratch_scope
from tidebar.sources.bars import with_market_cap
from tidebar.sources.tables import Store


def as_zoned(df: DataFrame, *names: str) -> DataFrame:
    """Watermarks need zoned timestamps: the wall-clock values as session time."""
    return df.withColumns({n: F.col(n).cast("timestamp") for n in names})


def hourly_bars(
    ticks: DataFrame, *, asset: ColumnOrName, ts: str, price: ColumnOrName, volume: ColumnOrName,
    tiebreak: ColumnOrName, delay: str = "10 minutes",
) -> DataFrame:
    """Ticks to closed hourly bars (append mode)."""
    hour = F.window(F.col(ts), "1 hour")
    bars = (
        as_zoned(ticks, ts)
        .withWatermark(ts, delay)
        .groupBy(c(asset).alias("asset"), hour.alias("_hour"))
        .agg(
            F.max_by(c(price), F.struct(F.col(ts), c(tiebreak))).alias("price"),
            F.round(F.sum(c(volume)), 6).alias("volume"),
            F.max(c(price)).alias("high"),
            F.min(c(price)).alias("low"),
        )
    )
    start = F.col("_hour.start").cast("timestamp_ntz").alias("datetime")
    return with_market_cap(bars.select("asset", start, "price", "volume", "high", "low"))


def recent_features(
    batch: DataFrame, history: DataFrame, add: Callable[[Series], Series], lookback_rows: int = settings.HALO_ROWS, memory: bool = False
) -> DataFrame:
    """Features of the new bars, from them and the stored bars of the same series.

    Only series with new bars are read, and of them the last ``lookback_rows`` rows, which
    hold every frame that a chunk's halo holds, whatever gaps the series has. Features with
    unlimited memory (running sums, carried levels) need ``memory``: all stored rows.
    """
    starts = batch.groupBy("asset").agg(F.min("datetime").alias("_first"))
    older = history.join(starts, "asset").where(F.col("datetime") < F.col("_first")).drop("_first")
    if not memory:
        numbered = number_rows(older, ["asset"])
        ends = numbered.groupBy("asset").agg(F.max("_rn").alias("_last"))
        older = numbered.join(ends, "asset").where(F.col("_rn") > F.col("_last") - lookback_rows).drop("_rn", "_last")
    new = batch.withColumn("_new", F.lit(True))
    rows = older.withColumn("_new", F.lit(False)).unionByName(new)
    series = fx.series_with_memory(rows) if memory else fx.pad_prices(chunked(rows))
    return add(series).rows().where("_new").drop("_new", "_price_pad", "_volume_pad", "_market_cap_pad")


def features_job(store_bars: str, sink: str, add: Callable[[Series], Series], memory: bool = False) -> Callable[[DataFrame, int], None]:
    """A micro-batch function: keep the bars, add the features of the new ones.

    Each batch owns one folder by its number, so a repeated batch replaces its own files.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{store_bars}/batch={number}")
        all_bars = spark.read.option("basePath", store_bars).parquet(store_bars)
        new = all_bars.where(F.col("batch") == number).drop("batch")
        history = all_bars.where(F.col("batch") < number).drop("batch")
        with scratch_scope(spark):
            recent_features(new, history, add, memory=memory).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return run


def scoring_job(
    models: dict[tuple[str, str], learning.Trained] | DataFrame, sink: str, only_last: bool = True
) -> Callable[[DataFrame, int], None]:
    """A micro-batch function: predictions for the newest feature row of each series (by rows of
    the model registry also for all rows), by fitted trees or by rows of the model registry."""

    def run(batch: DataFrame, number: int) -> None:
        if isinstance(models, DataFrame):
            made = model_store.predict(models, batch, only_last=only_last)
        else:
            made = learning.predict_all(models, batch)
        made.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return run


def upsert_job(store: Store, table: str, version: tuple[str, ...] = ()) -> Callable[[DataFrame, int], None]:
    """A micro-batch function: insert or replace by key. Repeating it changes nothing."""

    def run(batch: DataFrame, number: int) -> None:
        store.upsert(table, batch, version)

    return run


def match_predictions(
    predictions: DataFrame, prices: DataFrame, *, tolerance_minutes: int = 30, delay: str = "1 hour"
) -> DataFrame:
    """Predictions with the prices around their target time, both as streams.

    A prediction that arrives again within the watermark is dropped. An interval join on
    (series, time bucket), so the state of a busy series is spread by time over all tasks: a
    bucket is as wide as the interval, so the interval touches at most two, and a prediction
    goes to those; a price is in one, so each pair meets once. The watermark is the smaller
    one of both streams: a prediction waits until the prices have passed its target, however
    far its horizon reaches, and a price is late only against the prices before it.
    ``predictions``: target_timestamp; ``prices``: asset, datetime, price.
    """
    reach = tolerance_minutes * 60_000_000
    bucket = lambda at: F.floor(at / (2 * reach))
    left = as_zoned(predictions, "target_timestamp", "created_at").withWatermark("target_timestamp", delay)
    left = left.dropDuplicatesWithinWatermark(["prediction_id"])
    target = F.unix_micros("target_timestamp")
    # both ends lie outside of the interval
    ends = F.array_distinct(F.array(bucket(target - reach + 1), bucket(target + reach - 1)))
    left = left.withColumn("_bucket", F.explode(ends))
    right = as_zoned(
        prices.select(F.col("asset").alias("_asset"), "datetime", F.col("price").alias("actual_price")), "datetime"
    ).withWatermark("datetime", delay).withColumn("_price_bucket", bucket(F.unix_micros("datetime")))
    within = F.expr(
        f"_asset = asset AND _price_bucket = _bucket AND datetime > target_timestamp - INTERVAL {tolerance_minutes} MINUTES "
        f"AND datetime < target_timestamp + INTERVAL {tolerance_minutes} MINUTES"
    )
    return left.join(right, within).drop("_asset", "_bucket", "_price_bucket")


def nearest_match(matched: DataFrame) -> DataFrame:
    """Of several matches of a prediction the nearest one; for landed matches."""
    gap = F.abs(F.timestamp_diff("MICROSECOND", F.col("datetime"), F.col("target_timestamp")))
    ranked = matched.withColumn("_order", F.struct((-gap).alias("gap"), (-F.unix_micros("datetime")).alias("at")))
    return latest_per_key(ranked, ["prediction_id"], ["_order"]).drop("_order")


def every_ten_minutes(writer: DataStreamWriter) -> DataStreamWriter:
    return writer.trigger(processingTime="10 minutes")


def run_available(writer: DataStreamWriter, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop: for replays and tests."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
