"""Two streams joined around a target time, over several micro-batches."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidebar.catalog.stream_queries import in_order, landed, time_ranges
from tidebar.streaming import jobs

START = dt.datetime(2024, 1, 1)
PREDICTION = "prediction_id string, asset string, target_timestamp timestamp_ntz, created_at timestamp_ntz, _arrives timestamp_ntz"


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def matched(spark, predictions, prices, n=5):
    made = spark.createDataFrame(predictions, PREDICTION)
    known = spark.createDataFrame(prices, "asset string, datetime timestamp_ntz, price double, _arrives timestamp_ntz")
    ranges = [at(i * 240) for i in range(n + 1)]
    both = jobs.match_predictions(in_order(made, "_arrives", "made", ranges), in_order(known, "_arrives", "known", ranges))
    rows = landed(both.writeStream.outputMode("append"), spark, both.schema)
    return sorted((r.prediction_id, r.actual_price) for r in rows.collect())


def test_matches_over_batches_equal_brute_force(spark):
    rng = random.Random(4)
    prices = [(a, t, float(i), t) for i, (a, t) in enumerate((rng.choice("ab"), at(m)) for m in range(0, 1200, 7))]
    made = [(a, at(rng.randrange(0, 1100)), rng.choice((60, 400, 3000))) for a in rng.choices("abc", k=80)]
    # on the borders of a bucket and of the interval
    made += [("a", at(60 * k + d), 60) for k in (1, 5) for d in (-30, -1, 0, 1, 29, 30)]
    predictions = [(f"p{i}", a, t + dt.timedelta(minutes=h), t, t) for i, (a, t, h) in enumerate(made)]
    again = [(*p[:4], p[4] + dt.timedelta(minutes=240)) for p in predictions[::2]]
    want = sorted((p[0], v) for p in predictions for a, t, v, _ in prices
                  if a == p[1] and abs((t - p[2]).total_seconds()) < 1800)
    assert want and matched(spark, predictions + again, prices) == want


def test_a_late_price_is_dropped_and_a_late_horizon_waits(spark):
    predictions = [("near", "a", at(60), at(0), at(0)), ("far", "a", at(1100), at(1), at(1))]
    prices = [("a", at(m), float(m), at(m)) for m in (0, 200, 230, 300, 500, 700, 960, 1099)]
    late = [("a", at(60), -1.0, at(800)), ("a", at(690), -2.0, at(900))]  # the first is behind the watermark
    predictions.append(("mid", "a", at(690), at(2), at(2)))
    assert matched(spark, predictions, prices + late) == [("far", 1099.0), ("mid", -2.0), ("mid", 700.0)]


def test_time_ranges_hold_all_rows(spark):
    rows = spark.createDataFrame([(at(m),) for m in (3, 9, 77)], "ts timestamp_ntz")
    ends = time_ranges(rows, "ts", 6)
    assert len(ends) == 7 and rows.where((F.col("ts") >= F.lit(ends[0])) & (F.col("ts") < F.lit(ends[-1]))).count() == 3
