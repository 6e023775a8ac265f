"""Stored tables, cleaning, folds, splits and streams on small data."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidebar.operators import cleaning
from tidebar.operators.series import chunked
from tidebar.plans import backtest as bt, flow, learning as ml, registry
from tidebar.session import scratch_path, shared_dir
from tidebar.sources.tables import PREDICTION_TABLES, SCHEMAS, Store
from tidebar.streaming import jobs


def at(hours):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_store_upserts_by_key_and_clears(spark):
    store = Store(spark, scratch_path(spark, "store")).ensure()
    assert store.counts().where("rows > 0").count() == 0
    prices = lambda *rows: spark.createDataFrame(
        [("a", at(h), v) for h, v in rows], "asset string, target_timestamp timestamp_ntz, actual_price double"
    )
    store.upsert("actual_prices", prices((0, 1.0), (30, 2.0), (60, 3.0)))
    store.upsert("actual_prices", prices((30, 9.0), (31, 4.0)))
    got = sorted((r.target_timestamp, r.actual_price) for r in store.read("actual_prices").collect())
    assert got == [(at(0), 1.0), (at(30), 9.0), (at(31), 4.0), (at(60), 3.0)]
    store.append("bars", spark.createDataFrame([("a", at(0), 1.0, 1.0, 1.0)], SCHEMAS["bars"]))
    with pytest.raises(ValueError):
        store.clear_predictions()
    counts = {r.table_name: (r.rows_before, r.rows_after) for r in store.clear_predictions(confirm=True).collect()}
    assert counts["actual_prices"] == (4, 0) and counts["bars"] == (1, 1)
    assert all(counts[t][1] == 0 for t in PREDICTION_TABLES)
    store.upsert("actual_prices", prices((5, 5.0)))
    assert store.read("actual_prices").count() == 1


def test_rare_flag_is_an_outlier_unless_kept(spark):
    rows = spark.createDataFrame([("a", i, 1.0 if i == 7 else 0.0) for i in range(100)], "asset string, _rn long, f double")
    assert cleaning.three_sigma(rows, ["f"]).where("f IS NULL").count() == 1
    assert cleaning.three_sigma(rows, ["f"], keep_flags=["f"]).where("f IS NULL").count() == 0


def test_caps_follow_the_name(spark):
    rows = spark.createDataFrame([(5000.0, 5000.0, 2e10)], "x_ratio double, x double, y double")
    assert cleaning.cap_values(rows, rows.columns).first() == (None, 5000.0, None)


def test_training_rows(spark):
    rows = spark.createDataFrame(
        [(1.0, 1.0), (None, 1.0), (float("nan"), 1.0), (1e16, 1.0), (1.0, None)], "x double, t double"
    )
    assert sorted(r.x for r in cleaning.training_rows(rows, ["x"], ["t"]).collect()) == [0.0, 0.0, 1.0]


def test_expanding_folds(spark):
    rows = spark.range(35).selectExpr("'a' AS asset", "id AS _rn")
    folds = [(r.test_start, r.test_end) for r in ml.expanding_folds(rows).orderBy("fold").collect()]
    assert folds == [(11, 19), (19, 27), (27, 35)]


def test_perfect_and_constant_features(spark):
    rows = spark.createDataFrame([("a", float(i), 1.0, float(i)) for i in range(12)], "asset string, x double, c double, y double")
    scores = {r.feature: r.score for r in ml.feature_scores(rows, ["x", "c"], "y").collect()}
    assert scores["c"] == 0 and scores["x"] > 1e12


def test_splits_leave_enough_future(spark):
    lengths = spark.createDataFrame([("a", 30 * 24 + 8 * 24 + 1), ("b", 30 * 24 + 8 * 24)], "asset string, n long")
    got = [(r.asset, r.train_start, r.train_end) for r in bt.time_splits(lengths, 30, 7).collect()]
    assert got == [("a", 0, 720)]


def test_feature_counts():
    assert len(registry.single_features()) == 174
    assert len(registry.single_features(market=True)) == 198
    assert len(registry.all_features(market=True, with_future=True)) == 273


def test_leakage_report_finds_names_and_known_tails(spark):
    rows = [("a", at(i), i, 1.0, 2.0, 2.0 if i < 199 else None, 2.0, None) for i in range(200)]
    columns = "asset string, datetime timestamp_ntz, _rn long, price double, next_price double, target_1h double, target_1d double, target_1w double"
    report = {(r["check"], r["column"]): r["ok"] for r in flow.leakage_report(spark.createDataFrame(rows, columns)).collect()}
    assert report["target tail unknown", "target_1h"] and not report["target tail unknown", "target_1d"]
    assert report["time order", "datetime"] and not report["feature name", "next_price"]


def test_replaced_columns_keep_their_readers(make_bars):
    s = chunked(make_bars({"a": [1.0, 2.0, 4.0]}))
    s = s.with_columns({"x": F.col("price") * 2}).with_columns({"before": F.col("x") + 1})
    s = s.with_columns({"x": s.lag("x")}).with_columns({"after": F.col("x") + 1})
    got = [(r.before, r.x, r.after) for r in s.rows().orderBy("datetime").collect()]
    assert got == [(3.0, None, None), (5.0, 2.0, 3.0), (9.0, 4.0, 5.0)]


def test_stream_closes_hours_and_drops_late_ticks(spark):
    path, out = scratch_path(spark, "ticks"), scratch_path(spark, "out")
    state = scratch_path(spark, "state")
    schema = "asset string, ts timestamp_ntz, value double, id long"
    minute = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)

    def feed(*ticks):
        spark.createDataFrame([("a", minute(m), v, m) for m, v in ticks], schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        bars = jobs.hourly_bars(stream, asset="asset", ts="ts", price="value", volume="value", tiebreak="id")
        jobs.run_available(bars.writeStream.format("parquet").option("path", out), state)
        return [(r.datetime.hour, r.price, r.volume) for r in spark.read.schema(bars.schema).parquet(out).orderBy("datetime").collect()]

    assert feed((5, 1.0), (50, 2.0), (65, 3.0)) == []
    assert feed((75, 4.0)) == [(0, 2.0, 3.0)]
    assert feed((30, 9.0), (140, 5.0)) == [(0, 2.0, 3.0), (1, 4.0, 7.0)]


def test_a_scope_leaves_nothing_behind(spark, tmp_path):
    import os

    from tidebar.session import scratch_scope, staged

    with scratch_scope(spark):
        kept = staged(spark.range(3).toDF("x"), "inside")
        path = kept.inputFiles()[0].removeprefix("file:")
        assert os.path.exists(path) and kept.count() == 3
    assert not os.path.exists(path)
