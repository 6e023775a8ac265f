"""Models per series: the fallback of the direction model, saving and loading, the fallback of pairs."""

import datetime

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import LinearRegression

from tidebar.plans import flow, learning

ROWS = [("a", datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=i), i, float(i % 9), 100.0 + i,
         2.0 * (i % 9) - 7.0, int(i % 9 > 3)) for i in range(60)]
SCHEMA = "asset string, datetime timestamp_ntz, _rn long, x double, price double, target_return_1h double, target_direction_1h int"


def linear(_):
    return LinearRegression(featuresCol="scaled", labelCol="_y", predictionCol="predicted_return")


def logistic(_):
    return LogisticRegression(featuresCol="scaled", labelCol="_up", weightCol="_weight", predictionCol="_class",
                              probabilityCol="_probability", rawPredictionCol="_raw", regParam=0.1)


def broken(_):
    raise RuntimeError("no classifier today")


def test_a_failed_direction_model_leaves_the_majority_class(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = learning.train(df, "a", "1h", learning.Learner(regressor=linear, classifier=broken))
    ups = sum(r[-1] for r in ROWS)
    assert got.majority == 1 and "today" in got.record["classifier_error"]
    assert got.record["train_accuracy"] == pytest.approx(ups / len(ROWS))
    row = learning.predict(got, df).first()
    assert row["predicted_direction"] == 1 and row["confidence"] == 1.0
    assert row["predicted_return"] == pytest.approx(ROWS[-1][5], abs=1e-4)


def test_a_saved_model_predicts_the_same(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    made = learning.train(df, "a", "1h", learning.Learner(regressor=linear, classifier=logistic))
    assert made.majority is None and made.record["train_accuracy"] == 1.0
    entry = learning.save(made, str(tmp_path), datetime.datetime(2024, 1, 4))
    again = learning.load(spark.createDataFrame([entry], learning.REGISTRY_SCHEMA), "a", "1h")
    rows = lambda m: learning.predict(m, df, only_last=False).orderBy("created_at").collect()
    assert rows(made) == rows(again)


def test_the_fallback_keeps_its_options(monkeypatch):
    def no_pairs(*_, **__):
        raise ValueError("no pair")

    seen = {}
    monkeypatch.setattr(flow, "prepare_with_pairs", no_pairs)
    monkeypatch.setattr(flow, "prepare_features", lambda *a, **kw: seen.update(args=a, **kw))
    assert flow.prepare_with_fallback("bars", "pairs", "market", "ts", causal=True, ranges=True, keep_flags=("f",))[1] == "no pair"
    assert seen == {"args": ("bars", "market", "ts"), "ranges": True, "keep_flags": ("f",)}
