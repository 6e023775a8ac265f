"""The registry of models: versions, promotion, what is due, production tails."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidebar.functions.clock import moment
from tidebar.plans import linear, model_store
from tidebar.plans.learning import Learner
from tidebar.session import scratch_path
from tidebar.sources.tables import Store

START = datetime.datetime(2024, 1, 1)
SCHEMA = "asset string, datetime timestamp_ntz, _rn long, price double, x double, target_return_1h double, target_direction_1h int, target_return_1d double, target_direction_1d int"
ONE = Learner(top=1)


def rows(spark, n=80, assets="ab", slope=2.0):
    """The slope changes in the middle, so the length of a tail shows in the fit."""
    out = []
    for a in assets:
        for i in range(n):
            y = (slope if i >= n // 2 else -slope) * (i % 9) + (i % 2) * 0.5 - 6
            out.append((a, START + datetime.timedelta(hours=i), i, 100.0, float(i % 9), y, int(y > 0), y if i < n - 24 else None, int(y > 0)))
    return spark.createDataFrame(out, SCHEMA)


@pytest.fixture
def store(spark):
    return Store(spark, scratch_path(spark, "models-test")).ensure()


def held(store):
    return sorted((r.asset, r.horizon, r.version, r.state) for r in store.read("models").collect())


def test_train_or_load_trains_only_what_is_due(spark, store):
    df, at = rows(spark), lambda h: moment("2024-02-01 00:00:00") + F.expr(f"INTERVAL '{h}' HOUR")
    horizons = ["1h", "1d"]
    first = model_store.train_or_load(store, df, ["x"], at(0), horizons, ONE).count()
    assert first == 4 and held(store) == [(a, h, 1, "candidate") for a in "ab" for h in ("1d", "1h")]
    model_store.train_or_load(store, df, ["x"], at(23), horizons, ONE)
    assert len(held(store)) == 4
    # a new series is trained alone; production models never go stale
    model_store.promote(store, at(23))
    wider = rows(spark, assets="abc")
    model_store.train_or_load(store, wider, ["x"], at(30), horizons, ONE)
    assert [x for x in held(store) if x[3] == "candidate" and x[0] != "c"] == [(a, h, 1, "candidate") for a in "ab" for h in ("1d", "1h")]
    assert [x for x in held(store) if x[0] == "c"] == [("c", "1d", 1, "candidate"), ("c", "1h", 1, "candidate")]
    model_store.train_or_load(store, wider, ["x"], at(60), horizons, ONE)
    assert max(x[2] for x in held(store) if x[0] != "c") == 1 and max(x[2] for x in held(store) if x[0] == "c") == 2
    model_store.train_or_load(store, wider, ["x"], at(61), horizons, ONE, force=True)
    assert {x[2] for x in held(store) if x[0] == "a"} == {1, 2}


def test_promotion_takes_better_candidates_once(spark, store):
    df, at = rows(spark), moment("2024-02-01 00:00:00")
    models, records = linear.train(df, ["x"], ["1h"], ONE)
    model_store.register(store, models, records, ["x"], at)
    assert model_store.promote(store, at).count() == 2 and model_store.promote(store, at).count() == 0
    model_store.register(store, models, records.withColumn("cv_mse_mean", F.col("cv_mse_mean") + 1), ["x"], at)
    assert model_store.promote(store, at).count() == 0
    model_store.register(store, models, records.withColumn("cv_mse_mean", F.lit(0.0)), ["x"], at)
    assert model_store.promote(store, at).count() == 2
    assert {r.version for r in model_store.newest(store, model_store.PRODUCTION).collect()} == {3}
    assert {r.state for r in model_store.usable(store).collect()} == {"production"}


def test_production_training_uses_the_tail_of_the_best_window(spark, store):
    df = rows(spark, n=96)
    best = spark.createDataFrame([("a", "1h", "short", 1, 0.5), ("b", "1h", "long", 4, 0.7)], "asset string, horizon string, window_name string, train_days int, expected_error double")
    model_store.production_training(store, df, ["x"], best, moment("2024-02-01 00:00:00"), ["1h", "1d"], ONE)
    got = {r.asset: r for r in model_store.newest(store, "production").collect()}
    assert set(got) == {"a", "b"} and {r.horizon for r in got.values()} == {"1h"}
    assert got["a"].training_samples == 24 and got["b"].training_samples == 96
    assert got["a"].weights[0] == pytest.approx(2.0, abs=0.1) and abs(got["b"].weights[0]) < 0.5
    assert (got["a"].training_window, got["a"].training_days, got["a"].expected_error) == ("short", 1, 0.5)
    made = {r.asset: r for r in model_store.predict(model_store.usable(store), df).collect()}
    assert made["a"].predicted_return == pytest.approx(got["a"].intercept + got["a"].weights[0] * (95 % 9))


def test_an_empty_registry_and_mixed_lists(spark, store):
    df = rows(spark)
    with pytest.raises(ValueError, match="no models"):
        model_store.predict(model_store.usable(store), df)
    assert model_store.train_or_load(store, df.limit(0), ["x"], moment("2024-02-01 00:00:00")).count() == 0
    for names in (["x"], ["price"]):
        model_store.register(store, *linear.train(df, names, ["1h"], ONE), names, moment("2024-02-01 00:00:00"))
    with pytest.raises(ValueError, match="feature lists"):
        model_store.predict(store.read("models"), df)
