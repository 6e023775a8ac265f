"""Nearest joins, evaluation, versions and percentiles against brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.functions.clock import moment
from tidebar.operators import percentiles
from tidebar.operators.nearest import Facts, nearest, nearest_of_each
from tidebar.operators.percentiles import exact_percentiles
from tidebar.operators.versions import even_sample, last_rows_by_time, latest_per_key, upsert
from tidebar.plans import accuracy as acc, matching as mt

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


@pytest.mark.parametrize("tolerance,inclusive", [(600, False), (7200, True), (43200, False)])
def test_nearest_equals_brute_force(spark, tolerance, inclusive):
    rng = random.Random(3)
    facts = [(k, at(rng.randrange(0, 5 * 86400, 60)), float(i)) for i, k in enumerate(rng.choices("ab", k=400))]
    probes = [(i, k, at(rng.randrange(-86400, 6 * 86400, 60))) for i, k in enumerate(rng.choices("abc", k=300))]
    got = nearest(
        spark.createDataFrame(probes, "id int, k string, ts timestamp_ntz"),
        spark.createDataFrame(facts, "k string, at timestamp_ntz, v double"),
        keys=["k"], probe_ts="ts", fact_ts="at", values={"v": "v"}, tolerance_seconds=tolerance,
        inclusive=inclusive, out_ts="found",
    ).collect()
    assert len(got) == len(probes)
    for row in got:
        near = [(abs((t - row["ts"]).total_seconds()), t) for k, t, _ in facts if k == row["k"]]
        near = [x for x in near if x[0] < tolerance or (inclusive and x[0] == tolerance)]
        assert row["found"] == (min(near)[1] if near else None)
        if near:
            assert (row["k"], row["found"], row["v"]) in set(facts)


def test_nearest_tie_takes_the_earlier_and_excludes_the_limit(spark):
    facts = spark.createDataFrame([("a", at(0), 1.0), ("a", at(1200), 2.0)], "k string, at timestamp_ntz, v double")
    ask = lambda s, tol: nearest(
        spark.createDataFrame([("a", at(s))], "k string, ts timestamp_ntz"), facts, keys=["k"],
        probe_ts="ts", fact_ts="at", values={"v": "v"}, tolerance_seconds=tol,
    ).first()["v"]
    assert ask(600, 900) == 1.0
    assert ask(601, 900) == 2.0
    assert ask(-600, 600) is None


def test_nearest_plan_has_no_pairwise_join(spark):
    facts = spark.createDataFrame([("a", at(0), 1.0)], "k string, at timestamp_ntz, v double")
    probes = spark.createDataFrame([("a", at(5))], "k string, ts timestamp_ntz")
    df = nearest(probes, facts, keys=["k"], probe_ts="ts", fact_ts="at", values={"v": "v"}, tolerance_seconds=60)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan


def nearest_by_hand(facts, key, asked, tolerance, inclusive):
    """(time, greatest value) of the nearest fact, or two Nones."""
    if asked is None:
        return None, None
    near = [(abs((t - asked).total_seconds()), t, v) for k, t, v in facts if k == key and t is not None]
    near = [x for x in near if x[0] < tolerance or (inclusive and x[0] == tolerance)]
    if not near:
        return None, None
    best = min(x[:2] for x in near)
    return best[1], max(v for d, t, v in near if (d, t) == best)


@pytest.mark.parametrize("seed", (1, 2))
def test_several_sources_in_one_pass_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    some = lambda n, step: [
        (k, None if rng.random() < 0.05 else at(rng.randrange(0, 9 * 86400, step)), float(i))
        for i, k in enumerate(rng.choices("ab", k=n))]
    tables = {"near": (some(300, 60), 600, False, 0), "wide": (some(15, 3600), 5 * 86400, True, 0),
              "later": (some(200, 300), 3600, False, 86400), "none": ([], 600, False, 0)}
    probes = [(i, k, None if rng.random() < 0.1 else at(rng.randrange(-2 * 86400, 11 * 86400, 60)))
              for i, k in enumerate(rng.choices("abc", k=250))]
    probes += probes[:5]  # repeated rows stay
    frame = lambda rows: spark.createDataFrame(rows, "k string, at timestamp_ntz, v double")
    sources = [Facts(frame(rows), "at", {n: "v"}, tol, inc, f"{n}_at", later) for n, (rows, tol, inc, later) in tables.items()]
    asked = spark.createDataFrame(probes, "`an id` int, k string, ts timestamp_ntz")
    got = nearest_of_each(asked, sources, keys=["k"], probe_ts="ts").collect()
    assert sorted(r["an id"] for r in got) == sorted(p[0] for p in probes)
    for r in got:
        for name, (rows, tol, inc, later) in tables.items():
            wanted = r["ts"] and r["ts"] - dt.timedelta(seconds=later)
            assert (r[f"{name}_at"], r[name]) == nearest_by_hand(rows, r["k"], wanted, tol, inc)


def test_several_sources_need_one_exchange_and_two_sorts(spark):
    facts = spark.createDataFrame([("a", at(0), 1.0)], "k string, at timestamp_ntz, v double")
    probes = spark.createDataFrame([("a", at(5))], "k string, ts timestamp_ntz")
    sources = [Facts(facts, "at", {n: "v"}, 60) for n in ("x", "y", "z")]
    plan = nearest_of_each(probes, sources, keys=["k"], probe_ts="ts")._jdf.queryExecution().executedPlan().toString()
    # one for the rows of all sources and probes, one for the first and last fact of each slot
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Window [") == 2
    assert "Join" not in plan


def test_probes_without_a_time_are_spread(spark):
    facts = spark.createDataFrame([("a", at(0), 1.0)], "k string, at timestamp_ntz, v double")
    probes = spark.range(4000).select("id", F.lit("a").alias("k"), F.lit(None).cast("timestamp_ntz").alias("ts"))
    got = nearest(probes, facts, keys=["k"], probe_ts="ts", fact_ts="at", values={"v": "v"}, tolerance_seconds=60)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r[1] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 4000 and len(sizes) == 8 and max(sizes) < 800 and got.where("v is not null").count() == 0


def test_evaluation_without_a_start_price(spark):
    rows = spark.createDataFrame(
        [("p", "a", "1h", 10.0, 12.0, None, at(0), at(3600), 0.9), ("q", "a", "1h", 10.0, 0.0, 11.0, at(0), at(3600), 0.9)],
        "prediction_id string, asset string, horizon string, predicted_price double, actual_price double, "
        "start_price double, created_at timestamp_ntz, target_timestamp timestamp_ntz, confidence double",
    )
    p, q = mt.evaluate(rows, moment("2024-01-02 00:00:00")).orderBy("prediction_id").collect()
    assert (p["direction_predicted"], p["direction_actual"], p["direction_correct"]) == (1, 1, 1)
    assert p["percent_error"] == pytest.approx(2 / 12 * 100)
    assert (q["percent_error"], q["direction_predicted"], q["direction_actual"]) == (0, 0, 0)


def test_latest_version_and_upsert(spark):
    now = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0)], "k string, v int, x double")
    assert sorted((r.k, r.x) for r in latest_per_key(now, ["k"], ["v"]).collect()) == [("a", 2.0), ("b", 3.0)]
    change = spark.createDataFrame([("b", 1, 9.0), ("c", 1, 4.0)], "k string, v int, x double")
    merged = upsert(latest_per_key(now, ["k"], ["v"]), change, ["k"], ["v"])
    assert sorted((r.k, r.x) for r in merged.collect()) == [("a", 2.0), ("b", 9.0), ("c", 4.0)]


def test_even_sample_and_tail(spark, make_bars):
    rows = spark.range(103).selectExpr("'a' AS k", "id")
    assert [r.id for r in even_sample(rows, ["k"], "id", 10).orderBy("id").collect()] == list(range(0, 100, 10))
    few = spark.range(4).selectExpr("'a' AS k", "id")
    assert even_sample(few, ["k"], "id", 10).count() == 4
    bars = make_bars({"a": [float(i) for i in range(100)], "b": [1.0, 2.0]})
    tail = last_rows_by_time(bars, 3).orderBy("asset", "datetime").collect()
    assert [r.price for r in tail] == [97.0, 98.0, 99.0, 1.0, 2.0]


def test_exact_percentiles_with_a_hot_group_and_many_equal_values(spark):
    rng = np.random.default_rng(5)
    hot = np.concatenate([np.zeros(3000), rng.exponential(5, 3000).round(2), [1e9]])
    cold = rng.normal(size=17)
    rows = [("hot", float(v)) for v in hot] + [("cold", float(v)) for v in cold] + [("one", 4.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    qs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]
    got = {r["k"]: r["percentiles"] for r in exact_percentiles(df, ["k"], "v", qs).collect()}
    for key, data in (("hot", hot), ("cold", cold), ("one", [4.0])):
        np.testing.assert_allclose(got[key], np.quantile(data, qs), rtol=1e-12)


@pytest.mark.parametrize("most", (2, 40))
def test_slices_are_cut_until_they_are_small(spark, monkeypatch, most):
    rng = np.random.default_rng(6)
    data = {"hot": np.concatenate([rng.lognormal(3, 2, 9000), np.full(500, 7.0)]), "cold": np.array([2.0, 1.0]), "one": np.array([4.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs] + [("hot", None), ("none", None)], "k string, v double")
    qs, slices, keep = [0.0, 0.33, 0.5, 0.5, 0.999, 1.0], [], percentiles.staged

    def watched(rows, name):
        kept = keep(rows, name)
        if name == "value-slices":
            slices.append(kept.agg(F.max("_values")).first()[0])
        return kept

    monkeypatch.setattr(percentiles, "staged", watched)
    got = {r["k"]: r["percentiles"] for r in exact_percentiles(df, ["k"], "v", qs, most=most).collect()}
    assert got.keys() == data.keys()
    for key, values in data.items():
        np.testing.assert_allclose(got[key], np.quantile(values, qs), rtol=1e-12)
    assert len(slices) > 1 and slices[0] > most >= slices[-1]


def test_percentiles_of_nothing(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert exact_percentiles(df, ["k"], "v", [0.5]).isEmpty()


def test_histogram_keeps_the_right_edge(spark):
    rows = spark.createDataFrame([("1h", v) for v in (0.0, 0.5, 1.0, 2.0, 3.0)], "horizon string, percent_error double")
    bins = {r["bin"]: r["frequency"] for r in acc.histogram(rows, "percent_error").collect()}
    assert bins == {0: 1, 2: 1, 4: 1, 8: 1, 11: 1}


def test_report_has_lines_for_missing_groups(spark):
    columns = (
        "asset string, horizon string, total_predictions long, mean_absolute_error double, mean_percent_error double, "
        "direction_accuracy double, root_mean_squared_error double, min_error double, max_error double"
    )
    metrics = spark.createDataFrame([("a", "1h", 2, 1.0, 2.0, 0.5, 1.5, 0.5, 2.0)], columns)
    assets = spark.createDataFrame([("a",)], "asset string")
    lines = [r["line"] for r in acc.report(metrics, assets).orderBy("position").collect()]
    assert lines[0].startswith("a 1h: n=2") and lines[1:] == ["a 1d: no data available", "a 1w: no data available"]


def test_gap_between_due_and_evaluated(spark):
    made = [(f"p{m}", "a", "1h", 1.0, 0.5, at(3600 + m * 60), at(m * 60)) for m in (-4, -2, 1, 2)]
    schema = (
        "prediction_id string, asset string, horizon string, predicted_price double, confidence double, "
        "target_timestamp timestamp_ntz, created_at timestamp_ntz"
    )
    predictions = spark.createDataFrame(made, schema)
    done = lambda *ids: spark.createDataFrame([(i,) for i in ids], "prediction_id string")
    now = F.lit(at(3600))
    assert mt.due_predictions(predictions, done(), now).first()["prediction_id"] == "p1"
    assert mt.due_predictions(predictions, done("p1"), now).first()["prediction_id"] == "p2"
    assert mt.due_predictions(predictions, done("p1", "p2", "p-2"), now).count() == 0
