"""Linear models from moments against numpy on the rows themselves."""

import datetime
import math

import numpy as np
import pytest

from tidebar.plans import linear
from tidebar.plans.learning import Learner

START = datetime.datetime(2024, 1, 1)
NAMES = [f"f{i:02}" for i in range(50)]
LEARNER = Learner(top=50)


def make(spark, sizes, seed=1, level=0.0, missing=True):
    rng = np.random.default_rng(seed)
    rows = {}
    for asset, n in sizes.items():
        x = rng.normal(size=(n, 50)) * (1 + np.arange(50)) + level
        y = x[:, 3] * 0.5 - x[:, 10] * 0.2 + rng.normal(size=n) * 3
        for i in range(n):
            far = {h: float(y[i] * k) if i < n - b else None for h, b, k in (("1h", 1, 1), ("1d", 24, 2), ("1w", 168, -1))}
            f = [None if missing and i % 41 == 7 and j == 3 else float(v) for j, v in enumerate(x[i])]
            rows.setdefault(asset, []).append((asset, START + datetime.timedelta(hours=i), i, 100.0 + i, *f, *far.values(),
                                               *[None if v is None else int(v > level * 0.3) for v in far.values()]))
    schema = "asset string, datetime timestamp_ntz, _rn long, price double, " + ", ".join(f"{n} double" for n in NAMES) + "".join(
        f", target_return_{h} double" for h in linear.HORIZONS) + "".join(f", target_direction_{h} int" for h in linear.HORIZONS)
    return spark.createDataFrame([r for rs in rows.values() for r in rs], schema).repartition(7), rows


def known(rows, h):
    """x, y, up of the rows that training keeps, in order of time."""
    k = linear.HORIZONS.index(h)
    kept = [r for r in rows if r[54 + k] is not None]
    return (np.array([[0.0 if v is None else v for v in r[4:54]] for r in kept]), np.array([r[54 + k] for r in kept]), np.array([r[57 + k] for r in kept]))


def least_squares(x, y):
    a = np.column_stack([np.ones(len(x)), x])
    return np.linalg.lstsq(a, y, rcond=None)[0]


@pytest.mark.parametrize("level", [0.0, 1e7])
def test_fifty_features_equal_least_squares(spark, level):
    df, rows = make(spark, {"a": 900, "b": 400}, level=level)
    models, records = linear.train(df, NAMES, learner=LEARNER)
    final = {(r.asset, r.horizon): r for r in models.where("kind = 'final'").collect()}
    folds = {(r.asset, r.horizon, r.fold): r for r in models.where("kind = 'return'").collect()}
    assert set(final) == {(a, h) for a in "ab" for h in linear.HORIZONS} and len(folds) == 30
    for (asset, h), r in final.items():
        x, y, up = known(rows[asset], h)
        b = least_squares(x - level, y)
        assert r.n == len(y) and r.ups == up.sum()
        assert np.allclose(r.weights, b[1:], rtol=1e-5, atol=1e-7)
        assert r.error == pytest.approx(np.mean((y - b[0] - (x - level) @ b[1:]) ** 2), rel=1e-6)
        size = len(y) // 6
        for k in range(1, 6):
            start = len(y) - (6 - k) * size
            f = folds[asset, h, k]
            assert f.n == start
            if start < 80:  # fewer rows than features: many solutions
                continue
            c = least_squares(x[:start] - level, y[:start])
            test = slice(start, start + size)
            assert f.error == pytest.approx(np.mean((y[test] - c[0] - (x[test] - level) @ c[1:]) ** 2), rel=1e-4)
    for r in records.collect():
        errors = [folds[r.asset, r.horizon, k].error for k in range(1, 6)]
        assert r.folds == 5 and r.cv_mse_mean == pytest.approx(np.mean(errors)) and r.cv_mse_std == pytest.approx(np.std(errors))


def discriminant(x, up):
    ups, downs = up.sum(), len(up) - up.sum()
    m1, m0 = x[up == 1].mean(0), x[up == 0].mean(0)
    within = sum((x[up == c] - m).T @ (x[up == c] - m) for c, m in ((1, m1), (0, m0))) / len(up)
    w = np.linalg.solve(within, m1 - m0)
    extra = max(ups, downs) / min(ups, downs) if min(ups, downs) / len(up) < 0.2 else 1
    return w, math.log(extra * ups / downs) - w @ (m1 + m0) / 2


def test_direction_scores_and_records(spark):
    df, rows = make(spark, {"a": 700, "b": 300}, seed=4)
    models, records = linear.train(df, NAMES, ["1h"], LEARNER)
    made = {(r.asset, r.created_at): r for r in linear.predict(models, df, NAMES, ["1h"], only_last=False).collect()}
    last = {r.asset: r for r in linear.predict(models, df, NAMES, ["1h"]).collect()}
    for r in records.collect():
        x, y, up = known(rows[r.asset], "1h")
        b, (w, c) = least_squares(x, y), discriminant(x, up)
        p = 1 / (1 + np.exp(-(x @ w + c)))
        for i in (0, 17, len(y) - 1):
            got = made[r.asset, rows[r.asset][i][1]]
            assert got.predicted_return == pytest.approx(b[0] + x[i] @ b[1:], rel=1e-6, abs=1e-8)
            assert got.direction_confidence == pytest.approx(p[i], rel=1e-6, abs=1e-9)
            assert got.predicted_direction == int(p[i] > 0.5) and got.target_timestamp == got.created_at + datetime.timedelta(hours=1)
        assert r.train_mae == pytest.approx(np.mean(np.abs(y - b[0] - x @ b[1:])), rel=1e-6)
        assert r.train_accuracy == pytest.approx(np.mean((p > 0.5) == up))
        size, hits = len(y) // 6, []
        for k in range(1, 6):
            start = len(y) - (6 - k) * size
            w, c = discriminant(x[:start], up[:start])
            hits.append(np.mean((x[start : start + size] @ w + c > 0) == up[start : start + size]))
        assert r.cv_accuracy_mean == pytest.approx(np.mean(hits)) and r.cv_accuracy_std == pytest.approx(np.std(hits))
        assert last[r.asset].created_at == rows[r.asset][-1][1]


def test_the_best_features_are_those_of_the_scores(spark):
    from tidebar.plans import learning
    df, rows = make(spark, {"a": 500, "b": 350}, seed=9, missing=False)
    models, _ = linear.train(df, NAMES, ["1d"], Learner(top=4, folds=3))
    scores = learning.feature_scores(df.where("target_return_1d is not null"), NAMES, "target_return_1d")
    want = {}
    for r in learning.best_features(scores, 4).orderBy("place").collect():
        want.setdefault(r.asset, []).append(r.feature)
    got = {r.asset: r for r in models.where("kind = 'final'").collect()}
    assert {a: r.chosen for a, r in got.items()} == want
    assert all(sum(w != 0 for w in r.weights) == 4 for r in got.values())
    assert models.where("kind = 'return'").count() == 6


def test_small_odd_and_single_class_series(spark):
    rows = [("few", START, i, 1.0, float(i), 2.0, float(i), 1) for i in range(9)]
    rows += [("up", START + datetime.timedelta(hours=i), i, 1.0, float(i), 2.0, 3.0 * i + 1, 1) for i in range(60)]
    rows += [("rare", START + datetime.timedelta(hours=i), i, 1.0, float(i % 7), 1e16 if i == 5 else 2.0, float(i % 5) - 2, int(i in (3, 30, 50, 70))) for i in range(90)]
    rows += [("flat", START + datetime.timedelta(hours=i), i, 1.0, 4.0, 2.0, 5.0, i % 2) for i in range(40)]
    rows += [("none", START, 0, 1.0, None, None, None, None), (None, START, 0, 1.0, 1.0, 1.0, 1.0, 1)]
    df = spark.createDataFrame(rows, "asset string, datetime timestamp_ntz, _rn long, price double, x double, z double, target_return_1h double, target_direction_1h int")
    models, records = linear.train(df, ["x", "z"], ["1h"])
    got = {r.asset: r for r in models.where("kind = 'final'").collect()}
    assert set(got) == {"up", "rare", "flat"}
    assert got["up"].majority == 1 and got["up"].up_weights is None and got["up"].weights == pytest.approx([3.0, 0.0])
    assert got["up"].error == pytest.approx(0, abs=1e-9) and got["rare"].n == 89
    assert got["flat"].weights == [0.0, 0.0] and got["flat"].intercept == 5.0
    # four rises allow two folds of the direction, the return still has five
    kinds = {(r.asset, r.kind): r["count"] for r in models.groupBy("asset", "kind").count().collect()}
    assert kinds["rare", "direction"] == 2 and kinds["rare", "return"] == 5 and kinds["flat", "direction"] == 4
    record = {r.asset: r for r in records.collect()}
    assert record["up"].train_accuracy == 1.0 and record["up"].majority_only and record["rare"].minority_share == pytest.approx(4 / 89)
    one = {r.asset: r for r in linear.predict(models, df, ["x", "z"], ["1h"]).collect()}
    assert one["up"].confidence == 1.0 and one["up"].predicted_direction == 1 and one["flat"].predicted_return == 5.0
    empty = df.limit(0)
    assert linear.train(empty, ["x", "z"], ["1h"])[1].collect() == []


def test_moments_merge_without_loss():
    rng = np.random.default_rng(0)
    z = rng.normal(size=(1000, 5)) + 1e7
    parts = [linear.Moments.of(z[i : i + 37]) for i in range(0, 1000, 37)]
    total = parts[0]
    for m in parts[1:]:
        total = total + m
    whole = linear.Moments.of(z)
    assert total.n == 1000 and np.allclose(total.mean, whole.mean) and np.allclose(total.products, whole.products, rtol=1e-6)
    again = linear.Moments.unpacked(total.n, total.mean, total.packed())
    assert np.array_equal(again.products, total.products)
