"""Linear models of all series and horizons, from one pass over the rows.

What a least-squares fit needs of a set of rows are its moments: count, means, and the
centred products of features, return and direction. Tasks gather them per (series, horizon,
segment), partial moments are merged on the way (two rounds, so that a series with a third of
all rows arrives as at most 64 partial rows), and each (series, horizon) is solved from its
own few small matrices. No row is copied per series, fold or horizon, and nothing passes
through the driver.

Segments are what lies between the borders of the folds of an expanding split. The training
part of a fold is the merged moments of the segments before it, and its squared error on the
test part follows from that segment's moments, so all folds cost one pass together.

Moments are merged with their means (not as raw sums), so large levels lose no digits.
Features are chosen by their F score, which the moments hold as well; collinear ones share
their weight (least norm of the scaled weights). The direction comes from linear discriminant
analysis of the same features, with the usual weight for a rare class; one class only leaves
the majority class.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidebar import settings
from tidebar.functions.clock import seconds
from tidebar.operators.versions import last_row
from tidebar.plans.learning import Learner, fold_count
from tidebar.session import staged

LEAST_ROWS = 10
SALTS = 64
HELD_BYTES = 64_000_000
HORIZONS = tuple(settings.HORIZONS)


def vector(features: Sequence[str]) -> Column:
    return F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in features])


# -- rows ------------------------------------------------------------------------------------


def class_folds(folds: Column, ups: Column, n: Column) -> Column:
    """A rare class bounds the folds: two of its rows for each, and never under two folds."""
    return F.least(folds, F.greatest(F.lit(2), F.floor(F.least(ups, n - ups) / 2)))


def segment(place: Column, n: Column, folds: Column) -> Column:
    """0 before the first test part, k in that of fold k."""
    size = F.floor(n / (folds + 1))
    start = n - folds * size
    return F.when(place < start, 0).otherwise(1 + F.floor((place - start) / size)).cast("int")


def training_table(
    df: DataFrame, features: Sequence[str], horizons: Sequence[str] = HORIZONS, learner: Learner = Learner(),
    order: str = "datetime", since: DataFrame | None = None,
) -> DataFrame:
    """asset, time, ``x`` (missing features as 0) and per horizon the return ``y_``, direction
    ``up_`` and the segments ``fold_`` and ``class_fold_``; NULL where training does not use
    the row for that horizon (target unknown, a huge value, or before ``since``: asset and
    ``from_1h`` and so on, first row numbers). Folds count the rows that are left."""
    if since is not None:
        df = df.join(since, "asset", "left")
    x = vector(features)
    fine = F.forall("x", lambda v: ~F.isnan(v) & (F.abs(v) <= 1e15))
    rows = df.select(
        "asset", order, x.alias("x"), *[F.col(f"{s}_{h}").alias(f"{t}_{h}") for h in horizons
                                        for s, t in (("target_return", "y"), ("target_direction", "up"))],
        *[(F.col("_rn") >= F.col(f"from_{h}") if since is not None else F.lit(True)).alias(f"in_{h}") for h in horizons],
        F.floor(seconds(order) / F.lit(settings.SLOT_SECONDS)).alias("_slot"))
    used = lambda h: fine & F.col(f"in_{h}") & F.col(f"y_{h}").isNotNull() & F.col(f"up_{h}").isNotNull() & ~F.isnan(f"y_{h}")
    rows = rows.withColumns({f"used_{h}": F.coalesce(used(h), F.lit(False)).cast("int") for h in horizons})
    counts = rows.groupBy("asset", "_slot").agg(
        *[F.sum(f"used_{h}").alias(f"c_{h}") for h in horizons],
        *[F.sum(F.col(f"used_{h}") * F.col(f"up_{h}")).alias(f"u_{h}") for h in horizons])
    series = Window.partitionBy("asset")
    before = series.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("asset", "_slot", *[e for h in horizons for e in (
        F.coalesce(F.sum(f"c_{h}").over(before), F.lit(0)).alias(f"o_{h}"),
        F.sum(f"c_{h}").over(series).alias(f"n_{h}"), F.sum(f"u_{h}").over(series).alias(f"ups_{h}"))])
    so_far = Window.partitionBy("asset", "_slot").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumns({f"at_{h}": F.sum(f"used_{h}").over(so_far) for h in horizons}).join(counts, ["asset", "_slot"])
    out = []
    for h in horizons:
        n, ups, at = F.col(f"n_{h}"), F.col(f"ups_{h}"), F.col(f"o_{h}") + F.col(f"at_{h}") - 1
        folds = fold_count(n, learner.folds)
        mine = (F.col(f"used_{h}") == 1) & (n >= LEAST_ROWS)
        out += [F.when(mine, F.col(f"y_{h}").cast("double")).alias(f"y_{h}"), F.when(mine, F.col(f"up_{h}").cast("double")).alias(f"up_{h}"),
                F.when(mine, segment(at, n, folds)).alias(f"fold_{h}"),
                F.when(mine, segment(at, n, class_folds(folds, ups, n))).alias(f"class_fold_{h}")]
    return placed.select("asset", order, "x", *out)


# -- moments ---------------------------------------------------------------------------------


@dataclass
class Moments:
    """Count, means and centred products of (features, return, direction)."""

    n: int
    mean: np.ndarray
    products: np.ndarray

    @classmethod
    def of(cls, z: np.ndarray) -> Moments:
        mean = z.mean(axis=0)
        centred = z - mean
        return cls(len(z), mean, centred.T @ centred)

    def __add__(self, other: Moments) -> Moments:
        n, apart = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + apart * (other.n / n),
                       self.products + other.products + np.outer(apart, apart) * (self.n * other.n / n))

    def packed(self) -> np.ndarray:
        return self.products[np.triu_indices(len(self.mean))]

    @classmethod
    def unpacked(cls, n: int, mean: np.ndarray, packed: np.ndarray) -> Moments:
        full = np.zeros((len(mean), len(mean)))
        full[np.triu_indices(len(mean))] = packed
        return cls(n, mean, full + np.triu(full, 1).T)


KEYS = ("asset", "horizon", "fold", "class_fold")
PARTIAL = "asset string, horizon string, fold int, class_fold int, n long, mean array<double>, products array<double>, salt int"
_PARTIAL = pa.schema([("asset", pa.string()), ("horizon", pa.string()), ("fold", pa.int32()), ("class_fold", pa.int32()), ("n", pa.int64()),
                      ("mean", pa.list_(pa.float64())), ("products", pa.list_(pa.float64())), ("salt", pa.int32())])


def _in_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow with batches bounded by bytes, as one row may hold a matrix."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8388608")
    return df.mapInArrow(fn, schema)


def _rows_of(held: dict[tuple, Moments], salt: int) -> Iterator[pa.RecordBatch]:
    for key, m in held.items():
        values = (*key, m.n, m.mean, m.packed(), salt)
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _PARTIAL.types)], schema=_PARTIAL)


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def gather_moments(table: DataFrame, horizons: Sequence[str] = HORIZONS) -> DataFrame:
    """Moments by (series, horizon, fold, class fold)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Moments] = {}
        salt = TaskContext.get().partitionId() % SALTS
        for b in batches:
            x, coded = _vectors(b.column("x")), b.column("asset").dictionary_encode()
            asset, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
            for h in horizons:
                y, up, fold, other = (b.column(f"{c}_{h}").to_numpy(zero_copy_only=False).astype(float) for c in ("y", "up", "fold", "class_fold"))
                at = np.flatnonzero(~np.isnan(fold))
                group = np.stack([asset[at], fold[at], other[at]]).astype(np.int64)
                distinct, which = np.unique(group, axis=1, return_inverse=True)
                for i, (a, f, c) in enumerate(distinct.T):
                    rows = at[which.ravel() == i]
                    m = Moments.of(np.column_stack([x[rows], y[rows], up[rows]]))
                    key = (names[a], h, int(f), int(c))
                    held[key] = held[key] + m if key in held else m
            if held and len(held) * (x.shape[1] + 2) ** 2 * 8 > HELD_BYTES:
                yield from _rows_of(held, salt)
                held = {}
        yield from _rows_of(held, salt)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Moments] = {}
        for key, salt, m in _read(batches):
            if (*key, salt) not in held:
                yield from _rows_of({k[:-1]: v for k, v in held.items()}, salt)
                held = {}
            held[*key, salt] = held[*key, salt] + m if held else m
        yield from _rows_of({k[:-1]: v for k, v in held.items()}, 0)

    partial = _in_batches(table, run, PARTIAL)
    by = [*KEYS, "salt"]
    return _in_batches(partial.repartition(*by).sortWithinPartitions(*by), merge, PARTIAL)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, Moments]]:
    for b in batches:
        for i in range(b.num_rows):
            key = tuple(b.column(c)[i].as_py() for c in KEYS)
            mean, packed = (b.column(c)[i].values.to_numpy() for c in ("mean", "products"))
            yield key, b.column("salt")[i].as_py(), Moments.unpacked(b.column("n")[i].as_py(), mean, packed)


# -- fits ------------------------------------------------------------------------------------


def f_scores(m: Moments) -> np.ndarray:
    """As in learning.feature_scores: a constant feature 0, a perfect one the largest double."""
    p = len(m.mean) - 2
    spread, own = np.diag(m.products)[:p], m.products[p, p]
    moving = (spread > 1e-24 * m.n * (1 + m.mean[:p] ** 2)) & (own > 0)
    r2 = np.where(moving, m.products[:p, p] ** 2 / np.where(moving, spread * own, 1), 0.0)
    with np.errstate(over="ignore"):
        score = r2 / np.maximum(1 - r2, 1e-300) * (m.n - 2)
    return np.where(r2 >= 1, np.finfo(float).max, score)


def choose(m: Moments, features: Sequence[str], top: int) -> np.ndarray:
    score = f_scores(m)
    return np.array(sorted(range(len(features)), key=lambda i: (-score[i], features[i]))[:top], dtype=int)


def _solved(products: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Weights of scaled features with the least norm, given back for the features as they are."""
    scale = np.sqrt(np.diag(products))
    scale[scale == 0] = 1
    return np.linalg.lstsq(products / np.outer(scale, scale), target / scale, rcond=1e-10)[0] / scale


def fit_return(m: Moments, chosen: np.ndarray) -> tuple[np.ndarray, float]:
    p = len(m.mean) - 2
    weights = np.zeros(p)
    weights[chosen] = _solved(m.products[np.ix_(chosen, chosen)], m.products[chosen, p])
    return weights, float(m.mean[p] - weights @ m.mean[:p])


def squared_error(m: Moments, weights: np.ndarray, intercept: float) -> float:
    """Mean squared error of the return on the rows that the moments are of."""
    p = len(m.mean) - 2
    bias = m.mean[p] - intercept - weights @ m.mean[:p]
    rest = m.products[p, p] - 2 * weights @ m.products[:p, p] + weights @ m.products[:p, :p] @ weights
    return float(bias * bias + max(rest, 0.0) / m.n)


def fit_direction(m: Moments, chosen: np.ndarray) -> tuple[np.ndarray, float] | None:
    """Weights and intercept of the log odds of a rise; None where only one class occurs."""
    p = len(m.mean) - 2
    ups = round(m.mean[p + 1] * m.n)
    downs = m.n - ups
    if not ups or not downs:
        return None
    apart = m.products[chosen, p + 1] * (m.n / (ups * downs))
    within = (m.products[np.ix_(chosen, chosen)] - np.outer(apart, apart) * (ups * downs / m.n)) / m.n
    weights = np.zeros(p)
    weights[chosen] = _solved(within, apart)
    middle = m.mean[chosen] + apart * ((downs - ups) / (2 * m.n))
    few, many = min(ups, downs), max(ups, downs)
    extra = many / few if few / m.n < 0.2 else 1.0
    return weights, float(np.log(extra * ups / downs) - weights[chosen] @ middle)


MODELS = ("asset string, horizon string, kind string, fold int, n long, ups long, chosen array<string>, "
          "weights array<double>, intercept double, up_weights array<double>, up_intercept double, majority int, error double")


def _models_of(asset: str, horizon: str, parts: dict[tuple[int, int], Moments], features: Sequence[str], top: int) -> list[dict]:
    def merged(keep) -> Moments | None:
        total = None
        for key in sorted(parts):
            if keep(key):
                total = parts[key] if total is None else total + parts[key]
        return total

    every = merged(lambda key: True)
    chosen = choose(every, features, top)

    def row(kind: str, fold: int, m: Moments, test: Moments, returns: bool, direction: bool) -> dict:
        ups = round(float(m.mean[-1]) * m.n)
        out = {"asset": asset, "horizon": horizon, "kind": kind, "fold": fold, "n": m.n, "ups": ups,
               "chosen": [features[i] for i in chosen], "majority": int(2 * ups > m.n)}
        if returns:
            out["weights"], out["intercept"] = fit_return(m, chosen)
            out["error"] = squared_error(test, out["weights"], out["intercept"])
        odds = fit_direction(m, chosen) if direction else None
        if odds is not None:
            out["up_weights"], out["up_intercept"], out["majority"] = *odds, None
        return out

    rows = [row("final", 0, every, every, True, True)]
    for kind, place in (("return", 0), ("direction", 1)):
        for fold in range(1, 1 + max(key[place] for key in parts)):
            train, test = merged(lambda key: key[place] < fold), merged(lambda key: key[place] == fold)
            rows.append(row(kind, fold, train, test, kind == "return", kind == "direction"))
    return rows


def fit_all(table: DataFrame, features: Sequence[str], horizons: Sequence[str] = HORIZONS, learner: Learner = Learner()) -> DataFrame:
    """A model of every series and horizon (kind ``final``) and of each fold (``return``,
    ``direction``). ``table`` comes from training_table; series with under ten rows have none."""
    features, top = list(features), learner.top
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(),
             "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64())}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in MODELS.split(", ")])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, {}
        for (asset, horizon, *segments), _, m in _read(batches):
            if now is not None and now != (asset, horizon):
                yield pa.RecordBatch.from_pylist(_models_of(*now, parts, features, top), schema=schema)
                parts = {}
            now, key = (asset, horizon), tuple(segments)
            parts[key] = parts[key] + m if key in parts else m
        if parts:
            yield pa.RecordBatch.from_pylist(_models_of(*now, parts, features, top), schema=schema)

    moments = gather_moments(table, horizons).drop("salt").withColumn("salt", F.lit(0))
    return _in_batches(moments.repartition("asset", "horizon").sortWithinPartitions(*KEYS), solve, MODELS)


# -- scores ----------------------------------------------------------------------------------


def dot(weights: Column | str, x: Column | str) -> Column:
    return F.aggregate(F.zip_with(weights, x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def _by_series(models: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """asset and a map from "horizon:fold" to the model: at most horizons x folds entries."""
    entry = F.struct(F.concat_ws(":", "horizon", "kind", F.col("fold").cast("string")),
                     F.struct("weights", "intercept", "up_weights", "up_intercept", F.col("majority").cast("double").alias("majority")))
    return models.where(F.col("kind").isin(list(kinds))).groupBy("asset").agg(F.map_from_entries(F.collect_list(entry)).alias("models"))


def _return(m: Column, x: str = "x") -> Column:
    return m["intercept"] + dot(m["weights"], x)


def _rise(m: Column, x: str = "x") -> Column:
    odds = m["up_intercept"] + dot(m["up_weights"], x)
    return F.coalesce(m["majority"], 1 / (1 + F.exp(-odds)))


def predict(models: DataFrame, df: DataFrame, features: Sequence[str], horizons: Sequence[str] = HORIZONS, only_last: bool = True) -> DataFrame:
    """Predictions of all series and horizons for their newest row (or all rows): one join.

    ``features`` as given to fit_all; a series without a model for a horizon has no rows for it.
    """
    rows = (last_row(df) if only_last else df).select("asset", "datetime", "price", vector(features).alias("x"))
    joined = rows.join(_by_series(models, ["final"]), "asset")
    per = []
    for h in horizons:
        m = F.col("models")[f"{h}:final:0"]
        per.append(F.struct(
            F.lit(h).alias("horizon"), (F.col("datetime") + F.expr(f"INTERVAL '{settings.HORIZONS[h]}' HOUR")).alias("target_timestamp"),
            _return(m).alias("predicted_return"), _rise(m).alias("p")))
    made = joined.select("asset", F.col("datetime").alias("created_at"), F.col("price").alias("current_price"), F.inline(F.array(*per)))
    return made.where("predicted_return is not null").select(
        "asset", "horizon", "created_at", "target_timestamp", "current_price",
        (F.col("current_price") * (1 + F.col("predicted_return") / 100)).alias("predicted_price"), "predicted_return",
        (F.col("p") > 0.5).cast("int").alias("predicted_direction"), F.col("p").alias("direction_confidence"),
        F.greatest("p", 1 - F.col("p")).alias("confidence"))


def training_records(models: DataFrame, table: DataFrame, horizons: Sequence[str] = HORIZONS, learner: Learner = Learner()) -> DataFrame:
    """One row per series and horizon: rows, features, errors on the training rows, mean and
    deviation of the errors of the return's folds and of the direction's accuracies. Each row
    is scored once, by the final model and by that of the one fold that tests it."""
    joined = table.join(_by_series(models, ["final", "direction"]), "asset")
    hits, aggs, per = {}, [], []
    for h in horizons:
        final, known = F.col("models")[f"{h}:final:0"], F.col(f"up_{h}").isNotNull()
        fold = F.col("models")[F.concat(F.lit(f"{h}:direction:"), F.col(f"class_fold_{h}").cast("string"))]
        hits |= {f"miss_{h}": F.when(known, F.abs(_return(final) - F.col(f"y_{h}"))),
                 f"hit_{h}": F.when(known, ((_rise(final) > 0.5) == (F.col(f"up_{h}") > 0.5)).cast("double")),
                 f"fold_hit_{h}": F.when(known & (F.col(f"class_fold_{h}") > 0), ((_rise(fold) > 0.5) == (F.col(f"up_{h}") > 0.5)).cast("double"))}
        aggs += [F.avg(f"miss_{h}").alias(f"mae_{h}"), F.avg(f"hit_{h}").alias(f"accuracy_{h}")]
        shares = [F.avg(F.when(F.col(f"class_fold_{h}") == k, F.col(f"fold_hit_{h}"))).alias(f"f{k}_{h}") for k in range(1, learner.folds + 1)]
        aggs += shares
        folds = F.array_compact(F.array(*[F.col(f"f{k}_{h}") for k in range(1, learner.folds + 1)]))
        per.append(F.struct(F.lit(h).alias("horizon"), F.col(f"mae_{h}").alias("train_mae"), F.col(f"accuracy_{h}").alias("train_accuracy"), folds.alias("folds")))
    scored = joined.select("asset", *[F.col(f"class_fold_{h}") for h in horizons], *[v.alias(k) for k, v in hits.items()])
    measured = scored.groupBy("asset").agg(*aggs).select("asset", F.inline(F.array(*per)))
    mean = F.try_divide(F.aggregate("folds", F.lit(0.0), lambda s, v: s + v), F.size("folds"))
    spread = F.aggregate(F.transform("folds", lambda v: (v - F.col("cv_accuracy_mean")) * (v - F.col("cv_accuracy_mean"))), F.lit(0.0), lambda s, v: s + v)
    measured = measured.withColumn("cv_accuracy_mean", mean).withColumn("cv_accuracy_std", F.sqrt(F.try_divide(spread, F.size("folds")))).drop("folds")
    folds = models.where("kind = 'return'").groupBy("asset", "horizon").agg(
        F.avg("error").alias("cv_mse_mean"), F.stddev_pop("error").alias("cv_mse_std"), F.count(F.lit(1)).alias("folds"))
    return models.where("kind = 'final'").select(
        "asset", "horizon", F.col("n").alias("training_samples"), F.size("chosen").alias("features_used"),
        F.col("error").alias("train_mse"), (F.least("ups", F.col("n") - F.col("ups")) / F.col("n")).alias("minority_share"),
        F.col("majority").isNotNull().alias("majority_only")).join(folds, ["asset", "horizon"]).join(measured, ["asset", "horizon"])


def train(
    df: DataFrame, features: Sequence[str], horizons: Sequence[str] = HORIZONS, learner: Learner = Learner(), since: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(models, training records) of all series in ``df``; the models are a written table."""
    table = staged(training_table(df, features, horizons, learner, since=since), "training")
    models = staged(fit_all(table, features, horizons, learner), "models")
    return models, training_records(models, table, horizons, learner)
