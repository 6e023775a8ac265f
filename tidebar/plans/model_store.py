"""The stored registry of models: versions, states, promotion, train or load, whole rounds.

A model is a row (its weights are part of it), so the registry is a table like the others:
training appends candidates, promotion appends the candidate again as production, and nothing
is ever changed in place. A run that is repeated finds its models and trains nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidebar import settings
from tidebar.operators.versions import latest_per_key
from tidebar.plans import backtest, learning, linear
from tidebar.plans.learning import Learner
from tidebar.session import staged
from tidebar.sources.tables import Store

TABLE = "models"
CANDIDATE, PRODUCTION = "candidate", "production"
HORIZONS = tuple(settings.HORIZONS)
NEWEST = ["version", "state", "trained_at"]  # a promoted model comes after its candidate


def register(
    store: Store, models: DataFrame, records: DataFrame, features: Sequence[str], trained_at: Column,
    state: str = CANDIDATE, windows: DataFrame | None = None,
) -> DataFrame:
    """Append the final models as the next versions of their series and horizons."""
    last = store.read(TABLE).groupBy("asset", "horizon").agg(F.max("version").alias("last"))
    kept = ["train_mse", "train_mae", "train_accuracy", "cv_mse_mean", "cv_mse_std", "cv_accuracy_mean", "cv_accuracy_std", "minority_share"]
    rows = models.where("kind = 'final'").select(
        "asset", "horizon", F.col("n").alias("training_samples"), F.array(*map(F.lit, features)).alias("features"), "chosen",
        "weights", "intercept", "up_weights", "up_intercept", "majority")
    rows = rows.join(records.select("asset", "horizon", *kept), ["asset", "horizon"], "left").join(last, ["asset", "horizon"], "left")
    if windows is not None:
        rows = rows.join(windows.select("asset", "horizon", F.col("window_name").alias("training_window"),
                                        F.col("train_days").alias("training_days"), "expected_error"), ["asset", "horizon"], "left")
    rows = staged(rows.withColumn("version", F.coalesce("last", F.lit(0)) + 1).withColumn("state", F.lit(state))
                  .withColumn("trained_at", trained_at), "registered")
    store.append(TABLE, rows)
    return rows


def newest(store: Store, state: str | None = None) -> DataFrame:
    """The newest version of each series and horizon, of one state or of any."""
    rows = store.read(TABLE)
    return latest_per_key(rows if state is None else rows.where(F.col("state") == state), ["asset", "horizon"], NEWEST)


def promote(store: Store, at: Column) -> DataFrame:
    """Newest candidates become production where there is none yet or their folds' error is
    lower. One append; a second call finds nothing to do."""
    current = newest(store, PRODUCTION).select("asset", "horizon", F.col("version").alias("old"), F.col("cv_mse_mean").alias("old_error"))
    better = newest(store, CANDIDATE).join(current, ["asset", "horizon"], "left").where(
        "old is null or (version > old and cv_mse_mean < old_error)")
    rows = staged(better.drop("old", "old_error").withColumn("state", F.lit(PRODUCTION)).withColumn("trained_at", at), "promoted")
    store.append(TABLE, rows)
    return rows


def usable(store: Store) -> DataFrame:
    """What predictions use: the production model, else the newest candidate."""
    ranked = store.read(TABLE).withColumn("_rank", F.struct((F.col("state") == PRODUCTION).alias("p"), *NEWEST))
    return latest_per_key(ranked, ["asset", "horizon"], ["_rank"]).drop("_rank")


def due(store: Store, df: DataFrame, as_of: Column, horizons: Sequence[str] = HORIZONS,
        hours: int = settings.RETRAIN_HOURS, force: bool = False) -> DataFrame:
    """(asset, horizon) without a production model and without a candidate younger than ``hours``."""
    wanted = df.select("asset").distinct().select("asset", F.explode(F.array(*map(F.lit, horizons))).alias("horizon"))
    if not force:
        wanted = wanted.join(newest(store, PRODUCTION), ["asset", "horizon"], "left_anti")
    return learning.due_for_training(wanted, store.read(TABLE).select("asset", "horizon", "trained_at"), as_of, hours, force)


def _since(pairs: DataFrame, horizons: Sequence[str], first: Column) -> DataFrame:
    """One row per series with the first row number of each wanted horizon."""
    return pairs.groupBy("asset").agg(*[F.max(F.when(F.col("horizon") == h, first)).alias(f"from_{h}") for h in horizons])


def train_or_load(
    store: Store, df: DataFrame, features: Sequence[str], as_of: Column, horizons: Sequence[str] = HORIZONS,
    learner: Learner = Learner(), hours: int = settings.RETRAIN_HOURS, force: bool = False,
) -> DataFrame:
    """Models of all series and horizons in ``df``: production ones as they are, recent
    candidates as they are, and the rest trained now (all, if ``force``). One pass trains
    whatever is due; without anything due no row is read."""
    wanted = staged(due(store, df, as_of, horizons, hours, force), "due")
    if not wanted.isEmpty():
        models, records = linear.train(df, features, horizons, learner, since=_since(wanted, horizons, F.lit(0)))
        register(store, models, records, features, as_of)
    return usable(store)


def production_training(
    store: Store, df: DataFrame, features: Sequence[str], best: DataFrame, trained_at: Column,
    horizons: Sequence[str] = HORIZONS, learner: Learner = Learner(),
) -> DataFrame:
    """Fit each series and horizon on the tail of its best window and register it as production.

    ``best``: asset, horizon, window_name, train_days, expected_error; pairs without are left out.
    """
    tails = best.join(backtest.sizes(df), "asset")
    first = F.greatest(F.col("n") - F.col("train_days") * backtest.DAY, F.lit(0))
    models, records = linear.train(df, features, horizons, learner, since=_since(tails, horizons, first))
    return register(store, models, records, features, trained_at, PRODUCTION, best)


def feature_order(models: DataFrame) -> list[str]:
    """The feature list that the weights follow; all models of a round share one."""
    lists = [r[0] for r in models.select("features").distinct().limit(2).collect()]
    if len(lists) != 1:
        raise ValueError("models of different feature lists can't score together" if lists else "no models")
    return list(lists[0])


def predict(models: DataFrame, df: DataFrame, horizons: Sequence[str] = HORIZONS, only_last: bool = True) -> DataFrame:
    """Predictions by rows of the registry, one per series and horizon."""
    final = models.withColumn("kind", F.lit("final")).withColumn("fold", F.lit(0))
    return linear.predict(final, df, feature_order(models), horizons, only_last)
