"""One round of predicting, and one of evaluating, over the stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidebar.functions.clock import minutes
from tidebar.plans import accuracy, flow, learning, matching, model_store
from tidebar.session import scratch_scope, staged
from tidebar.sources.bars import lookback
from tidebar.sources.tables import Store


def prediction_round(
    store: Store, models: dict | DataFrame, as_of: Column, days: int = 30, features: DataFrame | None = None
) -> DataFrame:
    """Features of the last days, one prediction per model, appended to the table.

    ``models``: fitted trees by (series, horizon), or rows of the model registry.
    ``features``: feature rows to use instead of making them from the stored bars.
    """
    if features is None:
        bars = staged(store.lookback("bars", as_of, days), "recent-bars")
        features = staged(flow.prepare_features(bars), "prepared")
    predicted = model_store.predict if isinstance(models, DataFrame) else learning.predict_all
    made = predicted(models, features)
    rows = staged(
        made.withColumn("prediction_id", matching.prediction_key()).select(
            "prediction_id", "asset", "horizon", "predicted_price", "confidence", "target_timestamp", "created_at"
        ),
        "new-predictions",
    )
    # The key holds the creation time, so equal keys are found among those times.
    first, last = rows.agg(F.min("created_at"), F.max("created_at")).first()
    made_then = store.read("predictions", F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz"))
    store.append("predictions", matching.pending(rows, made_then))
    return rows


def tracking_round(store: Store, as_of: Column, now: DataFrame | None = None, price_days: int | None = None) -> None:
    """The current prices into the timeseries and the price table, with the predictions
    old enough to be compared. Every series takes part with its newest price; ``price_days``
    leaves out those without a bar for so long. Stored rows are read as far back as the
    longest horizon and the oldest comparable prediction, however long the history is."""
    with scratch_scope(store.spark):
        if now is None:
            now = store.prices_at(as_of)
            if price_days is not None:
                now = lookback(now, as_of, price_days)
        _track(store, as_of, now)


def _track(store: Store, as_of: Column, prices: DataFrame) -> None:
    current = prices.select("asset", as_of.alias("timestamp"), F.col("price").alias("actual_price"))
    wide = (
        matching.comparable_predictions(store.read("predictions", as_of - minutes(matching.COMPARABLE_MINUTES), as_of), as_of)
        .groupBy("asset")
        .pivot("horizon", ["1h", "1d", "1w"])
        .agg(F.max("predicted_price"))
        .withColumnsRenamed({h: f"predicted_price_{h}" for h in ("1h", "1d", "1w")})
    )
    observed = staged(current.join(wide, "asset", "left"), "observed")
    # The new rows are computed next to the stored ones, which they look back on.
    earlier = store.read("timeseries", as_of - minutes(matching.EARLIER_MINUTES), as_of).where(F.col("timestamp") < as_of)
    rows = earlier.select(*observed.columns).unionByName(observed)
    series = matching.prediction_timeseries(rows, store.keep_tracked(observed), F.col("timestamp") == as_of)
    store.upsert("timeseries", series)
    store.upsert(
        "actual_prices",
        current.select("asset", F.col("timestamp").alias("target_timestamp"), "actual_price", as_of.alias("collected_at")),
    )


def evaluation_round(store: Store, as_of: Column, fetched: DataFrame | None = None) -> DataFrame:
    """Evaluate what is due, keep the evaluations and the prices that were found."""
    bars = store.lookback("bars", as_of, matching.REACH_DAYS)
    # An evaluation and a target come after their prediction, so all of them lie in the reach of what is due.
    since = as_of - minutes(matching.DUE_MINUTES)
    rows = staged(
        matching.evaluate_due(
            store.read("predictions", since, as_of), store.read("evaluations", since),
            store.read("actual_prices", since - F.expr(f"INTERVAL '{matching.STORED_TOLERANCE}' SECOND")), bars,
            fetched if fetched is not None else bars, as_of,
        ),
        "evaluated",
    )
    store.append("evaluations", rows)
    store.upsert(
        "actual_prices", rows.select("asset", "target_timestamp", "actual_price", as_of.alias("collected_at"))
    )
    return rows


def accuracy_round(store: Store, as_of: Column, days: int = 7) -> DataFrame:
    """The accuracy report of the last days, for every series with bars."""
    recent = accuracy.since(store.read("evaluations", as_of - F.expr(f"INTERVAL '{days}' DAY")), as_of, days)
    return accuracy.report(accuracy.accuracy_metrics(recent), store.read("newest_prices"))


def run_round(
    store: Store, as_of: Column, features: DataFrame, names: Sequence[str], horizons: Sequence[str] = model_store.HORIZONS,
    learner: learning.Learner = learning.Learner(), force: bool = False,
) -> DataFrame:
    """One whole round: train or load, predict, evaluate what is due, track, and report.

    ``features``: the feature rows up to ``as_of``, with targets where they are known.
    """
    models = staged(model_store.train_or_load(store, features, names, as_of, horizons, learner, force=force), "usable")
    prediction_round(store, models, as_of, features=features)
    evaluation_round(store, as_of)
    tracking_round(store, as_of)
    return accuracy_round(store, as_of)
