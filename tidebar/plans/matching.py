"""Predictions meet the prices that arrive later.

Predictions: prediction_id, asset, horizon, predicted_price, confidence,
target_timestamp, created_at. Every "now" is the parameter ``as_of``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidebar import settings
from tidebar.functions.clock import micros_between, minutes
from tidebar.functions.scalars import div, flag
from tidebar.operators.nearest import Facts, nearest, nearest_of_each
from tidebar.sources.bars import latest_price

# Fixed values, in minutes: when a prediction of each horizon is due (age and how far
# from it), the ages at which it may be compared with the current price, and the age
# from which a rough check is made.
DUE = {"1h": (60, 3), "1d": (1440, 60), "1w": (10080, 720)}
COMPARABLE = {"1h": (50, 240), "1d": (1200, 2880), "1w": (8640, 20160)}
ROUGH_AGE = {"1h": 50, "1d": 1200, "1w": 8640}

START_TOLERANCE = 30 * 60
STORED_TOLERANCE = 6 * 60
BAR_TOLERANCE = 30 * 60
FETCHED_TOLERANCE = 2 * 3600
# Fixed values, in seconds: how near the earlier prediction must lie, per horizon.
EARLIER_TOLERANCE = {"1h": 600, "1d": 3600, "1w": 43200}

MINUTE = 60_000_000
# How old a prediction may be that is due, and one that is compared with the current price; how far a
# timeseries row looks back.
DUE_MINUTES = max(a + s for a, s in DUE.values())
COMPARABLE_MINUTES = max(b for _, b in COMPARABLE.values())
EARLIER_MINUTES = max(hours * 60 + EARLIER_TOLERANCE[h] // 60 for h, hours in settings.HORIZONS.items())
# How far back the prices of a due prediction lie: the oldest creation time and the widest tolerance.
REACH_DAYS = -(-(DUE_MINUTES * 60 + max(START_TOLERANCE, BAR_TOLERANCE, FETCHED_TOLERANCE)) // 86400)


def by_horizon(values: dict, horizon: str = "horizon") -> Column:
    out = None
    for h, v in values.items():
        out = F.when(F.col(horizon) == h, F.lit(v)) if out is None else out.when(F.col(horizon) == h, F.lit(v))
    return out


def horizon_rank(horizon: str = "horizon") -> Column:
    return by_horizon({h: i for i, h in enumerate(settings.HORIZONS, 1)}, horizon)


def prediction_key(asset: str = "asset", horizon: str = "horizon", created: str = "created_at") -> Column:
    """A key that a rerun gives again."""
    return F.concat_ws("|", asset, horizon, F.date_format(created, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def pending(predictions: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Predictions without an evaluation."""
    return predictions.join(evaluations.select("prediction_id"), "prediction_id", "left_anti")


def due_predictions(predictions: DataFrame, evaluations: DataFrame, as_of: Column) -> DataFrame:
    """Per asset and horizon the pending prediction made nearest to one horizon ago."""
    age = micros_between("created_at", as_of)
    wanted = by_horizon({h: a * MINUTE for h, (a, _) in DUE.items()})
    slack = by_horizon({h: s * MINUTE for h, (_, s) in DUE.items()})
    recent = predictions.where(F.col("created_at") >= as_of - minutes(DUE_MINUTES))
    near = pending(recent.where(F.abs(age - wanted) <= slack), evaluations)
    # Nearest first; of equally near ones the newest, which is the younger one.
    best = F.min_by(F.struct(*predictions.columns), F.struct(F.abs(age - wanted), age, F.col("prediction_id")))
    return near.groupBy("asset", "horizon").agg(best.alias("_p")).select("_p.*")


def comparable_predictions(predictions: DataFrame, as_of: Column) -> DataFrame:
    """Per asset and horizon the newest prediction old enough to be compared now."""
    age = micros_between("created_at", as_of)
    youngest = by_horizon({h: a * MINUTE for h, (a, _) in COMPARABLE.items()})
    oldest = by_horizon({h: b * MINUTE for h, (_, b) in COMPARABLE.items()})
    return (
        predictions.where(age.between(youngest, oldest))
        .groupBy("asset", "horizon")
        .agg(
            F.max_by("predicted_price", F.struct("created_at", "prediction_id")).alias("predicted_price"),
            F.max("created_at").alias("created_at"),
        )
    )


def recent_against_latest(
    predictions: DataFrame, bars: DataFrame, as_of: Column, limit: int = 100
) -> DataFrame:
    """The newest predictions older than an hour, against the newest price."""
    old = predictions.where(F.col("created_at") <= as_of - F.expr("INTERVAL '1' HOUR"))
    newest = old.orderBy(F.desc("created_at"), "asset", horizon_rank(), "prediction_id").limit(limit)
    age = micros_between("created_at", as_of)
    ripe = newest.where(age >= by_horizon({h: m * MINUTE for h, m in ROUGH_AGE.items()}))
    prices = latest_price(bars).select("asset", F.col("price").alias("actual_price"))
    return ripe.join(prices, "asset").select(
        "asset",
        "horizon",
        "created_at",
        "predicted_price",
        "actual_price",
        (div(F.col("predicted_price") - F.col("actual_price"), "actual_price") * 100).alias("predicted_return"),
        "confidence",
        (age / MINUTE).alias("age_minutes"),
    )


def resolve_actual_price(
    asked: DataFrame, stored: DataFrame, bars: DataFrame, fetched: DataFrame, latest: DataFrame, as_of: Column
) -> DataFrame:
    """The actual price at ``target_timestamp``, and where it came from.

    In order: a stored price within 6 minutes, a bar within 30 minutes, for targets 1 to
    168 hours old a fetched price within 2 hours, for targets under an hour old the
    current price.
    """
    step = nearest_of_each(
        asked,
        [
            Facts(stored, "target_timestamp", {"_stored": "actual_price"}, STORED_TOLERANCE),
            Facts(bars, "datetime", {"_bar": "price"}, BAR_TOLERANCE),
            Facts(fetched, "datetime", {"_fetched": "price"}, FETCHED_TOLERANCE, inclusive=True),
        ],
        keys=["asset"], probe_ts="target_timestamp",
    )
    now = latest.select("asset", F.col("price").alias("_now"))
    hours = F.abs(micros_between("target_timestamp", as_of)) / (60 * MINUTE)
    options = {
        "stored": F.col("_stored"),
        "bar": F.col("_bar"),
        "fetched": F.when(hours.between(1, 168), F.col("_fetched")),
        "current": F.when(hours < 1, F.col("_now")),
    }
    source = F.coalesce(*[F.when(v.isNotNull(), F.lit(n)) for n, v in options.items()])
    return (
        step.join(now, "asset", "left")
        .withColumns({"actual_price": F.coalesce(*options.values()), "price_source": source})
        .drop("_stored", "_bar", "_fetched", "_now")
    )


def with_start_price(rows: DataFrame, bars: DataFrame) -> DataFrame:
    """The price when the prediction was made, from the nearest bar."""
    return nearest(
        rows, bars, keys=["asset"], probe_ts="created_at", fact_ts="datetime",
        values={"start_price": "price"}, tolerance_seconds=START_TOLERANCE,
    )


def evaluate(rows: DataFrame, evaluated_at: Column) -> DataFrame:
    """Errors and directions of predictions with actual_price and start_price.

    Without a start price the prediction counts as "up" and is right when the actual
    price lies above the predicted one.
    """
    predicted, actual, start = F.col("predicted_price"), F.col("actual_price"), F.col("start_price")
    error = F.abs(predicted - actual)
    up = F.when(start.isNull(), F.lit(1)).otherwise(flag(predicted > start))
    went_up = F.when(start.isNull(), flag(actual > predicted)).otherwise(flag(actual > start))
    return rows.where(actual.isNotNull()).select(
        "prediction_id",
        "asset",
        "horizon",
        "predicted_price",
        "actual_price",
        error.alias("absolute_error"),
        F.when(actual != 0, error / actual * 100).otherwise(F.lit(0.0)).alias("percent_error"),
        (error * error).alias("squared_error"),
        up.alias("direction_predicted"),
        went_up.alias("direction_actual"),
        flag(up == went_up).alias("direction_correct"),
        F.col("created_at").alias("prediction_timestamp"),
        evaluated_at.alias("evaluation_timestamp"),
        "target_timestamp",
        "confidence",
    )


def evaluate_due(
    predictions: DataFrame,
    evaluations: DataFrame,
    stored: DataFrame,
    bars: DataFrame,
    fetched: DataFrame,
    as_of: Column,
) -> DataFrame:
    """One evaluation round: due predictions, their actual and start prices, errors."""
    due = due_predictions(predictions, evaluations, as_of)
    priced = resolve_actual_price(due, stored, bars, fetched, latest_price(bars), as_of)
    return evaluate(with_start_price(priced, bars), as_of)


def evaluate_all(predictions: DataFrame, bars: DataFrame, evaluated_at: Column) -> DataFrame:
    """Every prediction whose target time has a bar: a backfill of evaluations."""
    priced = nearest(
        predictions, bars, keys=["asset"], probe_ts="target_timestamp", fact_ts="datetime",
        values={"actual_price": "price"}, tolerance_seconds=BAR_TOLERANCE,
    ).where(F.col("actual_price").isNotNull())
    return evaluate(with_start_price(priced, bars), evaluated_at)


def prediction_timeseries(observed: DataFrame, starts: DataFrame | None = None, wanted: Column | None = None) -> DataFrame:
    """Actual prices with each horizon's prediction, and the error of the prediction
    made one horizon earlier.

    ``observed``: asset, timestamp, actual_price and predicted_price_{1h,1d,1w}. Longer
    horizons count only once the series itself is that old. ``starts``: asset and
    tracked_since, where ``observed`` does not go back to the start; ``wanted``: which rows
    to give, all by default.
    """
    if starts is None:
        starts = observed.groupBy("asset").agg(F.min("timestamp").alias("tracked_since"))
    starts = starts.select("asset", F.col("tracked_since").alias("_start"))
    age = micros_between("_start", "timestamp")
    rows = observed.join(starts, "asset")
    gates = {"1h": None, "1d": 1440 * MINUTE, "1w": 10080 * MINUTE}
    kept = {
        f"predicted_price_{h}": F.when(age >= gate, F.col(f"predicted_price_{h}"))
        for h, gate in gates.items()
        if gate
    }
    series = rows.withColumns(kept).drop("_start")
    earlier = [
        Facts(
            series, "timestamp", {f"_old_{h}": f"predicted_price_{h}"}, EARLIER_TOLERANCE[h],
            later_seconds=bars * 3_600,
        )
        for h, bars in settings.HORIZONS.items()
    ]
    asked = series if wanted is None else series.where(wanted)
    out = nearest_of_each(asked, earlier, keys=["asset"], probe_ts="timestamp")
    for h in settings.HORIZONS:
        error = F.when(
            F.col(f"predicted_price_{h}").isNotNull(), F.abs(F.col(f"_old_{h}") - F.col("actual_price"))
        )
        out = out.withColumn(f"error_{h}", error)
        out = out.withColumn(f"percent_error_{h}", div(F.col(f"error_{h}"), "actual_price") * 100)
        out = out.drop(f"_old_{h}")
    return out
