"""Accuracy tables from evaluations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidebar import settings
from tidebar.functions.scalars import age_text, quality_band, stars
from tidebar.operators.percentiles import exact_percentiles
from tidebar.operators.series import chunked
from tidebar.operators.versions import latest_per_key
from tidebar.plans.matching import horizon_rank, pending
from tidebar.session import staged

TARGET_KEY = ["target_timestamp", "horizon", "asset"]
# The reported percentiles.
PERCENTILES = {"p01": 0.01, "p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90, "p99": 0.99}


def since(evaluations: DataFrame, as_of: Column, days: int) -> DataFrame:
    start = as_of - F.expr(f"INTERVAL '{days}' DAY")
    return evaluations.where(F.col("evaluation_timestamp") >= start)


def newest_evaluations(evaluations: DataFrame) -> DataFrame:
    """One evaluation per target time, horizon and asset."""
    return latest_per_key(evaluations, TARGET_KEY, ["evaluation_timestamp", "prediction_id"])


def _errors() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_predictions"),
        F.avg("absolute_error").alias("mean_absolute_error"),
        F.avg("percent_error").alias("mean_percent_error"),
        F.stddev_samp("percent_error").alias("std_percent_error"),
        F.sqrt(F.avg(F.col("absolute_error") * F.col("absolute_error"))).alias("root_mean_squared_error"),
        F.avg("direction_correct").alias("direction_accuracy"),
        F.min("absolute_error").alias("min_error"),
        F.max("absolute_error").alias("max_error"),
    ]


def accuracy_metrics(
    evaluations: DataFrame, keys: tuple[str, ...] = ("asset", "horizon"), deduplicated: bool = False
) -> DataFrame:
    """All error measures per group, with exact medians and percentiles."""
    rows = evaluations if deduplicated else staged(newest_evaluations(evaluations), "newest")
    keys = list(keys)
    base = rows.groupBy(*keys).agg(*_errors())
    # Both measures in one run, the measure being one more key.
    both = F.array(*[F.struct(F.lit(n).alias("_measure"), F.col(n).alias("_error")) for n in ("percent_error", "absolute_error")])
    found = exact_percentiles(rows.select(*keys, F.inline(both)), [*keys, "_measure"], "_error", list(PERCENTILES.values()), "_p")
    of = lambda measure, i: F.max(F.when(F.col("_measure") == measure, F.col("_p")[i]))
    middle = list(PERCENTILES).index("p50")
    wide = found.groupBy(*keys).agg(
        *[of("percent_error", i).alias(f"percent_error_{n}") for i, n in enumerate(PERCENTILES)],
        of("percent_error", middle).alias("median_percent_error"),
        of("absolute_error", middle).alias("median_absolute_error"),
    )
    return base.join(wide, keys)


def accuracy_by_period(evaluations: DataFrame, days: int = 7) -> DataFrame:
    """The measures per asset, horizon and period of ``days`` days."""
    rows = newest_evaluations(evaluations).withColumn(
        "_w", F.window(F.col("evaluation_timestamp"), f"{days} days")
    )
    rows = staged(
        rows.withColumns(
            {"period_start": F.col("_w.start").cast("timestamp_ntz"), "period_end": F.col("_w.end").cast("timestamp_ntz")}
        ).drop("_w"),
        "by-period",
    )
    return accuracy_metrics(rows, ("asset", "horizon", "period_start", "period_end"), deduplicated=True)


def timeseries_view(evaluations: DataFrame) -> DataFrame:
    """One row per asset and target time, one column per measure and horizon."""
    horizons = list(settings.HORIZONS)
    measures = {
        "predicted_price": "predicted_price",
        "actual_price": "actual_price",
        "absolute_error": "error",
        "percent_error": "percent_error",
    }
    wide = (
        newest_evaluations(evaluations)
        .groupBy("asset", F.col("target_timestamp").alias("timestamp"))
        .pivot("horizon", horizons)
        .agg(*[F.first(m, ignorenulls=True).alias(out) for m, out in measures.items()])
    )
    names = {f"{h}_{out}": f"{out}_{h}" for h in horizons for out in measures.values()}
    wide = wide.withColumnsRenamed(names)
    return wide.withColumn("actual_price", F.coalesce(*[F.col(f"actual_price_{h}") for h in horizons]))


def latest_evaluation(evaluations: DataFrame) -> DataFrame:
    """Per asset and horizon the newest evaluation: its target time and percent error."""
    order = F.struct("evaluation_timestamp", "target_timestamp", "prediction_id")
    return newest_evaluations(evaluations).groupBy("asset", "horizon").agg(
        F.max_by("target_timestamp", order).alias("target_timestamp"),
        F.max_by("percent_error", order).alias("percent_error"),
    )


def scoreboard(evaluations: DataFrame, as_of: Column) -> DataFrame:
    """The newest evaluation per asset and horizon, judged and dated."""
    order = F.struct("evaluation_timestamp", "target_timestamp", "prediction_id")
    newest = evaluations.groupBy("asset", "horizon").agg(
        F.count(F.lit(1)).alias("evaluations"),
        F.max_by(
            F.struct(
                "predicted_price", "actual_price", "absolute_error", "percent_error",
                "direction_correct", "confidence", "evaluation_timestamp",
            ),
            order,
        ).alias("_e"),
    )
    return newest.select("asset", "horizon", "evaluations", "_e.*").withColumns(
        {
            "quality": quality_band("percent_error"),
            "stars": stars("confidence"),
            "age": age_text(as_of, F.col("evaluation_timestamp")),
        }
    )


def asset_summary(evaluations: DataFrame) -> DataFrame:
    return evaluations.groupBy("asset").agg(
        F.count(F.lit(1)).alias("evaluations"),
        F.avg("percent_error").alias("mean_percent_error"),
        (F.avg("direction_correct") * 100).alias("direction_percent"),
    )


def backlog(predictions: DataFrame, evaluations: DataFrame, as_of: Column) -> DataFrame:
    """Predictions still waiting, per asset and horizon, and for how long."""
    waiting = pending(predictions, evaluations).groupBy("asset", "horizon").agg(
        F.count(F.lit(1)).alias("waiting"),
        F.min("created_at").alias("oldest"),
        F.max("created_at").alias("newest"),
    )
    hours = F.timestamp_diff("MICROSECOND", F.col("oldest"), as_of) / 3_600_000_000
    return waiting.withColumn("hours_waiting", hours)


def prediction_counts(predictions: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Predictions of the last hours and their confidence: in total and per group."""
    recent = predictions.where(F.col("created_at") >= as_of - F.expr(f"INTERVAL '{hours}' HOUR"))
    pairs = recent.groupingSets([[], [F.col("asset"), F.col("horizon")]], "asset", "horizon")
    return pairs.agg(
        F.count(F.lit(1)).alias("predictions"), F.avg("confidence").alias("mean_confidence")
    )


def histogram(evaluations: DataFrame, measure: str, keys: Sequence[str] = ("horizon",)) -> DataFrame:
    """Counts per bin and key; the bin width follows the range of the key's errors.

    The last bin includes its right edge. Without the asset among ``keys`` all series are pooled.
    """
    keys = list(keys)
    # Fixed values: (range below, bin width) and the width beyond the last range.
    steps, beyond = {
        "percent_error": (((0.1, 0.01), (1, 0.1), (5, 0.25), (10, 0.5)), 1.0),
        "absolute_error": (((10, 1.0), (100, 5.0), (500, 25.0), (1000, 50.0)), 100.0),
    }[measure]
    span = F.col("_high") - F.col("_low")
    width = F.when(span < steps[0][0], F.lit(steps[0][1]))
    for below, value in steps[1:]:
        width = width.when(span < below, F.lit(value))
    ranges = (
        evaluations.groupBy(*keys)
        .agg(F.min(measure).alias("_low"), F.max(measure).alias("_high"))
        .withColumn("bin_width", width.otherwise(F.lit(beyond)))
        .withColumn("_start", F.floor(F.col("_low") / F.col("bin_width")) * F.col("bin_width"))
    )
    start, size = F.col("_start"), F.col("bin_width")
    last = F.greatest(F.ceil((F.col("_high") - start) / size - 1e-9) - 1, F.lit(0))
    place = F.least(F.floor((F.col(measure) - start) / size), last)
    return (
        evaluations.join(staged(ranges, "error-ranges"), keys)
        .groupBy(*keys, "bin_width", start.alias("start"), place.alias("bin"))
        .agg(F.count(F.lit(1)).alias("frequency"))
        .select(
            *keys,
            "bin_width",
            F.col("bin"),
            (F.col("start") + F.col("bin") * F.col("bin_width")).alias("bin_start"),
            "frequency",
        )
    )


def distribution(evaluations: DataFrame, measure: str, keys: Sequence[str] = ("horizon",)) -> DataFrame:
    """Quartiles, mean, deviation and size per key; Without the asset among ``keys`` all series are pooled."""
    keys = list(keys)
    base = evaluations.groupBy(*keys).agg(
        F.avg(measure).alias("mean"), F.stddev_samp(measure).alias("std"), F.count(F.lit(1)).alias("n")
    )
    quartiles = exact_percentiles(evaluations, keys, measure, [0.25, 0.5, 0.75], "_q")
    return base.join(quartiles, keys).select(
        *keys, "mean", "std", "n",
        F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("q50"), F.col("_q")[2].alias("q75"),
    )


def rolling_direction_accuracy(evaluations: DataFrame, last: int = 5) -> DataFrame:
    """Share of right directions among the last evaluations, and over all of them."""
    newest = staged(newest_evaluations(evaluations), "newest")
    halo = -(-last // settings.BLOCK_ROWS) * settings.BLOCK_ROWS
    series = chunked(newest, keys=("asset", "horizon"), order="target_timestamp", halo_rows=halo)
    rolling = F.avg("direction_correct").over(series.last_rows(last))
    rows = series.with_columns({"rolling_accuracy": rolling}).rows(
        "asset", "horizon", "target_timestamp", "direction_correct", "rolling_accuracy"
    )
    overall = newest.groupBy("asset").agg(F.avg("direction_correct").alias("overall_accuracy"))
    return rows.join(overall, "asset")


def report(metrics: DataFrame, assets: DataFrame) -> DataFrame:
    """One line per asset and horizon, also where there is nothing to report."""
    horizons = F.explode(F.array(*[F.lit(h) for h in settings.HORIZONS])).alias("horizon")
    grid = assets.select("asset").distinct().select("asset", horizons)
    filled = grid.join(metrics, ["asset", "horizon"], "left")
    line = F.when(
        F.col("total_predictions") > 0,
        F.format_string(
            "%s %s: n=%d MAE=%.2f MPE=%.2f%% direction=%.2f%% RMSE=%.2f range=%.2f..%.2f",
            "asset", "horizon", "total_predictions", "mean_absolute_error", "mean_percent_error",
            F.col("direction_accuracy") * 100, "root_mean_squared_error", "min_error", "max_error",
        ),
    ).otherwise(F.format_string("%s %s: no data available", "asset", "horizon"))
    return filled.select("asset", "horizon", horizon_rank().alias("position"), line.alias("line"))
