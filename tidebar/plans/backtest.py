"""Walk-forward backtests over numbered rows (``_rn`` from 0 per series)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, functions as F

from tidebar import settings
from tidebar.operators.series import chunked
from tidebar.operators.versions import even_sample
from tidebar.plans import learning
from tidebar.plans.learning import relative_error
from tidebar.session import staged

DAY = 24


def sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("asset").agg((F.max("_rn") + 1).alias("n"))


def time_splits(lengths: DataFrame, train_days: int = 90, step_days: int = 7, min_future_days: int = 8) -> DataFrame:
    """Training ends every ``step_days`` as long as enough future remains."""
    train, step, future = train_days * DAY, step_days * DAY, min_future_days * DAY
    last = F.col("n") - future - 1
    ends = F.when(last >= train, F.sequence(F.lit(train).cast("long"), last, F.lit(step).cast("long")))
    return lengths.select("asset", F.explode(ends).alias("train_end")).select(
        "asset",
        (F.col("train_end") - train).alias("train_start"),
        "train_end",
        F.col("train_end").alias("test_start"),
    )


def window_splits(
    lengths: DataFrame, windows: dict[str, int] = settings.TRAINING_WINDOWS, runs: int = 20
) -> DataFrame:
    """For each training window up to ``runs`` evenly spread splits, one day apart."""
    out = None
    for place, (name, days) in enumerate(windows.items()):
        part = time_splits(lengths, days, step_days=1).select(
            F.lit(name).alias("window_name"), F.lit(place).alias("window_place"), F.lit(days).alias("train_days"), "*"
        )
        out = part if out is None else out.unionByName(part)
    return even_sample(out, ["window_name", "asset"], "train_end", runs)


def day_sums(rows: DataFrame, feature: str) -> DataFrame:
    """Per series and day of 24 rows what a one-feature regression needs.

    One pass with partial aggregation; a training slice is then a sum over days, so no
    row is copied once per split it belongs to.
    """
    x = F.coalesce(F.col(feature), F.lit(0.0))
    aggs = [
        F.count(F.lit(1)).alias("rows"),
        F.min("price").alias("low"),
        F.max("price").alias("high"),
        F.max_by("price", "_rn").alias("last_price"),
        F.max_by(x, "_rn").alias("last_x"),
    ]
    for h in settings.HORIZONS:
        y, known = F.col(f"target_return_{h}"), F.col(f"target_return_{h}").isNotNull()
        xk = F.when(known, x)
        aggs += [
            F.count(y).alias(f"n_{h}"),
            F.sum(xk).alias(f"x_{h}"),
            F.sum(y).alias(f"y_{h}"),
            F.sum(xk * xk).alias(f"xx_{h}"),
            F.sum(xk * y).alias(f"xy_{h}"),
            F.sum((y > 0).cast("int")).alias(f"up_{h}"),
            F.min(f"target_{h}").alias(f"tmin_{h}"),
            F.max(f"target_{h}").alias(f"tmax_{h}"),
        ]
    return rows.groupBy("asset", F.floor(F.col("_rn") / DAY).alias("_rn")).agg(*aggs)


def slice_statistics(days: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """For every day and each of the lengths the sums over the days that end with it.

    All frames share one partitioning and order, so there is one exchange and one sort.
    """
    halo = -(-max(lengths) // settings.BLOCK_ROWS) * settings.BLOCK_ROWS
    series = chunked(days, order="_rn", halo_rows=halo, numbered=True)
    whole = {"rows": F.sum, "low": F.min, "high": F.max}
    for h in settings.HORIZONS:
        whole |= {f"{n}_{h}": F.sum for n in ("n", "x", "y", "xx", "xy", "up")}
        whole |= {f"tmin_{h}": F.min, f"tmax_{h}": F.max}
    # One select: every output reads the daily sums, none reads another output.
    names = [F.col(n) for n in ("asset", "_rn", "_own", "last_price", "last_x")]
    out = [f(n).over(series.last_rows(k)).alias(f"{n}_in_{k}") for k in lengths for n, f in whole.items()]
    wide = series.df.select(*names, *out).where("_own")
    per_length = [F.struct(F.lit(k).alias("train_days"), *[F.col(f"{n}_in_{k}").alias(n) for n in whole]) for k in lengths]
    return wide.select("asset", "last_price", "last_x", ((F.col("_rn") + 1) * DAY).alias("train_end"), F.inline(F.array(*per_length)))


def sufficient(h: str) -> Column:
    """Enough rows, some movement of the price, and two different targets."""
    return (F.col("rows") >= 50) & (F.col("high") > F.col("low")) & (F.col(f"tmin_{h}") < F.col(f"tmax_{h}"))


def split_statistics(rows: DataFrame, splits: DataFrame, feature: str) -> DataFrame:
    """Each split with the sums of its training slice; ``splits`` has train_days."""
    days = staged(day_sums(rows, feature), "day-sums")
    # At most one entry per training window; without any split the result is empty.
    lengths = sorted(r["train_days"] for r in splits.select("train_days").distinct().collect()) or [1]
    return splits.join(slice_statistics(days, lengths), ["asset", "train_days", "train_end"])


def regression_forecasts(statistics: DataFrame) -> DataFrame:
    """One row per split and horizon: the return that a one-feature regression predicts
    from the last training row, and the share of rises as its probability."""
    keep = [n for n in ("window_name", "window_place", "train_days") if n in statistics.columns]
    parts = []
    for h, bars in settings.HORIZONS.items():
        n, x, y, xx, xy = (F.col(f"{s}_{h}") for s in ("n", "x", "y", "xx", "xy"))
        slope = F.try_divide(n * xy - x * y, n * xx - x * x)
        intercept = F.try_divide(y - slope * x, n)
        up = F.try_divide(F.col(f"up_{h}"), n)
        parts.append(
            statistics.where(sufficient(h)).select(
                *keep, "asset", "train_start", "train_end", "test_start",
                F.lit(h).alias("horizon"),
                (F.col("test_start") + bars).alias("actual_rn"),
                F.col("last_price").alias("current_price"),
                (F.col("last_price") * (1 + (intercept + slope * F.col("last_x")) / 100)).alias("predicted_price"),
                F.greatest(up, 1 - up).alias("confidence"),
                F.col("rows").alias("training_samples"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where(F.col("predicted_price").isNotNull())


def score_forecasts(forecasts: DataFrame, rows: DataFrame) -> DataFrame:
    """Forecasts with the actual price of their target row, and their errors.

    Joined by (asset, row), so a long series is many keys.
    """
    actual = rows.select("asset", F.col("_rn").alias("actual_rn"), F.col("price").alias("actual_price"))
    start = rows.select("asset", F.col("_rn").alias("test_start"), F.col("datetime").alias("prediction_time"))
    joined = forecasts.join(actual, ["asset", "actual_rn"]).join(start, ["asset", "test_start"])
    predicted, real, now = F.col("predicted_price"), F.col("actual_price"), F.col("current_price")
    return joined.drop("actual_rn").withColumns(
        {
            "dollar_error": F.abs(predicted - real),
            "percent_error": relative_error(predicted, real),
            "direction_correct": ((predicted > now) == (real > now)).cast("int"),
        }
    )


def evaluate_splits(rows: DataFrame, splits: DataFrame, feature: str) -> DataFrame:
    """Backtest records of the closed-form model for any number of series and splits."""
    return score_forecasts(regression_forecasts(split_statistics(rows, splits, feature)), rows)


def evaluate_splits_with(
    rows: DataFrame, splits: Iterable[dict], learner: learning.Learner, at_once: int = 4
) -> DataFrame:
    """The same with boosted trees: one fit per split and horizon, several at a time.

    ``splits`` are the few chosen splits (asset, train_start, train_end, test_start).
    """

    def one(job):
        split, horizon = job
        part = rows.where(
            (F.col("asset") == split["asset"])
            & F.col("_rn").between(split["train_start"], split["train_end"] - 1)
        )
        try:
            model = learning.train(part, split["asset"], horizon, learner)
        except ValueError:
            return None
        made = learning.predict(model, part)
        return made.select(
            "asset", F.lit(split["train_start"]).alias("train_start"), F.lit(split["train_end"]).alias("train_end"),
            F.lit(split["test_start"]).alias("test_start"), "horizon",
            F.lit(split["test_start"] + settings.HORIZONS[horizon]).alias("actual_rn"),
            "current_price", "predicted_price", "confidence",
            F.lit(split["train_end"] - split["train_start"]).alias("training_samples"),
        )

    jobs = [(s, h) for s in splits for h in settings.HORIZONS]
    with ThreadPoolExecutor(at_once) as pool:
        parts = [p for p in pool.map(one, jobs) if p is not None]
    if not parts:
        raise ValueError("no split had enough training rows")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return score_forecasts(out, rows)


# -- statistics -------------------------------------------------------------------------------
# A group holds one row per split, at most a few hundred, so the built-in median is safe.


def backtest_statistics(records: DataFrame) -> DataFrame:
    return records.groupBy("asset", "horizon").agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.avg("dollar_error").alias("avg_dollar_error"),
        F.median("dollar_error").alias("median_dollar_error"),
        F.avg("percent_error").alias("avg_percent_error"),
        F.median("percent_error").alias("median_percent_error"),
        F.avg("direction_correct").alias("direction_accuracy"),
        F.avg("confidence").alias("avg_confidence"),
        F.max("percent_error").alias("max_error"),
        F.min("percent_error").alias("min_error"),
    )


def window_statistics(records: DataFrame) -> DataFrame:
    return records.groupBy("window_name", "window_place", "train_days", "asset", "horizon").agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.avg("dollar_error").alias("avg_dollar_error"),
        F.avg("percent_error").alias("avg_percent_error"),
        F.avg("direction_correct").alias("direction_accuracy"),
        F.avg("confidence").alias("avg_confidence"),
        F.stddev_pop("percent_error").alias("std_percent_error"),
        F.median("percent_error").alias("median_percent_error"),
    )


def best_windows(statistics: DataFrame) -> DataFrame:
    """Per series and horizon the window with the least mean percent error; of equal
    ones the first in list order."""
    order = F.struct("avg_percent_error", "window_place")
    return statistics.groupBy("asset", "horizon").agg(
        F.min_by("window_name", order).alias("window_name"),
        F.min_by("train_days", order).alias("train_days"),
        F.min("avg_percent_error").alias("expected_error"),
    )
