"""Feature scores, scaling, folds and models per series and horizon."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidebar import settings
from tidebar.functions.scalars import div
from tidebar.operators.cleaning import training_rows
from tidebar.operators.versions import last_row, latest_per_key

# Columns that are never features.
NOT_FEATURES = ("datetime", "asset", "_rn") + tuple(
    f"{kind}_{h}"
    for kind in ("target", "target_return", "target_direction", "target_datetime")
    for h in settings.HORIZONS
)


def feature_names(df: DataFrame) -> list[str]:
    return [n for n in df.columns if n not in NOT_FEATURES]


def feature_scores(
    df: DataFrame, features: Sequence[str], target: str, key: str = "asset"
) -> DataFrame:
    """Univariate F score of each feature against the target, one pass for all.

    A constant feature scores 0, a perfectly correlated one the largest double.
    """
    y = F.col(target)
    aggs = []
    for n in features:
        x = F.col(n).cast("double")
        r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
        aggs.append(r.alias(f"_r_{n}"))
    one = df.where(y.isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *aggs)
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"_r_{n}").alias("_r")) for n in features])
    long = one.select(key, "_n", F.inline(pairs))
    r2 = F.col("_r") * F.col("_r")
    score = F.when(F.col("_r").isNull(), 0.0).when(r2 >= 1, F.lit(1.7976931348623157e308)).otherwise(
        r2 / F.greatest(1 - r2, F.lit(1e-300)) * (F.col("_n") - 2)
    )
    return long.select(key, "feature", score.alias("score"))


def best_features(scores: DataFrame, k: int = settings.TOP_FEATURES, key: str = "asset") -> DataFrame:
    """The ``k`` best features per series (all, if there are fewer)."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), "feature")
    return scores.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def standardized(df: DataFrame, features: Sequence[str], key: str = "asset") -> DataFrame:
    """Mean 0 and population deviation 1 per series; constant columns become 0."""
    aggs = []
    for n in features:
        aggs += [F.avg(n).alias(f"_m_{n}"), F.stddev_pop(n).alias(f"_d_{n}")]
    stats = df.groupBy(key).agg(*aggs)
    scale = lambda n: F.when(F.col(f"_d_{n}") == 0, F.lit(1.0)).otherwise(F.col(f"_d_{n}"))
    out = df.join(stats, key).withColumns({n: (F.col(n) - F.col(f"_m_{n}")) / scale(n) for n in features})
    return out.drop(*[f"_{x}_{n}" for n in features for x in "md"])


# -- folds -----------------------------------------------------------------------------------


def fold_count(n: Column, most: int = settings.CV_FOLDS) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(2), F.floor(n / 10)))


def expanding_folds(df: DataFrame, key: str = "asset", position: str = "_rn") -> DataFrame:
    """Per series the folds of an expanding split: train is [0, test_start), test is
    [test_start, test_end)."""
    sizes = df.groupBy(key).agg((F.max(position) + 1).alias("n"))
    sizes = sizes.withColumn("folds", fold_count(F.col("n")).cast("int"))
    sizes = sizes.withColumn("test_size", F.floor(F.col("n") / (F.col("folds") + 1)))
    fold = F.explode(F.sequence(F.lit(1), F.col("folds"))).alias("fold")
    start = F.col("n") - (F.col("folds") - F.col("fold") + 1) * F.col("test_size")
    return sizes.select(key, "n", "test_size", fold, "folds").select(
        key, "fold", start.alias("test_start"), (start + F.col("test_size")).alias("test_end")
    )


# -- classes -----------------------------------------------------------------------------------


def class_balance(df: DataFrame, label: str, key: str = "asset") -> DataFrame:
    """Counts of both classes, the majority and the weight a rare class gets."""
    up = F.sum((F.col(label) == 1).cast("long"))
    down = F.sum((F.col(label) == 0).cast("long"))
    counts = df.groupBy(key).agg(up.alias("ups"), down.alias("downs"))
    few, many = F.least("ups", "downs"), F.greatest("ups", "downs")
    share = few / (F.col("ups") + F.col("downs"))
    return counts.select(
        key, "ups", "downs",
        share.alias("minority_share"),
        F.when(F.col("ups") > F.col("downs"), 1).otherwise(0).alias("majority_class"),
        F.when((few > 0) & (share < 0.2), many / few).otherwise(F.lit(1.0)).alias("positive_weight"),
        (share < 0.05).alias("severe_imbalance"),
        (few == 0).alias("single_class"),
    )


def majority_model(df: DataFrame, label: str, key: str = "asset") -> DataFrame:
    """The fallback model: always the majority class, with its accuracy."""
    counts = class_balance(df, label, key)
    right = F.greatest("ups", "downs") / (F.col("ups") + F.col("downs"))
    return counts.select(key, F.col("majority_class").alias("prediction"), right.alias("accuracy"))


def fit_measures(df: DataFrame, predicted: str, actual: str, key: str = "asset") -> DataFrame:
    """Squared error, absolute error and share of right signs of given predictions."""
    error = F.col(predicted) - F.col(actual)
    same = ((F.col(predicted) > 0) == (F.col(actual) > 0)).cast("int")
    known = df.where(F.col(predicted).isNotNull() & F.col(actual).isNotNull())
    return known.groupBy(key).agg(
        F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"), F.avg(same).alias("accuracy")
    )


# -- models ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Learner:
    """Settings of the boosted trees, and the factories that make the estimators."""

    trees: int = settings.TREES
    depth: int = settings.DEPTH
    rate: float = settings.LEARNING_RATE
    seed: int = settings.SEED
    top: int = settings.TOP_FEATURES
    folds: int = settings.CV_FOLDS
    regressor: Callable[["Learner"], object] | None = None
    classifier: Callable[["Learner"], object] | None = None

    def make_regressor(self):
        if self.regressor:
            return self.regressor(self)
        return GBTRegressor(
            featuresCol="scaled", labelCol="_y", predictionCol="predicted_return",
            maxIter=self.trees, maxDepth=self.depth, stepSize=self.rate, seed=self.seed,
        )

    def make_classifier(self):
        if self.classifier:
            return self.classifier(self)
        return GBTClassifier(
            featuresCol="scaled", labelCol="_up", weightCol="_weight", predictionCol="_class",
            maxIter=self.trees, maxDepth=self.depth, stepSize=self.rate, seed=self.seed,
        ).setProbabilityCol("_probability").setRawPredictionCol("_raw")


@dataclass
class Trained:
    """A fitted model of one series and horizon, with its training record."""

    asset: str
    horizon: str
    features: list[str]
    pipeline: PipelineModel
    majority: int | None
    record: dict


def train(df: DataFrame, asset: str, horizon: str, learner: Learner = Learner()) -> Trained:
    """Choose features, scale, fit the return and the direction of one horizon."""
    y, up = f"target_return_{horizon}", f"target_direction_{horizon}"
    candidates = feature_names(df)
    mine = df.where(F.col("asset") == asset)
    rows = training_rows(mine, candidates, [y, up]).cache()
    try:
        balance = class_balance(rows, up).first()
        n = 0 if balance is None else balance["ups"] + balance["downs"]
        if n < 10:
            raise ValueError(f"only {n} training rows for {asset} {horizon}")
        scores = best_features(feature_scores(rows, candidates, y), learner.top)
        # At most learner.top names come to the driver.
        chosen = [r["feature"] for r in scores.orderBy("place").collect()]
        weight = F.when(F.col(up) == 1, F.lit(float(balance["positive_weight"]))).otherwise(F.lit(1.0))
        labelled = rows.select(
            "asset", "datetime", *chosen,
            F.col(y).alias("_y"), F.col(up).cast("double").alias("_up"), weight.alias("_weight"),
        )
        stages = [
            VectorAssembler(inputCols=chosen, outputCol="_raw_features"),
            StandardScaler(inputCol="_raw_features", outputCol="scaled", withMean=True, withStd=True),
            learner.make_regressor(),
        ]
        model = Pipeline(stages=stages).fit(labelled)
        fitted = model.transform(labelled)
        mse = RegressionEvaluator(labelCol="_y", predictionCol="predicted_return", metricName="mse")
        mae = RegressionEvaluator(labelCol="_y", predictionCol="predicted_return", metricName="mae")
        record = {
            "asset": asset, "horizon": horizon, "training_samples": n, "features_used": len(chosen),
            "train_mse": mse.evaluate(fitted), "train_mae": mae.evaluate(fitted),
            "minority_share": balance["minority_share"],
        }
        # One class only, or a direction model that can't be fitted: the majority class, and the return model stays.
        majority = int(balance["majority_class"])
        record["train_accuracy"] = max(balance["ups"], balance["downs"]) / n
        if not balance["single_class"]:
            try:
                direction = learner.make_classifier().fit(fitted)
                accuracy = MulticlassClassificationEvaluator(
                    labelCol="_up", predictionCol="_class", metricName="accuracy"
                )
                record["train_accuracy"] = accuracy.evaluate(direction.transform(fitted))
                model, majority = PipelineModel([*model.stages, direction]), None
            except Exception as error:  # noqa: BLE001 - kept in the training record
                record["classifier_error"] = str(error)
        regressor = model.stages[2]
        if hasattr(regressor, "featureImportances"):
            record["importances"] = dict(zip(chosen, map(float, regressor.featureImportances)))
        return Trained(asset, horizon, chosen, model, majority, record)
    finally:
        rows.unpersist()


def cross_validate(
    df: DataFrame, asset: str, horizon: str, features: Sequence[str], learner: Learner = Learner()
) -> list[float]:
    """Squared errors of the return model on the folds of an expanding split.

    ``df`` has the row position ``_rn`` of each series.
    """
    y = f"target_return_{horizon}"
    rows = training_rows(df.where(F.col("asset") == asset), features, [y]).withColumn("_y", F.col(y)).cache()
    try:
        scores = []
        for fold in expanding_folds(rows).orderBy("fold").collect():
            stages = [
                VectorAssembler(inputCols=list(features), outputCol="_raw_features"),
                StandardScaler(inputCol="_raw_features", outputCol="scaled", withMean=True),
                learner.make_regressor(),
            ]
            model = Pipeline(stages=stages).fit(rows.where(F.col("_rn") < fold["test_start"]))
            test = rows.where(F.col("_rn").between(fold["test_start"], fold["test_end"] - 1))
            measure = RegressionEvaluator(labelCol="_y", predictionCol="predicted_return", metricName="mse")
            scores.append(measure.evaluate(model.transform(test)))
        return scores
    finally:
        rows.unpersist()


def predictions_from_returns(df: DataFrame, horizon: str) -> DataFrame:
    """Prediction rows from price, predicted_return and up_probability."""
    p, hours = F.col("up_probability"), settings.HORIZONS[horizon]
    return df.select(
        "asset",
        F.lit(horizon).alias("horizon"),
        F.col("datetime").alias("created_at"),
        (F.col("datetime") + F.expr(f"INTERVAL '{hours}' HOUR")).alias("target_timestamp"),
        F.col("price").alias("current_price"),
        (F.col("price") * (1 + F.col("predicted_return") / 100)).alias("predicted_price"),
        "predicted_return",
        (p > 0.5).cast("int").alias("predicted_direction"),
        p.alias("direction_confidence"),
        F.greatest(p, 1 - p).alias("confidence"),
    )


def predict(trained: Trained, df: DataFrame, only_last: bool = True) -> DataFrame:
    """Predictions for the newest row of the model's series (or for all its rows)."""
    mine = df.where(F.col("asset") == trained.asset)
    rows = (last_row(mine) if only_last else mine).fillna(0, subset=trained.features)
    kept = rows.withColumn("_price", F.col("price"))
    scored = trained.pipeline.transform(kept).withColumn("price", F.col("_price"))
    if trained.majority is not None:
        up = F.lit(float(trained.majority))
    else:
        up = vector_to_array("_probability")[1]
    return predictions_from_returns(scored.withColumn("up_probability", up), trained.horizon)


def train_all(
    df: DataFrame,
    assets: Iterable[str],
    horizons: Iterable[str] = tuple(settings.HORIZONS),
    learner: Learner = Learner(),
    at_once: int = 4,
) -> tuple[dict[tuple[str, str], Trained], dict[tuple[str, str], str]]:
    """Fit every series and horizon; failures are kept by key and stop nothing.

    The driver only submits jobs; Spark runs several fits at the same time.
    """
    wanted = [(a, h) for a in assets for h in horizons]

    def one(job):
        try:
            return job, train(df, *job, learner), None
        except Exception as error:  # noqa: BLE001 - reported to the caller by key
            return job, None, str(error)

    with ThreadPoolExecutor(at_once) as pool:
        results = list(pool.map(one, wanted))
    models = {job: model for job, model, _ in results if model}
    return models, {job: error for job, _, error in results if error}


def predict_all(models: dict[tuple[str, str], Trained], df: DataFrame) -> DataFrame:
    parts = [predict(m, df) for m in models.values()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# -- keeping models ------------------------------------------------------------------------------

REGISTRY_SCHEMA = (
    "asset string, horizon string, path string, features array<string>, majority int, "
    "training_samples long, training_window string, training_days int, expected_error double, "
    "trained_at timestamp_ntz"
)


def save(trained: Trained, directory: str, trained_at, window: str | None = None, days: int | None = None,
         expected_error: float | None = None) -> tuple:
    """Write the model and give back its registry row."""
    path = f"{directory}/{trained.asset}_{trained.horizon}"
    trained.pipeline.write().overwrite().save(path)
    return (
        trained.asset, trained.horizon, path, trained.features, trained.majority,
        trained.record["training_samples"], window, days, expected_error, trained_at,
    )


def load(registry: DataFrame, asset: str, horizon: str) -> Trained:
    """The newest saved model of a series and horizon."""
    rows = registry.where((F.col("asset") == asset) & (F.col("horizon") == horizon))
    row = latest_per_key(rows, ["asset", "horizon"], ["trained_at"]).first()
    if row is None:
        raise KeyError(f"no model for {asset} {horizon}")
    model = PipelineModel.load(row["path"])
    return Trained(asset, horizon, list(row["features"]), model, row["majority"], {"training_samples": row["training_samples"]})


def due_for_training(
    wanted: DataFrame, registry: DataFrame, as_of: Column, hours: int = settings.RETRAIN_HOURS, force: bool = False
) -> DataFrame:
    """(asset, horizon) pairs without a model younger than ``hours``."""
    if force:
        return wanted.select("asset", "horizon")
    fresh = registry.where(F.col("trained_at") > as_of - F.expr(f"INTERVAL '{hours}' HOUR"))
    return wanted.select("asset", "horizon").join(fresh, ["asset", "horizon"], "left_anti")


def importance_rows(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Rows with the target known and missing features set to 0."""
    return df.dropna(subset=[target]).fillna(0, subset=list(features))


def relative_error(predicted: Column, actual: Column) -> Column:
    return div(F.abs(predicted - actual), actual) * 100
