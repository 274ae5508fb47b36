"""Candidate models: a moving-average baseline, ridge, random forest, boosting.

With series keys the candidates are fitted once over all series together.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.clean import not_negative
from shelfcast.operators.features import FeatureSpec
from shelfcast.operators.metrics import BASELINE

RIDGE = "Ridge Regression"
FOREST = "Random Forest"
BOOSTING = "Gradient Boosting"
FITTED = (RIDGE, FOREST, BOOSTING)


@dataclass(frozen=True)
class ModelSettings:
    """Settings of the candidates; an artifact records them.

    Trees draw their row samples by partition, so ``partitions`` is part of the model and never
    follows from the number of rows. The default suits one series of some years; whoever pools
    many series asks for more.
    """

    seed: int = 42
    partitions: int = 4
    statistics_mb: int = 256
    ridge_alpha: float = 10.0
    forest_trees: int = 200
    forest_depth: int = 8
    forest_leaf: int = 2
    boosting_rounds: int = 150
    boosting_depth: int = 4
    boosting_rate: float = 0.04
    boosting_rows: float = 0.8
    boosting_columns: float = 0.8


@dataclass(frozen=True)
class TrainingSize:
    rows: int
    spread: float


def training_size(train: DataFrame, target: str) -> TrainingSize:
    row = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(target).alias("s")).first()
    return TrainingSize(row["n"], row["s"] or 0.0)


def estimator(name: str, spec: FeatureSpec, size: TrainingSize, settings: ModelSettings = ModelSettings()):
    """An unfitted pipeline from feature columns to a prediction."""
    common = {"featuresCol": "features", "labelCol": spec.target, "predictionCol": "prediction"}
    if name == RIDGE:
        # Spark scales its penalty by the spread of the label and averages the loss over
        # rows; this value makes it the plain sum-of-squares penalty on scaled features.
        penalty = settings.ridge_alpha * size.spread / size.rows
        regressor = LinearRegression(
            solver="normal", elasticNetParam=0.0, standardization=True, regParam=penalty, **common
        )
    elif name == FOREST:
        regressor = RandomForestRegressor(
            numTrees=settings.forest_trees,
            maxDepth=settings.forest_depth,
            minInstancesPerNode=settings.forest_leaf,
            featureSubsetStrategy="all",
            maxMemoryInMB=settings.statistics_mb,
            seed=settings.seed,
            **common,
        )
    elif name == BOOSTING:
        regressor = GBTRegressor(
            maxIter=settings.boosting_rounds,
            maxDepth=settings.boosting_depth,
            stepSize=settings.boosting_rate,
            subsamplingRate=settings.boosting_rows,
            featureSubsetStrategy=str(settings.boosting_columns),
            maxMemoryInMB=settings.statistics_mb,
            seed=settings.seed,
            **common,
        )
    else:
        raise ValueError(f"unknown model: {name}")
    return Pipeline(stages=[VectorAssembler(inputCols=spec.names, outputCol="features"), regressor])


def fit(
    train: DataFrame,
    names: Sequence[str] = FITTED,
    spec: FeatureSpec = FeatureSpec(),
    settings: ModelSettings = ModelSettings(),
    keys: Sequence[str] = (),
) -> dict[str, PipelineModel]:
    """Fit the named candidates on one settled training table.

    Rows get a fixed place by key and date, so seed and partitions give the same trees on any cluster.
    """
    size = training_size(train, spec.target)
    if size.rows == 0:
        raise ValueError("no training rows: the series is shorter than its longest lag or window")
    place = [*keys, spec.date]
    rows = (
        train.select(*place, spec.target, *spec.names)
        .repartition(settings.partitions, *place)
        .sortWithinPartitions(*place)
        .persist()
    )
    # Each fit is a chain of short jobs; side by side they keep the executors busy.
    pool = ThreadPool(max(1, len(names)))
    try:
        train_one = inheritable_thread_target(train.sparkSession)(
            lambda name: estimator(name, spec, size, settings).fit(rows)
        )
        return dict(zip(names, pool.map(train_one, names)))
    finally:
        pool.close()
        rows.unpersist()


def baseline_predictions(
    test: DataFrame, spec: FeatureSpec = FeatureSpec(), keys: Sequence[str] = ()
) -> DataFrame:
    """The trailing seven-day mean of the same row."""
    return test.select(
        F.lit(BASELINE).alias("Model"),
        *keys,
        F.col(spec.date).alias("Date"),
        F.col(spec.target).alias("Actual"),
        F.col("rolling_mean_7").alias("Predicted"),
    )


def predict(
    models: dict[str, PipelineModel],
    test: DataFrame,
    spec: FeatureSpec = FeatureSpec(),
    keys: Sequence[str] = (),
    baseline: bool = True,
) -> DataFrame:
    """One row per model and test day. Test rows use actual lags, so this is one step ahead."""
    parts = [baseline_predictions(test, spec, keys)] if baseline else []
    for name, model in models.items():
        scored = model.transform(test)
        parts.append(
            scored.select(
                F.lit(name).alias("Model"),
                *keys,
                F.col(spec.date).alias("Date"),
                F.col(spec.target).alias("Actual"),
                not_negative(F.col("prediction")).alias("Predicted"),
            )
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def feature_importance(
    model: PipelineModel, spec: FeatureSpec, spark, top: int = 12
) -> DataFrame:
    """The features with the largest share of the gain."""
    weights = model.stages[-1].featureImportances.toArray().tolist()
    pairs = spark.createDataFrame(list(zip(spec.names, weights)), "Feature string, Importance double")
    return pairs.orderBy(F.desc("Importance"), "Feature").limit(top)


def range_check(predictions: DataFrame, train: DataFrame, target: str) -> DataFrame:
    """Per model: test days, the range of the training target, and how many predictions lie outside.

    A mean of training rows, which a forest predicts, cannot leave their range.
    """
    span = train.agg(F.min(target).alias("low"), F.max(target).alias("high")).first()
    outside = ~F.col("Predicted").between(span["low"], span["high"])
    return predictions.groupBy("Model").agg(
        F.count(F.lit(1)).alias("Test_Days"),
        F.lit(span["low"]).alias("Lowest"),
        F.lit(span["high"]).alias("Highest"),
        F.count_if(F.coalesce(outside, F.lit(True))).alias("Outside"),
    )


def training_gain(model: PipelineModel, name: str, train: DataFrame, target: str) -> DataFrame:
    """Training days, the spread of the target, and whether the model's error there is smaller.

    Boosting starts from the mean and fits each tree to what is left, so it cannot do worse.
    """
    error = F.col("prediction") - F.col(target)
    scored = model.transform(train)
    return scored.agg(
        F.lit(name).alias("Model"),
        F.count(F.lit(1)).alias("Train_Days"),
        F.stddev_pop(target).alias("Spread"),
        (F.sqrt(F.avg(error * error)) < F.stddev_pop(target)).alias("Gained"),
    )


def importance_check(importances: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Rows, how many of them name a feature once, how many are negative, and their sum."""
    known = F.col("Feature").isin(list(spec.names))
    return importances.agg(
        F.count(F.lit(1)).alias("Features"),
        F.count_distinct(F.when(known, F.col("Feature"))).alias("Known"),
        F.count_if(F.col("Importance") < 0).alias("Negative"),
        F.sum("Importance").alias("Total"),
    )
