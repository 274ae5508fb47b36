"""Accuracy of predictions, their ranking, and the spread of the residuals.

Input is long: one row per model and day with ``Actual`` and ``Predicted``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfcast.functions.clean import not_negative

BASELINE = "Baseline (7-Day MA)"

WAPE_EPSILON = 1e-8

# Decimals of each reported metric.
DECIMALS = {"MAE": 2, "RMSE": 2, "R2": 4, "WAPE_%": 2, "MAPE_%": 2}


def _r_squared(actual: Column, error: Column) -> Column:
    """1 - residual sum / total sum; a constant target scores 1 if met exactly, else 0."""
    residual = F.sum(error * error)
    total = F.var_pop(actual) * F.count(actual)
    return F.when(total > 0, 1 - F.try_divide(residual, total)).otherwise(
        F.when(residual == 0, 1.0).otherwise(0.0)
    )


def evaluate(
    predictions: DataFrame, by: Sequence[str] = ("Model",), rounded: bool = True
) -> DataFrame:
    """MAE, RMSE, R2, WAPE and MAPE in percent, of predictions cut at zero.

    MAPE covers days with positive actuals only, and is 0 if there are none.
    """
    actual = F.col("Actual").cast("double")
    error = actual - not_negative(F.col("Predicted"))
    metrics = {
        "MAE": F.avg(F.abs(error)),
        "RMSE": F.sqrt(F.avg(error * error)),
        "R2": _r_squared(actual, error),
        "WAPE_%": F.try_divide(F.sum(F.abs(error)), F.sum(actual) + WAPE_EPSILON) * 100,
        "MAPE_%": F.coalesce(
            F.avg(F.when(actual > 0, F.abs(F.try_divide(error, actual)))) * 100, F.lit(0.0)
        ),
    }
    return predictions.groupBy(*by).agg(
        *[(F.bround(c, DECIMALS[n]) if rounded else c).alias(n) for n, c in metrics.items()]
    )


def evaluate_basic(
    predictions: DataFrame, by: Sequence[str] = ("Model",), rounded: bool = True
) -> DataFrame:
    """The four metrics without MAPE; WAPE without the guard, so null for all-zero actuals."""
    actual = F.col("Actual").cast("double")
    error = actual - not_negative(F.col("Predicted"))
    metrics = {
        "MAE": F.avg(F.abs(error)),
        "RMSE": F.sqrt(F.avg(error * error)),
        "R2": _r_squared(actual, error),
        "WAPE_%": F.try_divide(F.sum(F.abs(error)), F.sum(actual)) * 100,
    }
    return predictions.groupBy(*by).agg(
        *[(F.bround(c, DECIMALS[n]) if rounded else c).alias(n) for n, c in metrics.items()]
    )


def rank_models(metrics: DataFrame) -> DataFrame:
    """Best first by WAPE."""
    return metrics.orderBy("WAPE_%", "Model")


def champion(metrics: DataFrame) -> DataFrame:
    """The best fitted model; the baseline does not compete."""
    return rank_models(metrics.where(F.col("Model") != BASELINE)).limit(1)


def mark_best(metrics: DataFrame) -> DataFrame:
    """Flag the best value of each metric: lowest error, highest R2."""
    everywhere = W.partitionBy()
    flags = {f"Best_{n}": F.col(n) == F.min(n).over(everywhere) for n in ("MAE", "RMSE", "WAPE_%")}
    flags["Best_R2"] = F.col("R2") == F.max("R2").over(everywhere)
    return metrics.withColumns(flags)


def residual_sigma(
    predictions: DataFrame, by: Sequence[str] = ("Model",), clipped: bool = True
) -> DataFrame:
    """Population deviation of the residuals; the mean error does not count into it."""
    predicted = F.col("Predicted")
    residual = F.col("Actual") - (not_negative(predicted) if clipped else predicted)
    return predictions.groupBy(*by).agg(F.stddev_pop(residual).alias("Sigma"))
