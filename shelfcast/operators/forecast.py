"""Recursive forecasts: each predicted day feeds the features of the next.

The steps of one series depend on each other, the series do not. So each series is one
row with its newest values. With the baseline or a linear model all steps are one expression of
that row, a fold over its history, in one job whatever the horizon. Tree models predict through
Spark ML, one step of all series after the other, with the lineage cut in the shared folder every
few steps.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfcast.functions.clean import not_negative
from shelfcast.operators.features import FeatureSpec, isolate_target, next_features
from shelfcast.operators.ridge import linear
from shelfcast.session import settle

HORIZON = 90

# Growth of the variance per step, and the two normal quantiles.
VARIANCE_GROWTH = 0.015
Z_80, Z_95 = 1.28, 1.96

BAND_COLUMNS = ["Forecast_Sales", "Lower_80", "Upper_80", "Lower_95", "Upper_95"]

# Steps of a tree model between two cuts of the lineage.
STEPS_PER_CUT = 10

# The baseline or a linear model: a feature's name, or weights and intercept as plain numbers or columns.
Scorer = dict[str, Any]


def score(scorer: Scorer, values: dict[str, Column]) -> Column:
    """The prediction from a day's features."""
    if scorer["kind"] == "column":
        return values[scorer["name"]]
    return linear(list(values.values()), scorer["weights"], scorer["intercept"])


def baseline_scorer(spec: FeatureSpec) -> Scorer:
    return {"kind": "column", "name": "rolling_mean_7"}


def linear_scorer(models: DataFrame) -> Scorer:
    """The one ridge model of a table of a single row, as plain numbers."""
    row = models.first()
    return {"kind": "linear", "weights": row["Weights"], "intercept": row["Intercept"]}


def own_scorer() -> Scorer:
    """The linear model that each series carries in its columns Weights and Intercept."""
    return {"kind": "linear", "weights": F.col("Weights"), "intercept": F.col("Intercept")}


def scorer_of(model: PipelineModel) -> Scorer | PipelineModel:
    """A linear model in numbers; any other model as it is."""
    regressor = model.stages[-1]
    if isinstance(regressor, LinearRegressionModel):
        return {
            "kind": "linear",
            "weights": regressor.coefficients.toArray(),
            "intercept": regressor.intercept,
        }
    return model


def series_state(
    daily: DataFrame, spec: FeatureSpec = FeatureSpec(), keys: Sequence[str] = ()
) -> DataFrame:
    """One row per series: its last date and its newest values, as many as features reach."""
    isolated = isolate_target(daily, spec, keys)
    age = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(spec.date)))
    newest = isolated.withColumn("_age", age).where(F.col("_age") <= spec.memory)
    pairs = F.sort_array(F.collect_list(F.struct(spec.date, spec.target)))
    state = newest.groupBy(*keys).agg(
        F.max(spec.date).alias("Last_Date"), pairs.getField(spec.target).alias("History")
    )
    return state.where(F.size("History") > 0)


def future_days(last: Column, horizon: int) -> Column:
    return F.sequence(F.date_add(last, 1), F.date_add(last, horizon))


def next_day_features(
    state: DataFrame, spec: FeatureSpec = FeatureSpec(), keys: Sequence[str] = (), ddof: int = 0
) -> DataFrame:
    """What a model sees for the first future day of each series."""

    seen = _with_next_features(state, spec, ddof)
    return seen.select(*keys, F.date_add("Last_Date", 1).alias(spec.date), *spec.names)


def _with_next_features(state: DataFrame, spec: FeatureSpec, ddof: int) -> DataFrame:
    return state.withColumns(next_features(spec, F.col("History"), F.date_add("Last_Date", 1), ddof))


def walk(scorer: Scorer, spec: FeatureSpec, horizon: int, ddof: int = 0) -> Column:
    """Predictions of all steps in one array: a fold over the steps whose state is the history so far."""

    def longer(past: Column, step: Column) -> Column:
        values = next_features(spec, past, F.date_add("Last_Date", step), ddof)
        return F.concat(past, F.array(not_negative(score(scorer, values))))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col("History"), longer)
    return F.slice(path, -horizon, horizon)


def _walk_through_model(
    state: DataFrame, model: PipelineModel, spec: FeatureSpec, keys: Sequence[str], horizon: int, ddof: int
) -> DataFrame:
    """``state`` with ``_path``, the predictions of all steps, and the last date it started from."""
    first = F.col("Last_Date").alias("_start")
    current = state.select(*keys, "Last_Date", "History", first, F.array().cast("array<double>").alias("_path"))
    for step in range(1, horizon + 1):
        scored = model.transform(_with_next_features(current, spec, ddof))
        value = F.array(not_negative(F.col("prediction")))
        current = scored.select(
            *keys,
            F.date_add("Last_Date", 1).alias("Last_Date"),
            F.slice(F.concat("History", value), F.greatest(F.size("History") + 2 - spec.memory, F.lit(1)), spec.memory).alias("History"),
            "_start",
            F.concat("_path", value).alias("_path"),
        )
        if step % STEPS_PER_CUT == 0:
            current = settle(current)
    return current.select(*keys, F.col("_start").alias("Last_Date"), "_path")


def recursive_forecast(
    state: DataFrame,
    scorer: Scorer | PipelineModel,
    model: str,
    spec: FeatureSpec = FeatureSpec(),
    keys: Sequence[str] = (),
    horizon: int = HORIZON,
    ddof: int = 0,
) -> DataFrame:
    """``horizon`` future days per series: Model, keys, Step, Date, Predicted.

    ``ddof`` 0 takes the population deviation for the rolling deviation of future days,
    as opposed to the sample one in training; 1 uses the sample form for both.
    """
    if isinstance(scorer, PipelineModel):
        walked = _walk_through_model(state, scorer, spec, keys, horizon, ddof)
    else:
        walked = state.withColumn("_path", walk(scorer, spec, horizon, ddof))
    return walked.select(*keys, "Last_Date", F.posexplode("_path").alias("_i", "Predicted")).select(
        F.lit(model).alias("Model"),
        *keys,
        (F.col("_i") + 1).alias("Step"),
        F.date_add("Last_Date", F.col("_i") + 1).alias("Date"),
        "Predicted",
    )


def bands(value: Column, sigma: Column, step: Column) -> dict[str, Column]:
    """Forecast with its 80 % and 95 % bands, which widen with the step, floored at zero."""
    spread = sigma * F.sqrt(1 + VARIANCE_GROWTH * step)
    return {
        "Forecast_Sales": value,
        "Lower_80": not_negative(value - Z_80 * spread),
        "Upper_80": value + Z_80 * spread,
        "Lower_95": not_negative(value - Z_95 * spread),
        "Upper_95": value + Z_95 * spread,
    }


def with_bands(
    forecast: DataFrame, sigma: DataFrame, keys: Sequence[str] = (), rounded: bool = True
) -> DataFrame:
    """Add the bands, by the residual sigma of each model and series.

    Without keys ``sigma`` is one row, that of the model that made the forecast.
    """
    if keys:
        joined = forecast.join(sigma, ["Model", *keys], "left")
    else:
        joined = forecast.withColumn("Sigma", sigma.select("Sigma").scalar())
    columns = bands(F.col("Predicted"), F.col("Sigma"), F.col("Step"))
    return joined.select(
        "Model",
        *keys,
        "Step",
        "Date",
        *[(F.bround(c, 2) if rounded else c).alias(name) for name, c in columns.items()],
    )


def first_days(forecast: DataFrame, days: int, keys: Sequence[str] = ()) -> DataFrame:
    """The first ``days`` forecast rows of each series (and model, where there are several)."""
    if "Step" in forecast.columns:
        return forecast.where(F.col("Step") <= days)
    if not keys:
        return forecast.orderBy("Date").limit(days)
    position = F.row_number().over(W.partitionBy(*keys).orderBy("Date"))
    return forecast.withColumn("_n", position).where(F.col("_n") <= days).drop("_n")


def forecast_kpis(forecast: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum and daily mean of the forecast, sums of the outer bands; 0 for no rows."""
    measures = {
        "Projected_Sales": F.sum("Forecast_Sales"),
        "Daily_Average": F.avg("Forecast_Sales"),
        "Upper_Risk": F.sum("Upper_95"),
        "Lower_Floor": F.sum("Lower_95"),
    }
    return forecast.groupBy(*by).agg(
        *[F.coalesce(c, F.lit(0.0)).alias(name) for name, c in measures.items()]
    )


def forecast_span(forecast: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Total and first and last day of the forecast."""
    return forecast.groupBy(*by).agg(
        F.sum("Forecast_Sales").alias("Total_Sales"),
        F.min("Date").alias("First_Date"),
        F.max("Date").alias("Last_Date"),
    )


def history_plus_forecast(
    history: DataFrame, forecast: DataFrame, keys: Sequence[str] = ()
) -> DataFrame:
    """Actual and forecast days as one tagged series; actual days have no bands."""
    nothing = F.lit(None).cast("double")
    actual = history.select(
        *keys,
        F.lit("Actual").alias("Kind"),
        "Date",
        F.col("Sales").alias("Value"),
        nothing.alias("Lower_95"),
        nothing.alias("Upper_95"),
    )
    ahead = forecast.select(
        *keys, F.lit("Forecast").alias("Kind"), "Date", F.col("Forecast_Sales").alias("Value"),
        "Lower_95", "Upper_95",
    )
    return actual.unionByName(ahead)
