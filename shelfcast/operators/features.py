"""Forecast features that never see the day they predict.

One ``FeatureSpec`` names the features and their order. ``build_features`` computes them
over a whole series with windows; ``next_features`` computes the same ones for the next
day out of an array of past values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfcast.functions.calendar import FEATURE_NAMES, calendar_features

# The default lags and trailing windows in days.
DEFAULT_LAGS = (1, 2, 3, 7, 14, 21, 28, 30)
DEFAULT_WINDOWS = (7, 14, 30)

# Keeps the momentum ratio finite on all-zero stretches.
MOMENTUM_EPSILON = 1e-5

TEST_DAYS = 90


@dataclass(frozen=True)
class FeatureSpec:
    """Which lags and trailing windows to use on which target.

    ``None`` means the defaults; an empty tuple really means none.
    """

    lags: Sequence[int] | None = None
    windows: Sequence[int] | None = None
    target: str = "Sales"
    date: str = "Date"

    def __post_init__(self):
        object.__setattr__(self, "lags", tuple(DEFAULT_LAGS if self.lags is None else self.lags))
        object.__setattr__(
            self, "windows", tuple(DEFAULT_WINDOWS if self.windows is None else self.windows)
        )

    @property
    def has_momentum(self) -> bool:
        return {7, 30} <= set(self.windows)

    @property
    def has_lag_difference(self) -> bool:
        return {1, 7} <= set(self.lags)

    @property
    def memory(self) -> int:
        """How many past values the features of one day can reach."""
        return max([*self.lags, *self.windows, 1])

    @property
    def names(self) -> list[str]:
        rolling = [f"rolling_{kind}_{w}" for w in self.windows for kind in ("mean", "std", "min", "max")]
        return [
            *FEATURE_NAMES,
            *[f"lag_{k}" for k in self.lags],
            *rolling,
            *(["momentum_7_30"] if self.has_momentum else []),
            *(["sales_diff_1_7"] if self.has_lag_difference else []),
        ]


def isolate_target(series: DataFrame, spec: FeatureSpec, keys: Sequence[str] = ()) -> DataFrame:
    """Only keys, date and target go on; same-day measures cannot leak into features."""
    target = F.col(spec.target).try_cast("double")
    clean = F.coalesce(F.nanvl(target, F.lit(None).cast("double")), F.lit(0.0))
    return series.select(*keys, F.col(spec.date).cast("date").alias(spec.date), clean.alias(spec.target))


def lag_features(spec: FeatureSpec, keys: Sequence[str] = ()) -> dict[str, Column]:
    order = W.partitionBy(*keys).orderBy(spec.date)
    return {f"lag_{k}": F.lag(spec.target, k).over(order) for k in spec.lags}


def rolling_features(spec: FeatureSpec, keys: Sequence[str] = ()) -> dict[str, Column]:
    """Statistics of the ``w`` rows before the current one; null until ``w`` rows exist."""
    order = W.partitionBy(*keys).orderBy(spec.date)
    position = F.row_number().over(order)
    kinds = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    return {
        f"rolling_{kind}_{w}": F.when(position > w, f(spec.target).over(order.rowsBetween(-w, -1)))
        for w in spec.windows
        for kind, f in kinds.items()
    }


def interaction_features(spec: FeatureSpec) -> dict[str, Column]:
    columns: dict[str, Column] = {}
    if spec.has_momentum:
        columns["momentum_7_30"] = F.col("rolling_mean_7") / (F.col("rolling_mean_30") + MOMENTUM_EPSILON)
    if spec.has_lag_difference:
        columns["sales_diff_1_7"] = F.col("lag_1") - F.col("lag_7")
    return columns


def build_features(
    series: DataFrame,
    spec: FeatureSpec = FeatureSpec(),
    keys: Sequence[str] = (),
    drop_incomplete: bool = True,
) -> DataFrame:
    """Feature matrix of a continuous daily series; rows without full history go.

    All lags and frames share one partitioning and order, hence one exchange and one sort.
    """
    isolated = isolate_target(series, spec, keys)
    matrix = (
        isolated.withColumns({**lag_features(spec, keys), **rolling_features(spec, keys)})
        .withColumns({**calendar_features(F.col(spec.date)), **interaction_features(spec)})
        .select(*keys, spec.date, spec.target, *spec.names)
    )
    return matrix.dropna(subset=spec.names) if drop_incomplete else matrix


def chronological_split(
    features: DataFrame, test_size: int = TEST_DAYS, keys: Sequence[str] = (), date: str = "Date"
) -> DataFrame:
    """Mark the last ``test_size`` rows of each series ``test``, all others ``train``.

    Without keys, a series that would be left without training rows fails the job. With keys its
    rows are marked ``short``, and the other series go on; ``short_series`` lists them.
    """
    if test_size <= 0:
        raise ValueError("test_size must be positive")
    newest = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(date)))
    size = F.count(F.lit(1)).over(W.partitionBy(*keys))
    message = F.concat(F.lit(f"test_size {test_size} leaves no training rows out of "), size.cast("string"))
    too_short = F.lit("short") if keys else F.raise_error(message).cast("string")
    side = (
        F.when(size <= test_size, too_short)
        .when(newest <= test_size, "test")
        .otherwise("train")
    )
    return features.withColumn("split", side)


def short_series(marked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys and number of rows of the series that are too short to be trained on."""
    return marked.where(F.col("split") == "short").groupBy(*keys).agg(F.count(F.lit(1)).alias("Rows"))


def split_frames(
    features: DataFrame, test_size: int = TEST_DAYS, keys: Sequence[str] = (), date: str = "Date"
) -> tuple[DataFrame, DataFrame]:
    marked = chronological_split(features, test_size, keys, date)
    return tuple(marked.where(F.col("split") == side).drop("split") for side in ("train", "test"))


class SplitParts(NamedTuple):
    """Inputs, targets and dates of both sides; each table carries keys and date to join on."""

    x_train: DataFrame
    x_test: DataFrame
    y_train: DataFrame
    y_test: DataFrame
    dates_train: DataFrame
    dates_test: DataFrame


def split_parts(
    features: DataFrame,
    spec: FeatureSpec = FeatureSpec(),
    test_size: int = TEST_DAYS,
    keys: Sequence[str] = (),
) -> SplitParts:
    place = [*keys, spec.date]
    sides = split_frames(features, test_size, keys, spec.date)
    wanted = [[*place, *spec.names], [*place, spec.target], place]
    return SplitParts(*[side.select(*columns) for columns in wanted for side in sides])


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v) / F.size(values)


def _deviation(values: Column, ddof: int) -> Column:
    squares = lambda mean: F.aggregate(values, F.lit(0.0), lambda total, v: total + (v - mean) * (v - mean))
    spread = _bound(_mean(values), squares) / F.greatest(F.size(values) - ddof, F.lit(1))
    return F.when(F.size(values) > 1, F.sqrt(spread)).otherwise(0.0)


def next_features(spec: FeatureSpec, history: Column, day: Column, ddof: int = 0) -> dict[str, Column]:
    """Features of ``day`` from an array of all values before it, oldest first, as column expressions.

    A lag that reaches past a short history is the mean of that history, a window past it takes all
    of it. ``history`` holds one value at least.
    """

    def newest(count: int) -> Column:
        have = F.least(F.size(history), F.lit(count))
        return F.slice(history, -have, have)

    values = {name: c.cast("double") for name, c in calendar_features(day).items()}
    for k in spec.lags:
        known = F.size(history) >= k
        values[f"lag_{k}"] = F.when(known, F.try_element_at(history, F.lit(-k))).otherwise(_mean(newest(spec.memory)))
    for w in spec.windows:
        values[f"rolling_mean_{w}"] = _mean(newest(w))
        values[f"rolling_std_{w}"] = _deviation(newest(w), ddof)
        values[f"rolling_min_{w}"] = F.array_min(newest(w))
        values[f"rolling_max_{w}"] = F.array_max(newest(w))
    if spec.has_momentum:
        values["momentum_7_30"] = values["rolling_mean_7"] / (values["rolling_mean_30"] + MOMENTUM_EPSILON)
    if spec.has_lag_difference:
        values["sales_diff_1_7"] = values["lag_1"] - values["lag_7"]
    return {name: values[name] for name in spec.names}
