"""Classical decomposition and the unit-root test of a series."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfcast.session import settle

# Response-surface constants for the test with a constant term.
SMALL_P = (2.1659, 1.4412, 0.038269)
LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)
TAU_LOWEST, TAU_SWITCH, TAU_HIGHEST = -18.83, -1.61, 2.74
CRITICAL = {
    "Critical_1": (-3.43035, -6.5393, -16.786, -79.433),
    "Critical_5": (-2.86154, -2.8903, -4.234, -40.04),
    "Critical_10": (-2.56677, -1.5384, -2.809, 0.0),
}


def decompose(
    series: DataFrame, keys: Sequence[str] = (), value: str = "Sales", period: int = 12
) -> DataFrame:
    """Additive decomposition into trend, seasonal part and residual.

    The trend is the centred moving average over one period and null at both ends. The
    phase of the season counts from the first row of the series. Fewer than two full
    periods fail the job.
    """
    order = W.partitionBy(*keys).orderBy("Date")
    whole = W.partitionBy(*keys)
    half = period // 2
    y, rn, n = F.col(value), F.col("_rn"), F.col("_n")

    if period % 2 == 0:
        inner = F.sum(value).over(order.rowsBetween(1 - half, half - 1))
        ends = F.lag(value, half).over(order) + F.lead(value, half).over(order)
        centred = (inner + 0.5 * ends) / period
    else:
        centred = F.avg(value).over(order.rowsBetween(-half, half))
    message = F.concat(F.lit(f"decomposition needs {2 * period} rows, got "), n.cast("string"))

    trended = (
        series.select(*keys, "Date", value)
        .withColumns({"_rn": F.row_number().over(order), "_n": F.count(F.lit(1)).over(whole)})
        .withColumn(
            "Trend",
            F.when(n < 2 * period, F.raise_error(message).cast("double")).when(
                (rn > half) & (rn <= n - half), centred
            ),
        )
        .withColumn("_phase", (rn - 1) % period)
    )
    # The first ``period`` rows hold each phase once, so they give the mean over phases.
    return (
        trended.withColumn("_raw", F.avg(y - F.col("Trend")).over(W.partitionBy(*keys, "_phase")))
        .withColumn("_level", F.sum(F.when(rn <= period, F.col("_raw"))).over(whole) / period)
        .withColumn("Seasonal", F.col("_raw") - F.col("_level"))
        .withColumn("Residual", y - F.col("Trend") - F.col("Seasonal"))
        .select(*keys, "Date", y.alias("Observed"), "Trend", "Seasonal", "Residual")
    )


def _most_lags(n: int) -> int:
    """Lags tried on a series of n values; below zero if it is too short for any."""
    return min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)


def _regression_rows(known: DataFrame, keys: Sequence[str], date: str, lags: int) -> DataFrame:
    """One row per value: the step to it (``_0``), the level before it (``_1``), a constant
    (``_2``) and the ``lags`` steps before that (``_3`` on); ``_step`` counts the steps from 0,
    ``_most`` is how many lags the series is tried with."""
    order, whole = W.partitionBy(*keys).orderBy(date), W.partitionBy(*keys)
    n = F.col("_n")
    # Levels from their mean: a level in the millions stands beside a constant.
    centred = known.withColumns(
        {
            "_n": F.count(F.lit(1)).over(whole),
            "_flat": F.min("_y").over(whole) == F.max("_y").over(whole),
            "_step": F.row_number().over(order) - 2,
            "_1": F.lag("_y").over(order) - F.avg("_y").over(whole),
            "_0": F.col("_y") - F.lag("_y").over(order),
            "_2": F.lit(1.0),
        }
    ).withColumn("_most", F.least(F.ceil(12 * F.pow(n / 100, F.lit(0.25))), F.floor(n / 2) - 2).cast("int"))
    return centred.withColumns({f"_{k + 2}": F.lag("_0", k).over(order) for k in range(1, lags + 1)})


def _nested_products(rows: DataFrame, keys: Sequence[str], lags: int) -> DataFrame:
    """What the regressions with any number of lags need of a series, from one aggregate.

    The sample of a regression with k lags begins at step k. That with the most lags is part of all
    others: ``_products`` has its sums of products of two columns, a fixed number of map-side sums
    whatever the length of the series. ``_early`` has the steps before it, as many as there are lags
    at most, each as its number and its columns. Columns of lags not tried, or before the series, are 0.
    """
    most, step = F.col("_most"), F.col("_step")
    columns = [f"_{i}" for i in range(lags + 3)]
    filled = rows.withColumns(
        {c: F.when((F.lit(max(i - 2, 0)) <= most) & (step >= 0), F.coalesce(c, F.lit(0.0))).otherwise(0.0) for i, c in enumerate(columns)}
    )
    common = (step >= most) & (step >= 0)
    inside = filled.withColumn("_in", common.cast("double"))
    products = [F.sum(F.col("_in") * F.col(a) * F.col(b)) for i, a in enumerate(columns) for b in columns[i:]]
    early = F.when((step >= 0) & (step < most), F.array(step.cast("double"), *columns))
    return inside.groupBy(*keys).agg(
        F.max("_flat").alias("_flat"),
        F.max("_most").alias("_most"),
        F.count_if(common).alias("_common"),
        F.array(*products).alias("_products"),
        F.collect_list(early).alias("_early"),
    )


def _square(products: Sequence[float], lags: int) -> np.ndarray:
    size = lags + 3
    square = np.zeros((size, size))
    square[np.triu_indices(size)] = products
    return square + np.triu(square, 1).T


def _solve(square: np.ndarray, lags: int) -> tuple[float, float, float]:
    """Coefficient of the level, residual sum of squares, and the level's entry of the inverse,
    from cross products scaled to a diagonal of ones."""
    size = np.sqrt(np.diag(square)[: lags + 3])
    size[size == 0] = 1.0
    scaled = square[: lags + 3, : lags + 3] / np.outer(size, size)
    inverse = np.linalg.pinv(scaled[1:, 1:], hermitian=True)
    beta = inverse @ scaled[1:, 0]
    residual = max(scaled[0, 0] - beta @ scaled[1:, 0], 0.0) * size[0] ** 2
    return beta[0] * size[0] / size[1], residual, inverse[0, 0] / size[1] ** 2


def adf_p_value(tau: float) -> float:
    if tau > TAU_HIGHEST:
        return 1.0
    if tau < TAU_LOWEST:
        return 0.0
    weights = SMALL_P if tau <= TAU_SWITCH else LARGE_P
    z = sum(w * tau**i for i, w in enumerate(weights))
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def adf_critical(observations: int) -> dict[str, float]:
    return {
        name: sum(w / observations**i for i, w in enumerate(weights))
        for name, weights in CRITICAL.items()
    }


def _chosen_lags(products: Sequence[float], most: int, observations: int, lags: int) -> int:
    """The lag count with the lowest Akaike criterion on the common sample."""
    square = _square(products, lags)
    criteria = []
    for k in range(most + 1):
        residual = max(_solve(square, k)[1], np.finfo(float).tiny)
        criteria.append((observations * math.log(residual / observations) + 2 * (k + 2), k))
    return min(criteria)[1]


def _with_early(products: Sequence[float], early: Sequence[Sequence[float]], used: int, lags: int) -> tuple[np.ndarray, int]:
    """Cross products over the steps from ``used`` on, and how many of these are early ones."""
    square = _square(products, lags)
    added = np.array([row[1:] for row in early if row[0] >= used]).reshape(-1, lags + 3)
    return square + added.T @ added, len(added)


def _level_t_value(square: np.ndarray, used: int, observations: int) -> float | None:
    freedom = observations - used - 2
    if freedom <= 0:
        return None
    beta, residual, inverse = _solve(square, used)
    error = math.sqrt(residual / freedom * inverse)
    return beta / error if error > 0 else -math.inf


def _tested(products: Sequence[float], early: Sequence, most: int, common: int, lags: int) -> tuple:
    """Lags, observations, statistic and p-value of one series; nulls if it cannot be tested."""
    nothing = (None, None, None, None)
    if most < 0 or common <= 0:
        return nothing
    used = _chosen_lags(products, most, common, lags)
    square, added = _with_early(products, early, used, lags)
    tau = _level_t_value(square, used, common + added)
    return nothing if tau is None else (used, common + added, tau, adf_p_value(tau))


def adf_test(
    series: DataFrame, keys: Sequence[str] = (), value: str = "Sales", date: str = "Date"
) -> DataFrame:
    """Augmented Dickey-Fuller test per series, with a constant term.

    The series, a row for each period, is written once, so what it was summed from is read once. Lagged
    columns and sums of their products are Spark's; what runs in Python is the solution of systems of
    as many unknowns as lags, from one row per series. Series that are constant or too short give nulls.
    """
    known = settle(series.select(*keys, date, F.col(value).cast("double").alias("_y")).where("_y is not null"))
    longest = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    lags = max(_most_lags(longest), 0)

    @F.pandas_udf("Lags int, Observations int, Statistic double, P_Value double")
    def tested(products: pd.Series, early: pd.Series, most: pd.Series, common: pd.Series) -> pd.DataFrame:
        rows = [_tested(p, e, m, n, lags) for p, e, m, n in zip(products, early, most, common)]
        found = pd.DataFrame(rows, columns=["Lags", "Observations", "Statistic", "P_Value"], dtype=object)
        return found.astype({"Lags": "Int32", "Observations": "Int32"})

    sums = _nested_products(_regression_rows(known, keys, date, lags), keys, lags).where("_most is not null")
    # A constant series has no steps to explain.
    testable = F.when(F.col("_flat"), -1).otherwise(F.col("_most"))
    found = sums.select(*keys, tested("_products", "_early", testable, "_common").alias("_found")).select(*keys, "_found.*")
    size = F.col("Observations").cast("double")
    found = found.withColumns(
        {name: sum((F.lit(w) / F.pow(size, F.lit(float(i))) for i, w in enumerate(weights)), F.lit(0.0)) for name, weights in CRITICAL.items()}
    )
    found = found.withColumn("Stationary", F.col("P_Value") < 0.05)
    return found.select(*keys, "Statistic", "P_Value", *CRITICAL, "Lags", "Observations", "Stationary")
