"""Exact quantiles per group without holding a group in one place.

The built-in exact percentile keeps every distinct value of a group in memory. Here a
sketch of fixed size first brackets each quantile; the second pass counts what lies
below the bracket and above it, with the nearest value on either side, and sorts only what
lies inside. A wanted rank that is not among those fails the job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The sketch is off by at most 1 / ACCURACY of the group size in rank.
ACCURACY = 10_000
MARGIN = 2 / ACCURACY

# Brackets of at most so many groups are broadcast; more are joined by key.
MOST_BROADCAST_GROUPS = 10_000


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, quantiles: Mapping[str, float]
) -> DataFrame:
    """One row per group with the linearly interpolated quantiles, named by ``quantiles``.

    Null values are left out.
    """
    names, probabilities = list(quantiles), list(quantiles.values())
    present = df.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())

    low = [max(p - MARGIN, 0.0) for p in probabilities]
    high = [min(p + MARGIN, 1.0) for p in probabilities]
    sketch = present.groupBy(*by).agg(
        F.count("_v").alias("_n"), F.percentile_approx("_v", low + high, ACCURACY).alias("_edges")
    )
    # The two values around a quantile are at positions floor and ceil of p * (n - 1).
    brackets = small(
        sketch.select(
            *by,
            F.inline(
                F.array(
                    *[
                        F.struct(
                            F.lit(name).alias("_q"),
                            (F.lit(p) * (F.col("_n") - 1)).alias("_rank"),
                            F.col("_edges")[i].alias("_low"),
                            F.col("_edges")[len(names) + i].alias("_high"),
                        )
                        for i, (name, p) in enumerate(quantiles.items())
                    ]
                )
            ),
        ),
        MOST_BROADCAST_GROUPS * len(names),
    )
    side = F.when(F.col("_v") < F.col("_low"), -1).when(F.col("_v") > F.col("_high"), 1).otherwise(0)
    counted = (
        present.join(brackets, list(by))
        .withColumn("_side", side)
        .groupBy(*by, "_q", "_rank", "_side", F.when(F.col("_side") == 0, F.col("_v")).alias("_inside"))
        .agg(F.count(F.lit(1)).alias("_count"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    )
    # One row stands for all values below the bracket, by the nearest one, and one for all above.
    counted = counted.withColumn("_v", F.when(F.col("_side") < 0, F.col("_most")).otherwise(F.col("_least")))
    order = W.partitionBy(*by, "_q").orderBy("_v")
    upto = F.sum("_count").over(order.rowsBetween(W.unboundedPreceding, 0))

    def at(position: Column) -> Column:
        return F.min(F.when(F.col("_upto") > position, F.struct("_v", "_side", "_upto", "_count")))

    ranked = counted.withColumn("_upto", upto).groupBy(*by, "_q", "_rank").agg(
        at(F.floor("_rank")).alias("_left"), at(F.ceil("_rank")).alias("_right")
    )
    def known(found: str, position: Column) -> Column:
        """Below the bracket only the last value is known, above it only the first."""
        side, end = F.col(f"{found}._side"), F.col(f"{found}._upto")
        first = end - F.col(f"{found}._count")
        return (side == 0) | ((side < 0) & (end - 1 == position)) | ((side > 0) & (first == position))

    left, right = F.col("_left._v"), F.col("_right._v")
    between = left + (right - left) * (F.col("_rank") - F.floor("_rank"))
    bracketed = known("_left", F.floor("_rank")) & known("_right", F.ceil("_rank"))
    value = F.when(bracketed, between).otherwise(F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double"))
    return ranked.withColumn("_value", value).groupBy(*by).agg(
        *[F.max(F.when(F.col("_q") == name, F.col("_value"))).alias(name) for name in names]
    )


def small(df: DataFrame, most: int) -> DataFrame:
    """``df`` marked for a broadcast if it has at most ``most`` rows; as it is beyond.

    Runs the plan of ``df`` once; a small result is then at hand and not computed again.
    """
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
