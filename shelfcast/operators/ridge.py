"""Ridge regression from sums that can be merged.

Number of rows, means and centred cross-products say all that ridge needs of its rows. They are
taken once for each part of the rows (a split, a series), in Arrow batches where the rows are, and
merged by the rule for two samples, which stays exact to rounding whatever the level of a column. So
the model of training and test rows together comes from the sums of both: no second pass over rows,
and one model for each series is one small system for each row of sums.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from shelfcast.operators.features import FeatureSpec

# Parts whose sums are merged apart first, so that no task merges those of all tasks.
SALTS = 64

Sums = tuple[int, np.ndarray, np.ndarray]


def sums_of(x: np.ndarray) -> Sums:
    """Rows, means and centred cross-products of the columns."""
    mean = x.mean(axis=0)
    centred = x - mean
    return len(x), mean, centred.T @ centred


def merge(one: Sums, other: Sums) -> Sums:
    n = one[0] + other[0]
    apart = other[1] - one[1]
    return n, one[1] + apart * (other[0] / n), one[2] + other[2] + np.outer(apart, apart) * (one[0] * other[0] / n)


def _schema(by: Sequence[StructField]) -> StructType:
    numbers = ArrayType(DoubleType())
    return StructType([*by, StructField("n", LongType()), StructField("mean", numbers), StructField("products", numbers)])


def _columns(found: Sequence[Sums]) -> dict[str, pa.Array]:
    lists = pa.list_(pa.float64())
    return {
        "n": pa.array([n for n, _, _ in found], pa.int64()),
        "mean": pa.array([m for _, m, _ in found], lists),
        "products": pa.array([p.ravel() for _, _, p in found], lists),
    }


def _partial(batches: Iterator[pa.RecordBatch], by: Sequence[str], names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    salt = TaskContext.get().partitionId() % SALTS
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = np.zeros(batch.num_rows, np.int64)
        for name in by:
            known = batch.column(name).dictionary_encode(null_encoding="encode")
            codes = codes * len(known.dictionary) + known.indices.to_numpy(zero_copy_only=False)
        _, first, group = np.unique(codes, return_index=True, return_inverse=True)
        x = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names])
        found = [sums_of(x[group == g]) for g in range(len(first))]
        keys = {n: batch.column(n).take(pa.array(first)) for n in by}
        yield pa.RecordBatch.from_pydict(keys | {"salt": pa.array([salt] * len(first), pa.int32())} | _columns(found))


def _merged(rows: pa.Table, by: Sequence[str]) -> pa.Table:
    total = None
    for n, mean, products in zip(*(rows.column(c).to_pylist() for c in ("n", "mean", "products"))):
        mean = np.array(mean)
        one = (n, mean, np.array(products).reshape(len(mean), len(mean)))
        total = one if total is None else merge(total, one)
    return pa.table({n: rows.column(n)[:1] for n in by} | _columns([total]))


def moments(rows: DataFrame, spec: FeatureSpec = FeatureSpec(), by: Sequence[str] = ()) -> DataFrame:
    """``by``, n, mean and products of the features and, as the last column, the target."""
    names = [*spec.names, spec.target]
    columns = rows.select(*by, *[F.col(n).cast("double").alias(n) for n in names])
    fields = [columns.schema[n] for n in by]
    salted = [*fields, StructField("salt", IntegerType())]
    parts = columns.mapInArrow(lambda it: _partial(it, by, names), _schema(salted))
    apart = parts.groupBy(*by, "salt").applyInArrow(lambda t: _merged(t, by), _schema(fields))
    return merged(apart, by)


def merged(sums: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The sums of all rows with equal ``by``."""
    fields = [sums.schema[n] for n in by]
    keys = [F.col(n) for n in by] if by else [F.lit(0).alias("all")]
    return sums.groupBy(*keys).applyInArrow(lambda t: _merged(t, by), _schema(fields))


def solve(n: int, mean: np.ndarray, products: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
    """Intercept and weights: plain penalty on features scaled to unit spread; a constant one weighs 0."""
    spread = np.sqrt(np.maximum(np.diag(products)[:-1], 0) / n)
    spread[spread <= 1e-9 * np.abs(mean[:-1])] = 0
    scale = np.where(spread > 0, 1 / np.where(spread > 0, spread, 1), 0)
    system = products[:-1, :-1] * np.outer(scale, scale) + alpha * np.eye(len(scale))
    weights = np.linalg.solve(system, products[:-1, -1] * scale) * scale
    return float(mean[-1] - weights @ mean[:-1]), weights


def _solved(batches: Iterator[pa.RecordBatch], by: Sequence[str], alpha: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for n, mean, products in zip(*(batch.column(c).to_pylist() for c in ("n", "mean", "products"))):
            mean = np.array(mean)
            found.append(solve(n, mean, np.array(products).reshape(len(mean), len(mean)), alpha))
        columns = {n: batch.column(n) for n in by}
        columns["Intercept"] = pa.array([i for i, _ in found], pa.float64())
        columns["Weights"] = pa.array([w for _, w in found], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_pydict(columns)


def ridge(sums: DataFrame, alpha: float, by: Sequence[str] = ()) -> DataFrame:
    """``by``, Intercept and Weights (in the order of the features) of each row of sums."""
    fields = [StructField("Intercept", DoubleType()), StructField("Weights", ArrayType(DoubleType()))]
    schema = StructType([*[sums.schema[n] for n in by], *fields])
    return sums.mapInArrow(lambda it: _solved(it, by, alpha), schema)


def coefficients(models: DataFrame, spec: FeatureSpec = FeatureSpec(), by: Sequence[str] = ()) -> DataFrame:
    """``by``, Feature and Weight, a row for each feature and one for the intercept."""
    pairs = [F.struct(F.lit(n).alias("Feature"), F.col("Weights")[i].alias("Weight")) for i, n in enumerate(spec.names)]
    pairs.append(F.struct(F.lit("Intercept").alias("Feature"), F.col("Intercept").alias("Weight")))
    return models.select(*by, F.inline(F.array(*pairs)))


def linear(values: Sequence[Column], weights: Sequence[float] | Column, intercept: float | Column) -> Column:
    """The prediction, of one model as plain numbers or of that in each row."""
    each = [weights[i] if isinstance(weights, Column) else F.lit(float(weights[i])) for i in range(len(values))]
    start = intercept if isinstance(intercept, Column) else F.lit(float(intercept))
    return sum((w * v for w, v in zip(each, values)), start)
