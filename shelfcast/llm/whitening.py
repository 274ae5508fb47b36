"""Whitening of embeddings from an exact, bit-sliced scatter.

Entries become whole numbers on a grid. In a batch of rows each dimension, less its minimum there,
is cut into bit planes, packed across rows into 64-bit words. The cross-product of two dimensions is
the sum over pairs of their planes of the number of rows with both bits set, weighted by the places
of the bits: an AND and a population count, in whole numbers throughout. Batches add up exactly, in
limbs, whatever their order. The scatter is centred as whole numbers before it becomes a covariance
of doubles, so a large common offset costs no digits.

Defined results: a null vector, or one with a null, NaN or infinite entry, is left out. A vector
shorter than the longest that remains counts as having zeros behind its end. Grid values beyond 2**61 in size
count as 2**61. A component without variance has null whitened values and no part in the identity
error; a squared deviation beyond 64 bits is null. Without rows there is no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from shelfcast.llm.totals import SCHEMA, add_up, parts

# The grid: x = floor(STEPS * entry) + OFFSET.
STEPS, OFFSET = 64, 1_000_000
MOST = 1 << 61
COMPONENTS = 32
# Entries handled at a time.
ENTRIES = 1 << 21
# Sums travel as LIMBS whole numbers of LIMB bits each, all with the sign of the sum.
LIMB, LIMBS = 32, 6
PART_COUNTS = 1 << 12
# Products of whitened values are added up in steps of 1 / FINE.
FINE = 1 << 32


# ---- vectors of a batch ----------------------------------------------------------------


def _pieces(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, ENTRIES // max(width, 1))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def grid(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that remain, their grid values less OFFSET), one row of ``width`` whole numbers each."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten()
    missing = flat.is_null().to_numpy(zero_copy_only=False)
    entries = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    bad = missing | ~np.isfinite(entries)
    good = vectors.is_valid().to_numpy(zero_copy_only=False) & (np.bincount(row[bad], minlength=len(sizes)) == 0)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    whole = np.zeros((len(sizes), width), np.int64)
    with np.errstate(over="ignore"):
        steps = np.floor(np.where(bad, 0.0, entries) * STEPS)
    whole[row, place] = np.clip(steps, -MOST, MOST).astype(np.int64)
    return np.flatnonzero(good), whole[good]


# ---- the scatter -----------------------------------------------------------------------


def bit_planes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(planes, dimension of each, bit of each) of whole numbers from 0 on, without planes of zeros.

    A plane holds one bit of each row, 64 rows a word.
    """
    rows, width = values.shape
    top = int(values.max(initial=0)).bit_length()
    words = -(-rows // 64)
    planes = np.zeros((width, top, words * 8), np.uint8)
    turned = np.ascontiguousarray(values.T)
    for bit in range(top):
        packed = np.packbits(((turned >> bit) & 1).astype(np.uint8), axis=1)
        planes[:, bit, : packed.shape[1]] = packed
    planes = planes.reshape(width * top, words * 8).view(np.uint64)
    used = np.flatnonzero(planes.any(axis=1))
    return planes[used], used // max(top, 1), used % max(top, 1)


def scatter(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, sums of products) of the columns of whole numbers, exact, as Python integers."""
    rows, width = values.shape
    least = values.min(axis=0) if rows else np.zeros(width, np.int64)
    planes, dimension, bit = bit_planes(values - least)
    # 64 bits hold the weighted counts of a batch unless values are far apart.
    wide = rows << (2 * int(bit.max(initial=0)) + 2) >= 1 << 62
    kind = object if wide else np.int64
    weight = np.array([1 << int(b) for b in bit], kind)
    half = np.zeros((width, width), kind)
    sums, squares = np.zeros(width, kind), np.zeros(width, kind)
    for q in range(len(planes)):
        counts = np.bitwise_count(planes[q:] & planes[q]).sum(axis=1, dtype=np.int64)
        weighted = counts.astype(kind) * weight[q:] * weight[q]
        first = np.flatnonzero(np.diff(dimension[q:], prepend=-1))
        half[dimension[q], dimension[q:][first]] += np.add.reduceat(weighted, first)
        sums[dimension[q]] += int(counts[0]) * weight[q]
        squares[dimension[q]] += weighted[0]
    products = half + half.T
    # Both halves hold a plane's product with itself.
    products[np.arange(width), np.arange(width)] -= squares
    sums, products, least = sums.astype(object), products.astype(object), least.astype(object)
    across = np.outer(least, sums)
    return sums + rows * least, products + across + across.T + rows * np.outer(least, least)


def _limbs(numbers: np.ndarray) -> np.ndarray:
    """Whole numbers of any size, one row for each limb, padded to full parts."""
    out = np.zeros((LIMBS, -(-len(numbers) // PART_COUNTS) * PART_COUNTS), np.int64)
    for k, value in enumerate(numbers):
        sign, rest, limb = (-1 if value < 0 else 1), abs(int(value)), 0
        while rest:
            out[limb, k] = sign * (rest & ((1 << LIMB) - 1))
            rest, limb = rest >> LIMB, limb + 1
    return out


def _scatter_rows(batches: Iterator[pa.RecordBatch], vector: str, width: int) -> Iterator[pa.RecordBatch]:
    """This task's number of rows, sums and sums of products."""
    total = np.zeros(1 + width + width * width, object)
    for piece in _pieces(batches, width):
        _, values = grid(piece.column(vector), width)
        if len(values):
            sums, products = scatter(values)
            total += np.concatenate([np.array([len(values)], object), sums, products.ravel()])
    yield parts(_limbs(total), PART_COUNTS)


# ---- the model -------------------------------------------------------------------------


@dataclass
class Whitening:
    """What turns vectors into whitened components."""

    width: int
    n: int
    sums: np.ndarray  # of grid values less OFFSET, as Python integers
    directions: np.ndarray  # one column for each component
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    @property
    def steady(self) -> np.ndarray:
        """Which components have variance; beyond rounding, the others have none."""
        return self.variances > 1e-13 * max(self.width, 1) * self.variances.max(initial=0)

    def deviations(self, values: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: 64-bit numbers if they hold it and their squares, else Python's."""
        most = max((abs(int(s)) for s in self.sums), default=0) + self.n * int(np.abs(values).max(initial=0))
        kind = np.int64 if self.width * most * most < 1 << 62 else object
        return values.astype(kind) * self.n - self.sums.astype(kind)

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        """Components of unit variance, from deviations; 0 where there is no variance."""
        scale = np.where(self.steady, 1 / np.sqrt(np.where(self.steady, self.variances, 1)), 0)
        return (deviations / self.n).astype(np.float64) @ (self.directions * scale)


def principal(n: int, sums: np.ndarray, products: np.ndarray, components: int) -> Whitening:
    """Eigenvectors of the covariance, in falling order of variance.

    A vector's largest entry is positive, so that signs do not change between runs.
    """
    width = len(sums)
    centred = n * products - np.outer(sums, sums)
    # Division of Python integers rounds once.
    covariance = np.array([[a / (n * n) for a in row] for row in centred], np.float64).reshape(width, width)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = np.maximum(values[::-1], 0)[:components], vectors[:, ::-1][:, :components]
    if width:
        largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
        vectors = vectors * np.where(largest < 0, -1.0, 1.0)
    trace = sum(centred[i, i] for i in range(width)) / (n * n)
    return Whitening(width, n, sums, vectors, values, values / trace if trace else values)


def _product_rows(batches: Iterator[pa.RecordBatch], vector: str, model: Whitening) -> Iterator[pa.RecordBatch]:
    """This task's sums of the whitened values and of their products."""
    count = len(model.variances)
    total = np.zeros(count + count * count)
    for piece in _pieces(batches, model.width):
        _, values = grid(piece.column(vector), model.width)
        white = model.whitened(model.deviations(values))
        total += np.concatenate([white.sum(axis=0), (white.T @ white).ravel()])
    whole = np.zeros(-(-len(total) // PART_COUNTS) * PART_COUNTS, np.int64)
    whole[: len(total)] = np.rint(total * FINE)
    yield parts(whole, PART_COUNTS)


def _remains(vector: Column) -> Column:
    """Whether a vector has neither nulls nor NaN (the largest number to Spark) nor infinite entries."""
    infinite = F.lit(float("inf"))
    whole = F.size(F.array_compact(vector)) == F.size(vector)
    return whole & ((F.size(vector) == 0) | ((F.array_max(vector) < infinite) & (F.array_min(vector) > -infinite)))


def fit(embeddings: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all vectors that remain; None if there are none, or none has an entry.

    What comes to the driver is one sum for each pair of dimensions.
    """
    only = embeddings.select(F.col(vector).alias("vector"))
    width = only.agg(F.max(F.when(_remains(F.col("vector")), F.size("vector")))).first()[0]
    if not width:
        return None
    numbers = 1 + width + width * width
    padded = -(-numbers // PART_COUNTS) * PART_COUNTS
    limbs = add_up(only.mapInArrow(lambda it: _scatter_rows(it, "vector", width), SCHEMA), (LIMBS, padded), PART_COUNTS)
    total = sum(limbs[k, :numbers].astype(object) << (LIMB * k) for k in range(LIMBS))
    n = int(total[0])
    if not n:
        return None
    model = principal(n, total[1 : 1 + width], total[1 + width :].reshape(width, width), components)
    count = len(model.variances)
    size = -(-(count + count * count) // PART_COUNTS) * PART_COUNTS
    sums = add_up(only.mapInArrow(lambda it: _product_rows(it, "vector", model), SCHEMA), (size,), PART_COUNTS) / FINE / n
    mean, products = sums[:count], sums[count : count + count * count].reshape(count, count)
    off = np.abs(products - np.outer(mean, mean) - np.eye(count))[np.ix_(model.steady, model.steady)]
    model.identity_error = float(off.max(initial=0))
    return model


# ---- the result ------------------------------------------------------------------------


def _white_rows(batches: Iterator[pa.RecordBatch], model: Whitening, names: list[str]) -> Iterator[pa.RecordBatch]:
    count = len(model.variances)
    for piece in _pieces(batches, model.width):
        rows, values = grid(piece.column("_vector"), model.width)
        deviations = model.deviations(values)
        white = model.whitened(deviations)
        squares = (deviations * deviations).sum(axis=1)
        absent = np.tile(~model.steady, len(rows))
        lists = pa.ListArray.from_arrays(
            pa.array(np.arange(len(rows) + 1) * count, pa.int32()), pa.array(white.ravel(), pa.float64(), mask=absent)
        )
        columns = {n: piece.column(n).take(pa.array(rows)) for n in names}
        exact = pa.array([int(s) if s < 1 << 63 else None for s in squares], pa.int64())
        yield pa.RecordBatch.from_pydict(columns | {"deviation": exact, "whitened": lists})


def whiten(embeddings: DataFrame, model: Whitening | None, columns: list[str], vector: str = "embedding") -> DataFrame:
    """``columns`` of every vector that remains, ``deviation`` (the sum of squares of n * x - sums) and
    ``whitened``, an entry for each component. Neither name can be among ``columns``."""
    chosen = embeddings.select(*columns, F.col(vector).alias("_vector"))
    kept = chosen.select(*columns).schema.fields
    schema = StructType([*kept, StructField("deviation", LongType()), StructField("whitened", ArrayType(DoubleType()))])
    if model is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    return chosen.mapInArrow(lambda it: _white_rows(it, model, columns), schema)


def components(embeddings: DataFrame, vector: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """One row for each vector that remains and component, numbered from 1 by falling variance."""
    model = fit(embeddings, vector, count)
    rows = whiten(embeddings, model, ["vec_id"], vector).select("vec_id", "deviation", F.posexplode("whitened").alias("_place", "whitened"))
    share = model.explained.tolist() if model else [0.0]
    return rows.select(
        "vec_id",
        (F.col("_place") + 1).cast("int").alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.array(*[F.lit(s) for s in share])[F.col("_place")].alias("explained"),
        F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )
