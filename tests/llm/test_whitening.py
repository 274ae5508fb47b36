"""Whitening against whole-number brute force."""

import random
from fractions import Fraction

import numpy as np
import pytest

from shelfcast.llm import whitening
from shelfcast.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, deviation string, whitened string, component string, _vector string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x", "x", "x") for i, v in rows], SCHEMA)


def exact(vectors):
    """(n, sums, covariance as fractions) of grid values by plain Python."""
    rows = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors]
    n, width = len(rows), len(rows[0])
    sums = [sum(r[i] for r in rows) for i in range(width)]
    cov = [[Fraction(sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in rows), n**3) for j in range(width)] for i in range(width)]
    return rows, n, sums, cov


def check(found, vectors_by_id, count=32):
    ids, vectors = zip(*vectors_by_id)
    rows, n, sums, cov = exact(vectors)
    width = len(sums)
    number = min(count, width)
    assert len(found) == len(rows) * number
    v = np.array([[float(c) for c in row] for row in cov])
    values = np.linalg.eigvalsh(v)[::-1]
    trace = float(sum(cov[i][i] for i in range(width)))
    by_component = {}
    for r in found:
        assert r.n == n and abs(r.explained - values[r.component - 1] / trace) <= 1e-9 * r.explained
        assert r.identity_error <= 1e-9
        by_component.setdefault(r.component, {})[r.vec_id] = r
    deviations = {i: sum((n * x - s) ** 2 for x, s in zip(row, sums)) for i, row in zip(ids, rows)}
    assert all(r.deviation == deviations[r.vec_id] for r in found)
    centred = np.array([[float(Fraction(n * x - s, n)) for x, s in zip(row, sums)] for row in rows])
    white = np.array([[by_component[k + 1][i].whitened for k in range(number)] for i in ids])
    # Undoing the scale gives projections on unit eigenvectors of the covariance.
    back = np.linalg.lstsq(centred, white * np.sqrt(values[:number]), rcond=None)[0]
    assert np.allclose(v @ back, back * values[:number], atol=1e-8 * values[0])
    assert np.allclose(back.T @ back, np.eye(number), atol=1e-8)
    assert np.allclose(white.T @ white / n, np.eye(number), atol=1e-9)


def test_registered_query_against_brute_force(spark, root):
    found = QUERIES["op11_whitening"](spark, root).collect()
    rows = spark.read.parquet(f"{root}/embeddings.parquet").collect()
    check(found, [(r.vec_id, r.embedding) for r in rows])


def test_odd_rows(spark):
    rng = random.Random(4)
    good = [(i, [rng.uniform(-3, 3) for _ in range(5)]) for i in range(50)]
    good += [(7, good[7][1]), (None, [1.0, 2.0, 3.0, 4.0, 5.0])]
    bad = [(90, None), (91, [1.0, None, 0.0, 0.0, 0.0]), (92, [float("nan"), 0.0, 0.0, 0.0, 0.0]), (93, [float("-inf")] * 5)]
    short = [(94, [1.0, 2.0]), (95, [])]
    found = whitening.components(table(spark, good + bad + short)).collect()
    padded = [(i, v + [0.0] * (5 - len(v))) for i, v in good + short]
    assert {r.vec_id for r in found} == {i for i, _ in padded}
    assert len(found) == 5 * len(padded)
    check(whitening.components(table(spark, [p for p in padded if p[0] != 7])).collect(), [p for p in padded if p[0] != 7])
    # Repeated rows: equal values.
    twice = {(r.component, r.whitened) for r in found if r.vec_id == 7}
    assert len(twice) == 5


def test_empty_and_flat_tables(spark):
    assert whitening.components(table(spark, [])).count() == 0
    assert whitening.components(table(spark, [(1, None), (2, [None])])).count() == 0
    assert whitening.components(table(spark, [(1, []), (2, [1.0, None])])).count() == 0
    one = whitening.components(table(spark, [(1, [0.5, 0.25])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one)] == [
        (1, 1, 0, None, 0.0, 0.0),
        (2, 1, 0, None, 0.0, 0.0),
    ]
    flat = whitening.components(table(spark, [(i, [float(i), 1.0]) for i in range(9)])).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in flat)
    assert len({r.identity_error for r in flat}) == 1 and flat[0].identity_error < 1e-12


def test_large_entries(spark):
    """Far from zero, and so far apart that 64 bits hold no sum of squares."""
    rng = random.Random(1)
    far = [(i, [5e4 + rng.random(), -3e4 + rng.random(), rng.random()]) for i in range(200)]
    check(whitening.components(table(spark, far)).collect(), far)
    huge = [(i, [rng.uniform(-1, 1) * 1e12, rng.uniform(-1, 1) * 1e30]) for i in range(20)]
    found = whitening.components(table(spark, huge)).collect()
    assert all(r.deviation is None and r.identity_error < 1e-9 for r in found)


@pytest.mark.parametrize("low, high, rows", [(-70, 70, 1000), (0, 1, 3), (-(1 << 61), 1 << 61, 50), (5, 6, 65)])
def test_scatter_against_products(low, high, rows):
    values = np.random.default_rng(rows).integers(low, high, (rows, 7))
    sums, products = whitening.scatter(values)
    whole = values.astype(object)
    assert (sums == whole.sum(axis=0)).all() and (products == whole.T @ whole).all()


def test_limbs_of_any_size():
    numbers = np.array([0, -1, 5, -(1 << 160) + 3, (1 << 150) - 1, 1 << 32], object)
    limbs = whitening._limbs(numbers)
    again = sum(limbs[k, : len(numbers)].astype(object) << (32 * k) for k in range(whitening.LIMBS))
    assert (again == numbers).all()
