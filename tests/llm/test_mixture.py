"""Budgets, the knapsack, and the mix."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfcast.llm import mixture
from shelfcast.llm.queries import QUERIES
from tests.llm.samples import documents, odd_rows, prose


def shared_out(sizes, weights=mixture.WEIGHTS, most=mixture.MOST_COPIES):
    """The targets by sharing again and again. ``sizes`` has the size of each source, None the last."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [n for n in sizes if n is None]
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[n] for n in free)
        stopped = [n for n in free if level * weight[n] > most * sizes[n]]
        if not stopped:
            return target | {n: level * weight[n] for n in free}
        for n in stopped:
            target[n] = float(most * sizes[n])
            left -= most * sizes[n]
            free.discard(n)
    return target


def best_sum(sizes, counts, budget):
    sums = {0}
    for s, c in zip(sizes, counts):
        sums = {a + k * s for a in sums for k in range(c + 1) if a + k * s <= budget}
    return max(sums)


@settings(max_examples=120, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 6), min_size=1, max_size=6), st.integers(0, 200))
def test_knapsack_reaches_the_best_sum(table, budget):
    sizes, counts = (np.array(x, np.int64) for x in zip(*table.items()))
    chosen = mixture._knapsack(sizes, counts, budget)
    assert (chosen >= 0).all() and (chosen <= counts).all()
    assert int((sizes * chosen).sum()) == best_sum(sizes.tolist(), counts.tolist(), budget)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 4000), st.integers(1, 500), min_size=1, max_size=60), st.floats(0, 1.2))
def test_fitted_counts_stay_within_their_bounds(table, share):
    sizes, counts = (np.array(x, np.int64) for x in zip(*table.items()))
    total = int((sizes * counts).sum())
    budget = int(share * total)
    chosen = mixture.fit_counts(sizes, counts, budget)
    taken = int((sizes * chosen).sum())
    assert (chosen >= 0).all() and (chosen <= counts).all()
    assert taken <= max(budget, 0) and (taken == total or budget - taken < sizes.max())


def test_large_budgets_keep_to_the_reach(monkeypatch):
    monkeypatch.setattr(mixture, "REACH", 50)
    sizes, counts = np.array([7, 11, 400]), np.array([30, 30, 9])
    chosen = mixture.fit_counts(sizes, counts, 1500)
    assert int((sizes * chosen).sum()) == 1500 and (chosen <= counts).all()


@pytest.mark.parametrize("count", [2, 7])
def test_every_size_gets_its_share(count):
    """Many distinct sizes: the rounded-off words are millions, and must not go to the longest documents."""
    sizes = np.arange(1, 6001)
    counts = np.full(len(sizes), count)
    budget = int((sizes * counts).sum()) * 3 // 5
    chosen = mixture.fit_counts(sizes, counts, budget)
    assert int((sizes * chosen).sum()) == budget
    for part in np.array_split(np.arange(len(sizes)), 10):
        assert abs(chosen[part].sum() / counts[part].sum() - 0.6) < 0.05


CASES = [
    {"a": 100, "b": 100, "c": 100},
    {"a": 10, "b": 1000, "c": 1, "d": 50, None: 300},
    {"a": 0, "b": 40},
    {"z": 5, "Z": 6, "é": 7, "\U0001f600": 8, "￿": 900, None: 2},
    {None: 9},
    {"a": 0, None: 0},
]


@pytest.mark.parametrize("sizes", CASES)
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixture.targets(frame).collect()}
    assert got == pytest.approx(shared_out(sizes))


def check(rows, got, keys):
    """``got``: (key, source, size, source_size, target, copies)."""
    by_source = defaultdict(int)
    for _, text, source in rows:
        by_source[source] += len((text or "").split())
    target = shared_out(by_source)
    assert Counter(g[0] for g in got) == Counter(keys)
    taken = defaultdict(int)
    for _, source, size, source_size, t, copies in got:
        assert source_size == by_source[source] and t == pytest.approx(target[source])
        assert 0 <= copies <= 3 and (size or not copies)
        taken[source] += size * copies
    longest = max((g[2] for g in got), default=0)
    for source, t in target.items():
        assert abs(taken[source] - t) <= max(1, min(longest, t))
    return taken, target


def test_mix_of_odd_rows(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randrange(1, 40)), f"s{i % 4}") for i in range(300)]
    rows += [(i, t, s) for (i, t), s in zip(odd_rows(rng), ["s1", None, "s2", "tiny", "s3", "s1", "s1", None, None, "s2", "tiny", "tiny"])]
    frame = documents(spark, rows)
    got = [(r.doc_id, r.source, r.size, r.source_size, r.target, r.copies) for r in mixture.mixed(frame).collect()]
    taken, target = check(rows, got, [r[0] for r in rows])
    assert all(abs(taken[s] - target[s]) <= 1 for s in ("s0", "s1", "s2"))
    again = [(r.doc_id, r.source, r.size, r.source_size, r.target, r.copies) for r in mixture.mixed(frame.repartition(7)).collect()]
    assert sorted(got, key=repr) == sorted(again, key=repr)


def test_documents_of_one_size_and_repeated_ids(spark):
    rows = [(i % 90, "one two three", "a") for i in range(400)] + [(500 + i, "x " * 50, "b") for i in range(100)]
    got = [(r.doc_id, r.source, r.size, r.source_size, r.target, r.copies) for r in mixture.mixed(documents(spark, rows)).collect()]
    check(rows, got, [r[0] for r in rows])


def test_taken_documents_keep_their_columns(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randrange(1, 30)), f"s{i % 3}") for i in range(90)]
    docs = documents(spark, rows).drop("copies")
    taken = {r.doc_id: r for r in mixture.mixed_documents(docs).collect()}
    assert {r.doc_id: r.copies for r in mixture.mixed(docs).where("copies > 0").collect()} == {i: r.copies for i, r in taken.items()}
    for r in taken.values():
        assert (r.text, r.source) == rows[r.doc_id][1:] and r.block == "x"


def test_empty_table(spark):
    assert mixture.mixed(documents(spark, [])).count() == 0


def test_registered_query(spark, root):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{root}/documents.parquet").collect()]
    found = QUERIES["op8_source_mixing"](spark, root).collect()
    source = {r[0]: r[2] for r in rows}
    got = [(r.doc_id, source[r.doc_id], r.size, r.source_size, r.target, r.taken // r.size if r.size else 0) for r in found]
    check(rows, got, [r[0] for r in rows])
