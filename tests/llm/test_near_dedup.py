"""Weighted MinHash: the signatures, the classes, and components."""

import random
from collections import Counter

import numpy as np
import pytest

from shelfcast.llm import components
from shelfcast.llm import dart_minhash as dm
from shelfcast.llm.components import connected_components
from shelfcast.session import settle
from tests.llm.samples import documents, odd_rows, prose


def shingles(text):
    own = (text or "").split()
    return Counter(tuple(own[i : i + 5]) for i in range(max(len(own) - 4, 1))) if own else Counter()


def jaccard(a, b):
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


def classes(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and (rows[i][1] == rows[j][1] or jaccard(sets[i], sets[j]) >= threshold) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if c == old else c for c in label]
    ids = {c: min((r[0] for r, d in zip(rows, label) if d == c and r[0] is not None), default=None) for c in label}
    return sorted(((r[0], ids[c], label.count(c)) for r, c in zip(rows, label)), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    rows = odd_rows(rng)
    for k in range(6):
        base = prose(rng, rng.choice([4, 30, 150]), 500).split()
        for c in range(7):
            edited = list(base)
            for _ in range(rng.randrange(4)):
                edited[rng.randrange(len(edited))] = f"e{rng.randrange(999)}"
            rows.append((100 * k + c + 20, " ".join(edited)))
    rows += [(900 + i, f"{'same words again and again in all of these ' * 4}{prose(rng, 12)}") for i in range(12)]
    return rows


@pytest.mark.parametrize("seed, block", [(1, 2048), (2, 3)])
def test_classes_against_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(dm, "BLOCK", block)
    rows = corpus(seed)
    found = dm.near_duplicates(documents(spark, rows))
    got = found.collect()
    assert sorted(((r.doc_id, r.class_id, r.class_size) for r in got), key=repr) == classes(rows)
    assert sum(r.is_first for r in got) == len({(r.class_id, r.row if r.class_id is None else 0) for r in got})


def test_one_of_each_stays(spark):
    rows = corpus(3)
    docs = documents(spark, rows)
    kept = dm.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect() if r.doc_id is not None))
    assert ids == sorted({c for _, c, _ in classes(rows) if c is not None})


def test_matching_coordinates_estimate_similarity():
    rng = random.Random(8)
    base = prose(rng, 300, 30).split()
    other = [*base[:240], *prose(rng, 60, 30).split()]
    heavy = [*base, *base[:100]]
    texts = [" ".join(t) for t in (base, other, heavy)]
    having, signature = dm.signatures([t.encode() for t in texts])
    assert having.tolist() == [0, 1, 2]
    for a, b in ((0, 1), (0, 2), (1, 2)):
        assert abs((signature[a] == signature[b]).mean() - jaccard(shingles(texts[a]), shingles(texts[b]))) < 0.15


def test_signature_of_a_text_does_not_depend_on_others():
    rng = random.Random(9)
    texts = [prose(rng, n).encode() for n in (1, 3, 9, 70, 900)] + [b"la " * 5000, None, b""]
    _, together = dm.signatures(texts)
    for i in range(6):
        assert (dm.signatures([texts[i]])[1][0] == together[i]).all()
    assert (together != 0).all()


def test_darts_fall_as_often_as_areas_say():
    """Summed over shingles, the hits are the area under weight and limit."""
    n = 4000
    shingle = dm.mix(np.arange(n, dtype=np.uint64))
    element, _, rank, _ = dm.throw(shingle, np.full(n, 3), np.full(n, 0.7))
    assert abs(len(element) - n * 3 * 0.7) < 5 * (n * 2.1) ** 0.5
    assert abs(rank.mean() - 0.35) < 0.02


def test_empty_table(spark):
    assert dm.near_duplicates(documents(spark, [])).count() == 0
    assert dm.near_duplicates(documents(spark, [(1, None), (2, "")])).select("class_id").orderBy("class_id").collect() == [(1,), (2,)]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100, 100 + i) for i in range(40)] + [(i, i + 1) for i in range(200, 230)]
    label = {n: n for link in links for n in link}
    for _ in range(len(label)):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    own = {n for a, b in links if a != b for n in (a, b)}
    got = connected_components(spark.createDataFrame(links, "a long, b long"))
    assert sorted(tuple(r) for r in got.collect()) == sorted((n, label[n]) for n in own)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_end_at_stars_and_write_few_files(spark, monkeypatch):
    """A round that changes nothing is not run, and a few links are not dealt to every partition."""
    written = []
    monkeypatch.setattr(components, "settle", lambda df: written.append(settle(df)) or written[-1])
    monkeypatch.setattr(components, "discard", lambda *tables: None)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stars = connected_components(spark.createDataFrame([(1, 5), (6, 1), (7, 2), (2, 7), (3, 3)], "a long, b long")).collect()
        assert sorted(tuple(r) for r in stars) == [(1, 1), (2, 2), (5, 1), (6, 1), (7, 2)] and len(written) == 1
        chain = connected_components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")).collect()
        assert sorted(tuple(r) for r in chain) == [(i, 0) for i in range(41)]
        assert len(written) > 4 and {len(t.inputFiles()) for t in written[2:]} == {1}
        assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
