"""Repeated passages against brute force, through every route."""

import collections
import hashlib
import random

import numpy as np
import pytest

from shelfcast.llm import deep_shallow as ds
from shelfcast.llm import repeats, suffix_tree
from shelfcast.llm.queries import QUERIES
from tests.llm.samples import documents, odd_rows, prose


def covered_by_repeats(texts, window):
    """For each sequence, which places a repeated window covers."""
    count = collections.Counter(tuple(t[i : i + window]) for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        mask = [False] * len(t)
        for i in range(len(t) - window + 1):
            if count[tuple(t[i : i + window])] > 1:
                mask[i : i + window] = [True] * window
        out.append(mask)
    return out


def sha(data):
    return hashlib.sha256(data).hexdigest()


def corpus(seed):
    """Copies, copies with edits, shared passages, runs of one word and short periods."""
    rng = random.Random(seed)
    base, passage = prose(rng, 120, 60).split(), prose(rng, 25, 60).split()
    rows = [" ".join(base)] * 3
    for _ in range(8):
        edited = list(base)
        for _ in range(rng.randrange(1, 5)):
            edited[rng.randrange(len(edited))] = f"e{rng.randrange(9)}"
        rows.append(" ".join(edited))
    rows += [" ".join([*prose(rng, rng.randrange(20), 60).split(), *passage, *prose(rng, 9, 60).split()]) for _ in range(8)]
    rows += ["ha " * 40, "ha  " * 25 + "\n ho", "a b c " * 20, "", prose(rng, 5, 60), prose(rng, 200, 4)]
    return list(enumerate(rows)) + odd_rows(rng)


@pytest.mark.parametrize("window, limit", [(10, 20_000), (10, 1), (12, 3)])
def test_words_against_brute_force(spark, window, limit):
    rows = corpus(window)
    kept = suffix_tree.drop_repeats(documents(spark, rows), ["doc_id", "text"], window, limit)
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept_sha256) for r in kept.collect())
    words = [(t or "").split(" ") for _, t in rows]
    words = [[w for part in (t or "").encode().split() for w in [part]] for _, t in rows]
    expected = []
    for (doc_id, _), own, mask in zip(rows, words, covered_by_repeats(words, window)):
        expected.append((doc_id or -1, len(own), sum(mask), sha(b" ".join(w for w, m in zip(own, mask) if not m))))
    assert got == sorted(expected)


def test_cut_text_keeps_what_stands_between(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [(1, f"one\n\ntwo {passage}  three\tfour"), (2, f"{passage} five"), (3, "x  y"), (4, None)]
    kept = suffix_tree.drop_repeats(documents(spark, rows), ["doc_id", "text"], 10)
    assert {r.doc_id: r.text for r in kept.collect()} == {1: "one\n\ntwo three\tfour", 2: "five", 3: "x  y", 4: None}


@pytest.mark.parametrize("window, limit", [(40, 20_000), (40, 1), (90, 4)])
def test_bytes_against_brute_force(spark, window, limit):
    rows = [r for r in corpus(window) if len(r[1] or "") < 20_000]
    kept = ds.drop_repeated_bytes(documents(spark, rows), ["doc_id"], window, limit)
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in kept.collect())
    texts = [(t or "").encode() for _, t in rows]
    expected = []
    for (doc_id, _), own, mask in zip(rows, texts, covered_by_repeats(texts, window)):
        rest = bytes(b for b, m in zip(own, mask) if not m)
        spans = sum(m and not (i and mask[i - 1]) for i, m in enumerate(mask))
        expected.append((doc_id or -1, len(own), sum(mask), spans, sha(rest), rest))
    assert got == sorted(expected)


def test_registered_bytes_query_against_brute_force(spark, root):
    docs = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect()
    seen = collections.Counter()
    texts = [(r.doc_id, (r.text or "").encode()) for r in docs]
    for _, t in texts:
        seen.update(t[i : i + 400] for i in range(len(t) - 399))
    expected = []
    for doc_id, t in texts:
        mask = bytearray(len(t))
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                mask[i : i + 400] = b"\1" * 400
        spans = sum(bool(mask[i]) and not (i and mask[i - 1]) for i in range(len(mask)))
        whole, at = [], 0
        for c in t.decode():
            size = len(c.encode())
            whole += [] if any(mask[at : at + size]) else [c]
            at += size
        expected.append((doc_id, len(t), sum(mask), spans, sha(bytes(b for b, m in zip(t, mask) if not m)), "".join(whole)))
    got = [tuple(r) for r in QUERIES["op7_suffix_array_dedup"](spark, root).collect()]
    assert sorted(got) == sorted(expected)


def test_passage_in_very_many_documents(spark):
    """A passage in every row, most of them past the limit of a group: it goes, what is around it stays."""
    n, passage = 100_000, " ".join(f"p{i}" for i in range(40))
    rows = spark.range(n).selectExpr("id AS doc_id", f"concat('a', id, ' {passage} z', id % 7) AS text")
    # The last word agrees in a seventh of the rows, and so does the passage with it.
    kept = suffix_tree.drop_repeats(rows, ["doc_id", "text"])
    assert kept.where("n_words <> 42 OR n_removed <> 41 OR text <> concat('a', doc_id)").isEmpty()
    assert kept.count() == n
    # Ends of ids that agree go with the passage.
    rest = ds.drop_repeated_bytes(rows.where("doc_id < 5000"), ["doc_id"], 64, with_text=True)
    assert rest.where("n_spans <> 1 OR text NOT RLIKE '^a[0-9]*$'").isEmpty()


def test_listed_windows_need_both_hashes():
    pairs = np.array([[1, 5], [1, 7], [4, 2]], np.uint64)
    asked = np.array([[1, 7], [1, 6], [4, 2], [9, 9], [0, 0], [1, 5]], np.uint64)
    assert repeats._among(asked, pairs).tolist() == [True, False, True, False, False, True]


def test_empty_tables(spark):
    none = documents(spark, [])
    assert suffix_tree.drop_repeats(none, ["doc_id", "text"]).count() == 0
    assert ds.drop_repeated_bytes(none, ["doc_id"]).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_suffix_order(seed):
    rng = random.Random(seed)
    stem = bytes(rng.randrange(2) for _ in range(150))
    texts = [stem[: rng.randrange(151)] + bytes(rng.randrange(3) for _ in range(rng.randrange(60))) for _ in range(60)]
    order = ds.suffix_order(texts)
    assert sorted(order) == list(range(60))
    assert [texts[i] for i in order] == sorted(texts)
    assert [texts[i] for i in ds.blind_trie_order(texts, list(range(60)))] == sorted(texts)
    for a, b in zip(texts, texts[1:]):
        n = ds.common(a, b)
        assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])


def test_prefix_intervals():
    assert sorted(ds.prefix_intervals([2, 5, 5, 1])) == [(1, 0, 5), (2, 0, 4), (5, 1, 4)]


def test_text_keeps_whole_characters_only():
    data = np.frombuffer("aéüz€".encode(), np.uint8)
    for lost in range(len(data)):
        gone = np.arange(len(data)) == lost
        kept = ds.whole_characters(data, gone).decode()
        assert len(kept) == 4 and set(kept) < set("aéüz€")
    assert ds.whole_characters(data, np.zeros(len(data), bool)).decode() == "aéüz€"
    assert ds.whole_characters(data, np.ones(len(data), bool)) == b""
