"""Language identification: sums over segmentations against plain recursion, held-out accuracy, odd rows."""

import random
import zlib
from functools import cache

import numpy as np
import pytest

from shelfcast.llm import language
from shelfcast.llm.queries import QUERIES
from tests.llm.samples import documents, odd_rows

LARGER = "/root/testdata/sf0.01"


def segmentations(text, names):
    """All ways to cut a text into pieces."""
    if not text:
        yield ()
    for n in names:
        if text.startswith(n):
            for rest in segmentations(text[len(n) :], names):
                yield (n, *rest)


def small_model(seed=0):
    rng = np.random.default_rng(seed)
    pieces = language.Pieces.of([b"ab", b" a", b" ab", b"bab", b"ba", b" abab", "é".encode(), b"x1", b"A", b"a b"])
    chances = rng.random((len(pieces), 2))
    return language.Languages(pieces, ["p", "q"], chances / chances.sum(axis=0))


UNITS = [b"abab", b"bab", b"a", b"\xc3\xa9ab", b"babab"]


def test_pieces_that_can_occur():
    names = small_model().pieces.names
    assert {b"ab", b" abab", "é".encode(), b" ", b"z", b"\xff"} <= set(names)
    assert not {b"x1", b"A", b"a b"} & set(names)
    assert len(names) == 26 + 128 + 1 + 7


def test_forward_sums_over_all_segmentations():
    model = small_model()
    units, which, text = language.units_of(UNITS)
    sums = language.totals_of(units, language.forward(units, model.pieces, model.chances))
    place = {n: i for i, n in enumerate(model.pieces.names)}
    usable = [n for n in place if len(n) > 1 or n in (b" ", b"a", b"b", b"\xc3", b"\xa9")]
    assert text.tolist() == list(range(len(UNITS)))
    for unit, k in zip(UNITS, which):
        cuts = list(segmentations(b" " + unit, usable))
        assert len(cuts) > 1
        assert np.allclose(sums[k], sum(np.prod([model.chances[place[n]] for n in cut], axis=0) for cut in cuts))


def test_expected_pieces_over_all_segmentations():
    model = small_model(3)
    units, which, _ = language.units_of(UNITS)
    weight = np.random.default_rng(1).random((len(units), 2))
    place = {n: i for i, n in enumerate(model.pieces.names)}
    usable = [n for n in place if len(n) > 1 or n in (b" ", b"a", b"b", b"\xc3", b"\xa9")]
    wanted = np.zeros((2, len(place)))
    for unit, k in zip(UNITS, which):
        for language_ in range(2):
            cuts = list(segmentations(b" " + unit, usable))
            chance = [np.prod([model.chances[place[n], language_] for n in cut]) for cut in cuts]
            for cut, c in zip(cuts, chance):
                for n in cut:
                    wanted[language_, place[n]] += weight[k, language_] * c / sum(chance)
    assert np.allclose(language.expected(units, model.pieces, model.chances, weight), wanted)


def test_long_runs_are_stretches():
    units, which, text = language.units_of([b"a" * 70 + b" b", None, b"", b"12 3", b"a" * 31])
    assert text.tolist() == [0, 0, 0, 0, 4]
    assert units.lengths[which].tolist() == [32, 32, 9, 2, 32]
    assert which[0] == which[1] == which[4]


def test_memory_gives_the_same():
    model = small_model(5)
    memory = language.Memory(model)
    texts = [[b"ab ba", b"bab"], [b"ba abab", None], [b"bab ab ba"]]
    for part in texts:
        assert np.allclose(language.text_logs(part, memory), language.text_logs(part, language.Memory(model)))


def test_probabilities_are_mixed_and_add_up():
    chances = language.mixed(np.array([[4.0, 0.0, 0.0, 4.0], [0.0, 0.0, 0.0, 0.0]]))
    assert np.allclose(chances.sum(axis=0), 1) and chances.min() >= language.POOLED * language.EQUAL / 4
    assert np.allclose(language.mixed(np.zeros((2, 4))), 0.25)


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_held_out_accuracy_of_the_registered_query(spark):
    found = QUERIES["op13_language_id"](spark, LARGER)
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    rows = found.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    unseen = [r.lang_pred == r.lang for r in rows if r.held_out]
    assert len(unseen) > 200 and np.mean(unseen) >= 0.98


@cache
def lexicon(name):
    rng = random.Random(name)
    return ["".join(rng.choice("abcdefghij" if name == "one" else "hijklmnopé") for _ in range(rng.randrange(2, 8))) for _ in range(60)]


def corpus():
    rng = random.Random(9)
    rows = []
    for i in range(120):
        name = ("one", "two")[i % 2]
        rows.append((100 + i, " ".join(rng.choice(lexicon(name)) for _ in range(rng.randrange(3, 60))), name))
    return rows


def with_languages(spark, rows, odd=()):
    frame = documents(spark, [(i, t) for i, t, _ in rows] + list(odd))
    names = spark.createDataFrame([(i, n) for i, _, n in rows], "doc_id long, own string")
    joined = frame.drop("lang").join(names.withColumnRenamed("own", "lang"), "doc_id", "left")
    return joined.withColumnRenamed("band", "lang_pred").withColumnRenamed("kept", "_text")


def test_odd_rows(spark):
    odd = [*odd_rows(random.Random(1)), (20, "123 --- !"), (21, "！１２"), (22, "É"), (23, "ab" * 500_000)]
    found = language.judged(with_languages(spark, corpus(), odd)).collect()
    assert len(found) == 120 + len(odd)
    assert found[0].asDict().keys() == {"doc_id", "held_out", "lang_pred", "score"}
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append(r)
    for i in (1, 2, 3, 20, 21):
        assert [(r.lang_pred, r.score) for r in by_id[i]] == [("und", 0.0)]
    assert all(r.lang_pred in ("one", "two") and 0.5 <= r.score <= 1 for i in (4, 5, 6, 9, 22, 23) for r in by_id[i])
    assert by_id[23][0].lang_pred == "one" and by_id[22][0].lang_pred == "two"
    assert len({r.score for r in by_id[5]}) == 1
    names = {i: n for i, _, n in corpus()}
    assert np.mean([by_id[i][0].lang_pred == n for i, n in names.items() if held(i)]) >= 0.95


def test_held_out_languages_do_not_count(spark):
    rows = corpus()
    flipped = [(i, t, "other" if held(i) else n) for i, t, n in rows]
    first = sorted((r.doc_id, r.lang_pred, r.score) for r in language.judged(with_languages(spark, rows)).collect())
    assert first == sorted((r.doc_id, r.lang_pred, r.score) for r in language.judged(with_languages(spark, flipped)).collect())


@pytest.mark.parametrize("rows", [[], [(1, "a b", None), (2, None, "one")]])
def test_nothing_to_learn(spark, rows):
    found = language.judged(with_languages(spark, rows)).collect()
    assert [(r.lang_pred, r.score) for r in found] == [("und", 0.0)] * len(rows)
