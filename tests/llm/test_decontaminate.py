"""The positional index: phrases, proximity, item blocks and odd rows."""

import random
import re

import pytest

from shelfcast.llm import decontaminate as dc
from shelfcast.session import scratch_path
from tests.llm.samples import documents, odd_rows, prose


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def items(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, doc_id string")


def phrases(benchmark, size):
    for item, text in benchmark:
        own = words(text)
        n = min(size, len(own))
        for i in range(len(own) - n + 1 if own else 0):
            yield item, own[i : i + n]


def brute(rows, benchmark, size, slop=None):
    out = []
    for doc_id, text in rows:
        own, hit, found = words(text), set(), set()
        for item, phrase in phrases(benchmark, size):
            n, reach = len(phrase), len(phrase) + (slop or 0)
            for i in range(len(own)):
                if slop is None and own[i : i + n] == phrase or slop is not None and own[i] in phrase and set(phrase) <= set(own[i : i + reach]):
                    hit.update(range(i, min(i + reach, len(own))))
                    found.add(str(item))
        out.append((doc_id, len(own), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(own)))
    return sorted(out, key=repr)


def results(frame):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("slop", [None, 0, 3])
@pytest.mark.parametrize("block", [1 << 20, 10])
def test_against_brute_force(spark, monkeypatch, slop, block):
    monkeypatch.setattr(dc, "BLOCK_WORDS", block)
    rng = random.Random(3)
    bench = [(i, prose(rng, rng.choice([3, 6, 14]), 12)) for i in range(6)] + [(7, ""), (8, None), (2, "w1 w2"), (9, "W3-w4, w5")]
    rows = odd_rows(rng)[:4] + odd_rows(rng)[5:] + [(20 + i, prose(rng, 60, 12)) for i in range(12)]
    rows += [(40, f"{prose(rng, 30)} {bench[2][1]} {prose(rng, 9)}"), (41, "W3 w4"), (41, "w5 w3 w4"), (42, "w3!W4?w5")]
    found = dc.contamination(documents(spark, rows), items(spark, [*bench, (None, "w1 w2 w3")]), 6, slop)
    assert results(found) == brute(rows, bench, 6, slop)


def test_shards_do_not_change_results(spark, monkeypatch):
    rng = random.Random(4)
    bench = [(i, prose(rng, 8, 6)) for i in range(5)]
    rows = [(i, prose(rng, 40, 6)) for i in range(30)]
    monkeypatch.setattr(dc, "SHARD_BYTES", 200)
    assert results(dc.contamination(documents(spark, rows), items(spark, bench), 4)) == brute(rows, bench, 4)


def test_long_items_are_cut_into_blocks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_WORDS", 40)
    rng = random.Random(6)
    bench = [(1, prose(rng, 1000, 400)), (2, prose(rng, 39)), (3, prose(rng, 41)), (4, prose(rng, 5)), (5, prose(rng, 40))]
    blocks = list(dc.item_blocks(items(spark, bench), 13))
    assert len(blocks) > 30 and all(len(b.words) <= 40 for b in blocks)
    found = {i: set() for i, _ in bench}
    for block in blocks:
        for at, n, run in zip(*block.windows()):
            found[int(block.items[run])].add(tuple(block.terms[block.words[at : at + n]].tolist()))
    assert [len(found[i]) for i, _ in bench] == [len({tuple(p) for _, p in phrases([b], 13)}) for b in bench]
    rows = [(9, f"{prose(rng, 30)} {' '.join(bench[0][1].split()[k : k + 13])} {prose(rng, 9)}") for k in range(0, 988, 7)]
    assert results(dc.contamination(documents(spark, rows), items(spark, bench))) == brute(rows, bench, 13)


def test_the_index_holds_every_word(spark):
    rows = odd_rows(random.Random(5))
    index = dc.build_index(documents(spark, rows), scratch_path(spark, "index"))
    shards = [dc.Shard(r.asDict()) for r in index.collect()]
    assert sum(len(s.gaps) for s in shards) == sum(len(words(t)) for _, t in rows)
    for shard in shards:
        assert sorted(p for k in range(len(shard.terms)) for p in shard.places(k).tolist()) == list(range(len(shard.gaps)))


def test_empty_tables(spark):
    some, none = documents(spark, [(1, "a b"), (2, None)]), items(spark, [])
    assert results(dc.contamination(some, none)) == [(1, 2, 0, [], False), (2, 0, 0, [], False)]
    assert dc.contamination(documents(spark, []), items(spark, [(1, "a")])).count() == 0
