"""Merkle manifests against plain recursion."""

import hashlib
import random
import zlib

import pytest

from shelfcast.llm import merkle
from tests.llm.samples import documents, odd_rows


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row):
    return h(*[field(row[n]) for n in ("doc_id", "source", "lang", "n_chars", "text")])


def parent_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i : i + 3]) for i in range(0, len(below), 3)])
    return levels


def way(levels, place):
    """The runs above a node, each with its own place in it."""
    for level in levels[:-1]:
        first = place - place % 3
        yield level[first : first + 3], place - first
        place //= 3


def brute_force(rows):
    """Sorted rows of the manifest."""
    trees = {}
    for row in rows:
        trees.setdefault(row["source"], []).append((row["doc_id"] is not None, row["doc_id"] or 0, leaf(row), row))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    levels = {s: parent_levels([x[2] for x in sorted(trees[s], key=lambda x: x[:3])]) for s in names}
    top = parent_levels([levels[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for place, (_, _, digest, row) in enumerate(sorted(trees[s], key=lambda x: x[:3])):
            steps = [*way(levels[s], place), *way(top, k)]
            proof = [d for run, own in steps for i, d in enumerate(run) if i != own]
            seen = row.asDict()
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0 and row["text"]:
                seen["text"] = row["text"].replace("\n", "")
            folded = leaf(seen)
            for run, own in steps:
                folded = h(*[folded if i == own else d for i, d in enumerate(run)])
            out.append((row["doc_id"], digest, levels[s][-1][0], top[-1][0], h(*proof), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def found(frame):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=repr)


def some_documents(seed, counts):
    rng = random.Random(seed)
    rows = []
    for source, count in counts.items():
        rows += [(rng.randrange(10**6), rng.choice(["a\nb", "plain", "\n", "x y\nz"]) + str(rng.random()), source) for _ in range(count)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(
    "counts",
    [{"a": 1}, {"a": 1, "": 3, None: 10, "é": 28}, {f"s{i}": 1 + i % 3 for i in range(11)}],
)
def test_small_trees(spark, counts):
    frame = documents(spark, some_documents(len(counts), counts))
    rows = frame.collect()
    assert found(merkle.verified(frame)) == brute_force(rows)


def test_odd_rows(spark):
    frame = documents(spark, odd_rows(random.Random(3)) + [(None, "a\nb", None)] * 2)
    assert found(merkle.verified(frame)) == brute_force(frame.collect())


def test_one_source_larger_than_a_group(spark):
    """A tree of several groups, whose last has one node, beside small ones."""
    frame = documents(spark, some_documents(1, {"hot": 2 * 729 + 1, "b": 729, "c": 728, "d": 1}))
    result = found(merkle.verified(frame))
    assert result == brute_force(frame.collect())
    assert {r[-1] for r in result} == {True, False}


def test_many_rounds_and_equal_rows(spark):
    """Groups of one level: as many rounds as levels; a third of the rows are equal."""
    rows = some_documents(5, {"hot": 60, "b": 9, "c": 5}) + [(7, "same", "hot")] * 37
    frame = documents(spark, rows).withColumnRenamed("payload", "tree").withColumnRenamed("band", "place")
    leaves = frame.select("doc_id", "source", "tree", "place", merkle.leaf([frame[n] for n in merkle.FIELDS]).alias("leaf"))
    result = merkle.manifest(leaves, "source", ["doc_id"], levels=1)
    assert result.columns == ["doc_id", "source", "tree", "place", "leaf", "subroot", "root", "proof"]
    proofs = sorted((r.doc_id, r.leaf, r.subroot, r.root, h(r.proof.replace(",", "").replace("*", ""))) for r in result.collect())
    assert proofs == sorted(r[:5] for r in brute_force(frame.collect()))


def test_no_documents(spark):
    assert merkle.verified(documents(spark, [])).count() == 0


def test_proofs_of_a_group():
    digests = [h(str(i)) for i in range(10)]
    tree = merkle.sweep_up(digests, 3)
    assert [len(level) for level in tree] == [10, 4, 2, 1]
    assert tree[-1][0] == parent_levels(digests)[-1][0]
    proofs = merkle.sweep_down(tree, "up*")
    assert proofs[9] == f"*,*,{tree[2][0]}*,up*"
    assert proofs[1] == f"{digests[0]}*{digests[2]},*{tree[1][1]}{tree[1][2]},*{tree[2][1]},up*"
