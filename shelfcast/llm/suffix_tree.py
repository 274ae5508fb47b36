"""Removal of repeated passages of words with prefix-partitioned suffix trees.

Suffixes (windows) are split by prefixes of variable length into groups that fit in memory
(see ``repeats``). Of each group a suffix tree is built from the root down: the suffixes below a
node are split by the next words, a suffix that is alone leaves as a leaf, and what is still
together after ``window`` words hangs below an internal node of at least that depth: a repeat. The
descent stops there. A longer repeat is the union of such windows, as every place inside it starts a
suffix of its own, so a maximal repeat comes out as a span of covered words, not as a node.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from shelfcast.llm.repeats import Group, Plan, WordSymbols, runs, without_repeats
from shelfcast.llm.words import SPACED, find_words, rolling

# Words on an edge of the tree.
EDGE = 5
GRAM = 8


def deep_suffixes(codes: np.ndarray, suffix: np.ndarray, node: np.ndarray, weight: np.ndarray, depth: int) -> np.ndarray:
    """Which suffixes hang below an internal node of at least ``depth`` symbols.

    ``suffix`` holds where they start in ``codes``, ``node`` the subtree each belongs to and
    ``weight`` how many equal suffixes it stands for. Returns positions in ``suffix``, rising.
    """
    alive = np.arange(len(suffix))
    at = 0
    while at < depth and len(alive):
        step = min(EDGE, depth - at)
        edges = rolling(codes, step)[suffix[alive] + at]
        order = np.lexsort((edges, node))
        alive, node, edges = alive[order], node[order], edges[order]
        first = runs(node, edges)
        sizes = np.diff(np.append(first, len(alive)))
        leaves = np.add.reduceat(weight[alive], first)
        child = np.repeat(np.arange(len(first)), sizes)
        inner = np.repeat(leaves > 1, sizes)
        alive, node = alive[inner], child[inner]
        at += step
    return np.sort(alive)


def solve(groups: list[Group], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of each segment that repeat, by one tree for each group."""
    contents = [c for g in groups for c in g.contents]
    words = find_words(contents, SPACED)
    windows = np.array([w for g in groups for w in g.windows])
    total = np.array([t for g in groups for t in g.totals])
    group = np.repeat(np.arange(len(groups)), [len(g.contents) for g in groups])
    segment = np.repeat(np.arange(len(contents)), windows)
    offset = np.arange(len(segment)) - np.repeat(np.cumsum(windows) - windows, windows)
    deep = deep_suffixes(words.hashes, words.first[segment] + offset, group[segment], total[segment], window)
    segment, offset = segment[deep], offset[deep]
    first = runs(segment, offset - np.arange(len(offset)))
    last = np.append(first[1:], len(segment)) - 1
    return segment[first], offset[first], offset[last] + 1 if len(first) else offset[first]


def _kept(batch: pa.RecordBatch, symbols: WordSymbols, removed: np.ndarray) -> dict:
    words = symbols.words
    data = words.data.tobytes()
    first = words.first.tolist()
    n_removed, n_spans, digests, texts = [], [], [], []
    values = batch.column("text").to_pylist()
    for t, value in enumerate(values):
        a, b = first[t], first[t + 1]
        gone = removed[a:b]
        n_removed.append(int(gone.sum()))
        n_spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
        if not n_removed[-1]:
            own = data[words.starts[a] : words.ends[b - 1]] if b > a else b""
            digests.append(hashlib.sha256(b" ".join(own.translate(_TO_SPACE).split())).hexdigest())
            texts.append(value)
            continue
        keep = np.flatnonzero(~gone) + a
        kept = [data[x:y] for x, y in zip(words.starts[keep].tolist(), words.ends[keep].tolist())]
        digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        # What stands between two kept neighbours stays; a cut leaves one space.
        gaps = [b""]
        for p, q in zip(keep[:-1].tolist(), keep[1:].tolist()):
            gaps.append(data[words.ends[p] : words.starts[q]] if q == p + 1 else b" ")
        texts.append(b"".join(x for pair in zip(gaps, kept) for x in pair).decode())
    out = {n: batch.column(n) for n in batch.schema.names}
    return out | {
        "text": pa.array(texts, pa.string()),
        "n_words": pa.array(words.counts, pa.int64()),
        "n_removed": pa.array(n_removed, pa.int64()),
        "n_spans": pa.array(n_spans, pa.int64()),
        "kept_sha256": pa.array(digests, pa.string()),
    }


# bytes.split() takes the same six bytes for white space as the word pattern does, and no others.
_TO_SPACE = bytes(0x20 if b in (0x20, *range(0x09, 0x0E)) else b for b in range(256))


def drop_repeats(docs: DataFrame, columns: list[str], window: int = 35, group_limit: int = 2_048) -> DataFrame:
    """The documents without the words covered by a window of ``window`` words that also starts
    elsewhere, in the same document or another.

    Windows are judged on the input: every copy of a repeated passage goes, the first too. Output:
    ``columns`` (``text`` is added if missing), with ``text`` cut, and n_words, n_removed, n_spans,
    kept_sha256 (of the kept words joined by one space).

    Defined results: a null text has no words and stays null; an empty text stays empty; a document
    shorter than a window keeps all; rows that repeat, also with the same id, are documents each;
    other columns are ignored, whatever their names.
    """
    plan = Plan(WordSymbols, window, min(GRAM, window), group_limit)
    chosen = docs.select(*dict.fromkeys([*columns, "text"]))
    extra = [StructField(n, LongType()) for n in ("n_words", "n_removed", "n_spans")]
    own = [f for f in chosen.schema.fields if f.name not in ("n_words", "n_removed", "n_spans", "kept_sha256")]
    schema = StructType([*own, *extra, StructField("kept_sha256", StringType())])
    chosen = chosen.select(*[F.col(f"`{f.name}`") for f in own])
    return without_repeats(chosen, plan, lambda groups: solve(groups, window), _kept, schema)
