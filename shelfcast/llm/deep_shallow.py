"""Removal of repeated byte strings with deep-shallow suffix sorting.

Suffixes are grouped by a common anchor gram (see ``repeats``). In a group they are put in order as
in a suffix array: multikey quicksort down to a shallow depth, then a blind trie orders the
remaining suffixes with a long common prefix. Neighbours in that order give the longest common
prefixes. As a window need not begin at its anchor, the bytes left of the anchors, read backwards,
are put in order in the same way: a window that starts j bytes left of its anchor is found again
where j bytes to the left and ``window`` - j bytes to the right agree.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from shelfcast.llm.repeats import ByteSymbols, Group, Plan, without_repeats

GRAM = 64
# Bytes compared at once by multikey quicksort, and the depth at which blind tries take over.
CHUNK = 8
SHALLOW = 48


def common(a: bytes, b: bytes) -> int:
    """The length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class _Node:
    """An inner node of a blind trie: the depth at which its children differ, by their next byte."""

    __slots__ = ("children", "depth")

    def __init__(self, depth: int):
        self.depth = depth
        self.children: dict[int, _Node | list[int]] = {}


def _byte(s: bytes, depth: int) -> int:
    return s[depth] if depth < len(s) else -1


def blind_trie_order(texts: list[bytes], members: list[int]) -> list[int]:
    """The members in the order of their texts, by a trie that stores branching bytes only.

    An insertion walks down blindly, compares with one leaf, and branches where that differs.
    """
    root: _Node | list[int] = [members[0]]
    for m in members[1:]:
        s = texts[m]
        at = root
        while isinstance(at, _Node):
            at = at.children.get(_byte(s, at.depth)) or next(iter(at.children.values()))
        leaf = texts[at[0]]
        same = common(s, leaf)
        if same == len(s) == len(leaf):
            at.append(m)
            continue
        # Down again, to where the new branch begins.
        above, at = None, root
        while isinstance(at, _Node) and at.depth < same:
            above, at = at, at.children[_byte(s, at.depth)]
        if isinstance(at, _Node) and at.depth == same:
            at.children[_byte(s, same)] = [m]
            continue
        fork = _Node(same)
        fork.children = {_byte(leaf, same): at, _byte(s, same): [m]}
        if above is None:
            root = fork
        else:
            above.children[_byte(s, above.depth)] = fork
    out: list[int] = []
    stack = [root]
    while stack:
        at = stack.pop()
        if isinstance(at, _Node):
            stack.extend(at.children[b] for b in sorted(at.children, reverse=True))
        else:
            out.extend(at)
    return out


def suffix_order(texts: list[bytes], depth: int = 0) -> list[int]:
    """The numbers of the texts in the order of the texts, which agree in their first ``depth`` bytes."""
    out: list[int] = []
    stack = [(list(range(len(texts))), depth)]
    while stack:
        members, at = stack.pop()
        if len(members) < 2:
            out.extend(members)
        elif at - depth >= SHALLOW:
            out.extend(blind_trie_order(texts, members))
        else:
            keys = {m: texts[m][at : at + CHUNK] for m in members}
            pivot = keys[members[len(members) // 2]]
            less = [m for m in members if keys[m] < pivot]
            more = [m for m in members if keys[m] > pivot]
            equal = [m for m in members if keys[m] == pivot]
            stack.append((more, at))
            if len(pivot) < CHUNK:  # the texts end here, all alike
                stack.extend(([m], at) for m in reversed(equal))
            else:
                stack.append((equal, at + CHUNK))
            stack.append((less, at))
    return out


def prefix_intervals(lengths: list[int]) -> list[tuple[int, int, int]]:
    """The inner nodes of the suffix tree: (depth, first, past-the-last) ranges of the order.

    ``lengths[i]`` is the common prefix of the i-th and the next in order.
    """
    out, stack = [], [(-1, 0)]
    for i, depth in enumerate([*lengths, -1]):
        start = i
        while stack[-1][0] > depth:
            d, start = stack.pop()
            out.append((d, start, i + 1))
        if stack[-1][0] < depth:
            stack.append((depth, start))
    return out


def _group_repeats(group: Group, window: int, gram: int) -> list[tuple[int, int, int]]:
    """(segment, first window, past-the-last window) of what repeats within a group."""
    # A segment at several places takes part twice: its copy is its neighbour in both orders.
    own = [m for m, total in enumerate(group.totals) for _ in range(min(total, 2))]
    left = [group.contents[m][: group.anchors[m]][::-1] for m in own]
    right = [group.contents[m][group.anchors[m] :] for m in own]
    order = suffix_order(right, gram)
    lengths = [common(right[a], right[b]) for a, b in zip(order, order[1:])]
    rank = [0] * len(left)
    for r, m in enumerate(suffix_order(left)):
        rank[m] = r
    longest = max(len(s) for s in left)
    found = []
    for depth, a, b in prefix_intervals(lengths):
        need = max(window - depth, 0)  # bytes that must agree on the left
        if need > longest:
            continue
        members = sorted(order[a:b], key=rank.__getitem__)
        agree = [common(left[p], left[q]) for p, q in zip(members, members[1:])]
        for i, p in enumerate(members):
            best = max(agree[i - 1] if i else -1, agree[i] if i < len(agree) else -1)
            if best >= need:
                # Windows that start between need and best bytes before the anchor.
                m = own[p]
                anchor = group.anchors[m]
                found.append((m, anchor - best, min(anchor - need, group.windows[m] - 1) + 1))
    return found


def solve(groups: list[Group], window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    segment, low, high = [], [], []
    at = 0
    for g in groups:
        for m, a, b in _group_repeats(g, window, gram):
            if b > a:
                segment.append(at + m)
                low.append(a)
                high.append(b)
        at += len(g.contents)
    return np.array(segment, np.int64), np.array(low, np.int64), np.array(high, np.int64)


def _kept(batch: pa.RecordBatch, symbols: ByteSymbols, removed: np.ndarray) -> dict:
    n_removed, n_spans, digests, kept, texts = [], [], [], [], []
    first = symbols.first.tolist()
    for a, b in zip(first[:-1], first[1:]):
        gone = removed[a:b]
        n_removed.append(int(gone.sum()))
        n_spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
        rest = symbols.data[a:b][~gone].tobytes() if n_removed[-1] else symbols.bytes[a:b]
        kept.append(rest)
        digests.append(hashlib.sha256(rest).hexdigest())
        texts.append(whole_characters(symbols.data[a:b], gone) if n_removed[-1] else rest)
    return {n: batch.column(n) for n in batch.schema.names} | {
        "n_bytes": pa.array(np.diff(symbols.first), pa.int64()),
        "n_removed": pa.array(n_removed, pa.int64()),
        "n_spans": pa.array(n_spans, pa.int64()),
        "kept": pa.array(kept, pa.binary()),
        "kept_sha256": pa.array(digests, pa.string()),
        "text": pa.array([t.decode() for t in texts], pa.string()),
    }


def whole_characters(data: np.ndarray, gone: np.ndarray) -> bytes:
    """The characters of UTF-8 text that have lost no byte."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(starts):
        return b""
    hurt = np.maximum.reduceat(gone, starts)
    return data[~np.repeat(hurt, np.diff(np.append(starts, len(data))))].tobytes()


def drop_repeated_bytes(docs: DataFrame, columns: list[str], window: int = 400, group_limit: int = 2_048, with_kept: bool = True, with_text: bool = False) -> DataFrame:
    """One row per document with the bytes of its text that are not covered by a ``window``-byte
    string that also starts elsewhere, in the same document or another.

    Strings are judged on the input: every copy goes, the first too. Output: ``columns`` (without
    the text), n_bytes, n_removed, n_spans (maximal runs of removed bytes), kept_sha256 and, if
    asked for, kept (binary, as a cut can fall inside a character) and text (the characters that
    lost no byte).

    Defined results: a null text counts as an empty one; a text shorter than a window keeps all;
    rows that repeat, also with the same id, are documents each; other columns are ignored.
    """
    plan = Plan(ByteSymbols, window, min(GRAM, window), group_limit)
    chosen = docs.select(*dict.fromkeys([*columns, "text"]))
    fields = [f for f in chosen.schema.fields if f.name != "text"]
    fields += [StructField(n, LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
    fields += [StructField("kept", BinaryType())] * with_kept + [StructField("kept_sha256", StringType())]
    fields += [StructField("text", StringType())] * with_text
    return without_repeats(chosen, plan, lambda groups: solve(groups, window, plan.gram), _kept, StructType(fields))
