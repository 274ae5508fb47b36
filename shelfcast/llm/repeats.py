"""What the two repeated-passage operators share: finding windows that may repeat, and
bringing their text together in groups that fit in memory.

A text is a row of symbols (words, or bytes). A window is ``window`` consecutive symbols of one
text; the operators ask which windows start anywhere else too.

1. *Blocks.* Documents are packed into blocks of a few megabytes, written once to the shared
   folder. Later steps refer to places as (block, symbol).
2. *Anchors.* The anchor of a window is its gram of ``gram`` symbols with the smallest hash, the
   leftmost if several are equal. Equal windows have equal anchors at equal offsets, so a window
   whose anchor occurs once in the corpus is unique and leaves at once; that is most of them. A
   block asks once for each of its distinct anchors, however many copies it holds.
3. *Segments.* Consecutive windows with the same anchor travel as one segment of text, once for
   each block and distinct text, and are grouped by the anchor, if it occurs at most
   ``group_limit`` times: a group has no more rows, places or texts than that.
4. *Groups.* Sorted groups stream through a solver, which returns the windows that repeat.
5. *Hot windows.* Where the anchor occurs more often the prefix grows to the whole window: a block
   asks once for each of its distinct windows with such an anchor, known by two 64-bit hashes, and
   learns which of them occur twice or more. Neither text nor places leave the block, and a
   passage in a third of all documents is 20 bytes for each window and block.
6. *Spans* of repeated windows go back to their blocks.

Nothing is collected on the driver, and no pair of places is ever made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfcast.llm.words import BYTE_CODES, PIECE, SPACED, U64, covered, find_words, mix, powers, rolling, slices, texts_of
from shelfcast.session import scratch_path

BLOCK_BYTES = 4 << 20
# Blocks for each bucket of questions: a bucket holds about so many blocks' worth of anchors.
BUCKET_BLOCKS = 16
# Bytes of sorted segments handed to a solver at a time.
SOLVE_BYTES = 4 << 20

BASE_2 = 0xC2B2AE3D27D4EB4F
_UP_2, _DOWN_2 = powers(BASE_2, PIECE + 1), powers(pow(BASE_2, -1, 1 << 64), PIECE + 1)

SEGMENT_SCHEMA = "key long, same long, content binary, anchor int, windows int, n long, block long, places binary"


# ---- symbols ---------------------------------------------------------------------------


class WordSymbols:
    """Words ``[^\\x20\\x09-\\x0D]+`` as symbols."""

    def __init__(self, texts: list[bytes | None]):
        self.words = find_words(texts, SPACED)
        self.first = self.words.first

    def __len__(self) -> int:
        return len(self.words.hashes)

    def codes(self, a: int, b: int) -> np.ndarray:
        return self.words.hashes[a:b]

    def cut(self, a: int, b: int) -> bytes:
        return self.words.data[self.words.starts[a] : self.words.ends[b - 1]].tobytes()


class ByteSymbols:
    """UTF-8 bytes as symbols."""

    def __init__(self, texts: list[bytes | None]):
        self.bytes = b"".join([t or b"" for t in texts])
        self.data = np.frombuffer(self.bytes, np.uint8)
        self.first = np.cumsum([0, *(len(t or b"") for t in texts)])

    def __len__(self) -> int:
        return len(self.data)

    def codes(self, a: int, b: int) -> np.ndarray:
        return BYTE_CODES[self.data[a:b]]

    def cut(self, a: int, b: int) -> bytes:
        return self.bytes[a:b]


@dataclass(frozen=True)
class Plan:
    """What is searched for, and how."""

    symbols: Callable
    window: int
    gram: int
    group_limit: int = 2_048


# ---- blocks ----------------------------------------------------------------------------


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    block = TaskContext.get().partitionId() << 32
    for part in slices(batches, limit=BLOCK_BYTES):
        sink = pa.BufferOutputStream()
        # Rows are copied: a slice would take its whole batch along.
        rows = part.take(pa.array(range(part.num_rows)))
        with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
            out.write_batch(rows)
        yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "payload": [sink.getvalue().to_pybytes()]})
        block += 1


def pack_blocks(docs: DataFrame) -> DataFrame:
    """The documents, a few megabytes in each row, written to the shared folder."""
    path = scratch_path(docs.sparkSession, "blocks")
    docs.mapInArrow(_pack, "block long, payload binary").write.option("compression", "none").parquet(path)
    return docs.sparkSession.read.schema("block long, payload binary").parquet(path)


def unpack(payload: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(pa.py_buffer(payload)) as stream:
        return stream.read_next_batch()


# ---- anchors ---------------------------------------------------------------------------


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values."""
    span = 1
    while 2 * span <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: -(w - span)], x[w - span :]) if w > span else x


@dataclass
class Stretch:
    """Segments of a stretch of symbols: first window, number of windows, place and hash of the anchor."""

    at: int
    codes: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray
    key: np.ndarray


def pieces(symbols, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A bounded number of symbols at a time: (place of the first, codes, starts of the windows in them).

    Windows lie within a text; the starts count from the first symbol of the piece.
    """
    last = len(symbols) - window + 1
    size = PIECE - window
    if size <= 0:
        raise ValueError("the window must fit in a piece")
    bounds = np.unique(symbols.first[1:-1])
    for at in range(0, max(last, 0), size):
        n = min(size, last - at)
        near = bounds[(bounds > at) & (bounds - window + 1 < at + n)] - at
        broken = covered(n, np.clip(near - window + 1, 0, n), np.clip(near, 0, n))
        yield at, symbols.codes(at, at + n + window - 1), np.flatnonzero(~broken)


def stretches(symbols, window: int, gram: int) -> Iterator[Stretch]:
    """The segments of all texts, a bounded number of symbols at a time."""
    if gram > window:
        raise ValueError("the gram must fit in the window")
    place = U64((1 << 20) - 1)
    for at, codes, whole in pieces(symbols, window):
        hashes = rolling(codes, gram)
        low = sliding_min((hashes & ~place) | np.arange(len(hashes), dtype=U64), window - gram + 1) & place
        low = low[whole].astype(np.int64)
        if not len(whole):
            continue
        new = np.flatnonzero(np.concatenate([[True], (np.diff(whole) != 1) | (low[1:] != low[:-1])]))
        anchor = low[new]
        yield Stretch(at, codes, whole[new], np.diff(np.append(new, len(whole))), anchor, hashes[anchor])


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination of values begins in sorted columns."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _ask(block: int, keys: np.ndarray, buckets: int) -> pa.RecordBatch:
    """The distinct rows of ``keys`` and how often each is there, by bucket."""
    bucket = (keys[:, 0] % U64(buckets)).astype(np.int64)
    order = np.lexsort((*keys.T[::-1], bucket))
    keys, bucket = keys[order], bucket[order]
    first = runs(*keys.T)
    n = np.diff(np.append(first, len(keys))).astype(np.int32)
    keys, bucket = keys[first], bucket[first]
    filled = runs(bucket)
    ends = np.append(filled[1:], len(bucket))
    return pa.RecordBatch.from_pydict(
        {
            "bucket": pa.array(bucket[filled], pa.int64()),
            "block": pa.array([block] * len(filled), pa.int64()),
            "keys": pa.array([keys[a:b].tobytes() for a, b in zip(filled, ends)], pa.binary()),
            "counts": pa.array([n[a:b].tobytes() for a, b in zip(filled, ends)], pa.binary()),
        }
    )


QUESTIONS = "bucket long, block long, keys binary, counts binary"
ANSWERS = "block long, keys binary, often binary, hot boolean"


def _questions(batches: Iterator[pa.RecordBatch], plan: Plan, buckets: int) -> Iterator[pa.RecordBatch]:
    """Each block's distinct anchors and how often it has them, by bucket."""
    for batch in batches:
        for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload").to_pylist()):
            symbols = plan.symbols(texts_of(unpack(payload)))
            keys, places = [], []
            for s in stretches(symbols, plan.window, plan.gram):
                keys.append(s.key)
                places.append(s.at + s.anchor)
            if not keys:
                continue
            # A segment cut in two by the end of a stretch has one anchor.
            _, once = np.unique(np.concatenate(places), return_index=True)
            yield _ask(block, np.concatenate(keys)[once][:, None], buckets)


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination of values begins in sorted columns."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _answers(asked: pa.Table, width: int, limit: int) -> pa.Table:
    """Which keys of a bucket occur twice or more, for each block that asked; a key is ``width`` hashes."""
    keys = [np.frombuffer(b, np.uint64).reshape(-1, width) for b in asked.column("keys").to_pylist()]
    counts = np.concatenate([np.frombuffer(b, np.int32) for b in asked.column("counts").to_pylist()])
    row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    key = np.concatenate(keys)
    order = np.lexsort(key.T[::-1])
    first = runs(*key[order].T)
    totals = np.add.reduceat(counts[order].astype(np.int64), first)
    total = np.empty(len(key), np.int64)
    total[order] = np.repeat(totals, np.diff(np.append(first, len(key))))
    kept = np.flatnonzero(total > 1)
    low = np.searchsorted(row[kept], np.arange(len(keys) + 1))
    filled = np.flatnonzero(np.diff(low))
    often = [total[kept[low[r] : low[r + 1]]] > limit for r in filled]
    return pa.table(
        {
            "block": asked.column("block").take(pa.array(filled)),
            "keys": pa.array([key[kept[low[r] : low[r + 1]]].tobytes() for r in filled], pa.binary()),
            "often": pa.array([o.tobytes() for o in often], pa.binary()),
            "hot": pa.array([bool(o.any()) for o in often], pa.bool_()),
        }
    )


def _repeated_anchors(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The anchors of a block that repeat, sorted, and which of them do so too often for a group."""
    keys = np.concatenate([np.frombuffer(b, np.uint64) for b in answers.column("keys").to_pylist()])
    often = np.concatenate([np.frombuffer(b, bool) for b in answers.column("often").to_pylist()])
    order = np.argsort(keys)
    return keys[order], often[order]


# ---- segments --------------------------------------------------------------------------


def _span_hash(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(codes) + 1, U64)
    np.cumsum(codes * _UP_2[: len(codes)], out=sums[1:])
    return mix((sums[end] - sums[start]) * _DOWN_2[start] + (end - start).astype(U64))


def _segments(blocks: pa.Table, answers: pa.Table, plan: Plan) -> pa.Table:
    """The segments of a block whose anchors repeat: one row for each distinct text."""
    found = []
    if answers.num_rows and blocks.num_rows:
        keys, often = _repeated_anchors(answers)
        symbols = plan.symbols(texts_of(unpack(blocks.column("payload")[0].as_py())))
        for s in stretches(symbols, plan.window, plan.gram):
            at = np.minimum(np.searchsorted(keys, s.key), len(keys) - 1)
            own = np.flatnonzero((keys[at] == s.key) & ~often[at])
            same = _span_hash(s.codes, s.start[own], s.start[own] + s.windows[own] + plan.window - 1)
            found.append((s.key[own], same, s.at + s.start[own], s.windows[own], s.anchor[own] - s.start[own]))
    schema = pa.schema(
        {"key": pa.int64(), "same": pa.int64(), "content": pa.binary(), "anchor": pa.int32(), "windows": pa.int32(), "n": pa.int64(), "block": pa.int64(), "places": pa.binary()}
    )
    if not found:
        return schema.empty_table()
    key, same, start, windows, anchor = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((start, same, key))
    key, same, start = key[order], same[order], start[order]
    first = runs(key, same)
    last = np.append(first[1:], len(key))
    windows, anchor = windows[order][first], anchor[order][first]
    content = [symbols.cut(a, a + w + plan.window - 1) for a, w in zip(start[first].tolist(), windows.tolist())]
    places = start.astype(np.int64)
    return pa.table(
        {
            "key": key[first].view(np.int64),
            "same": same[first].view(np.int64),
            "content": pa.array(content, pa.binary()),
            "anchor": pa.array(anchor, pa.int32()),
            "windows": pa.array(windows, pa.int32()),
            "n": pa.array(last - first, pa.int64()),
            "block": pa.array([blocks.column("block")[0].as_py()] * len(first), pa.int64()),
            "places": pa.array([places[a:b].tobytes() for a, b in zip(first, last)], pa.binary()),
        },
        schema=schema,
    )


# ---- hot windows -----------------------------------------------------------------------


def _window_hashes(codes: np.ndarray, start: np.ndarray, window: int) -> np.ndarray:
    """Two hashes of each window."""
    return np.stack([rolling(codes, window)[start], _span_hash(codes, start, start + window)], axis=1)


def _hot_questions(blocks: pa.Table, answers: pa.Table, plan: Plan, buckets: int) -> pa.Table:
    """A block's distinct windows whose anchors occur too often for a group, by bucket."""
    found = [np.empty((0, 2), U64)]
    if answers.num_rows and blocks.num_rows:
        keys, often = _repeated_anchors(answers)
        keys = keys[often]
        symbols = plan.symbols(texts_of(unpack(blocks.column("payload")[0].as_py())))
        for s in stretches(symbols, plan.window, plan.gram):
            hot = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, s.key), len(keys) - 1)] == s.key)
            n = s.windows[hot]
            start = np.repeat(s.start[hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            if len(start):
                found.append(_window_hashes(s.codes, start, plan.window))
    return pa.Table.from_batches([_ask(blocks.column("block")[0].as_py() if blocks.num_rows else 0, np.concatenate(found), buckets)])


def _among(hashes: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Which rows of ``hashes`` are rows of ``pairs``, which are sorted."""
    at, out = np.searchsorted(pairs[:, 0], hashes[:, 0]), np.zeros(len(hashes), bool)
    left = np.arange(len(hashes))
    while len(left):
        left = left[at[left] < len(pairs)]
        left = left[pairs[at[left], 0] == hashes[left, 0]]
        out[left] |= pairs[at[left], 1] == hashes[left, 1]
        at[left] += 1
    return out


def _hot_windows(symbols, pairs: np.ndarray, window: int) -> np.ndarray:
    """Where the windows with one of these pairs of hashes start."""
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    found = [np.empty(0, np.int64)]
    for at, codes, whole in pieces(symbols, window):
        if len(whole):
            found.append(at + whole[_among(_window_hashes(codes, whole, window), pairs)])
    return np.concatenate(found)


# ---- groups ----------------------------------------------------------------------------


@dataclass
class Group:
    """Distinct segments with the same anchor, and at how many places each is."""

    contents: list[bytes]
    anchors: list[int]
    windows: list[int]
    totals: list[int]


# Returns (segment, first window, past-the-last window) of windows equal to one of another
# segment of the same group, or of the same segment at another place, as three arrays; segments
# are numbered through all the groups. A segment at several places is given once, with that total.
Solver = Callable[[list[Group]], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows in runs that do not cut a key in two."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < SOLVE_BYTES:
            continue
        rows = pa.Table.from_batches(held)
        key = rows.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))  # sorted: the last key may go on
        if cut:
            yield rows.slice(0, cut)
            rows = rows.slice(cut).combine_chunks()
        held, size = rows.to_batches(), rows.nbytes
    if held:
        yield pa.Table.from_batches(held)


def _repeated(batches: Iterator[pa.RecordBatch], plan: Plan, solver: Solver) -> Iterator[pa.RecordBatch]:
    for rows in _whole_groups(batches):
        key, same = rows.column("key").to_numpy(), rows.column("same").to_numpy()
        first = runs(key, same)
        segment_of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
        total = np.add.reduceat(rows.column("n").to_numpy(), first).tolist()
        windows = rows.column("windows").to_numpy()[first].tolist()
        texts = rows.column("content").take(pa.array(first)).to_pylist()
        anchors = rows.column("anchor").to_numpy()[first].tolist()
        edges = [*runs(key[first]).tolist(), len(first)]
        groups = [Group(texts[a:b], anchors[a:b], windows[a:b], total[a:b]) for a, b in zip(edges, edges[1:])]
        segment, low, high = solver(groups)
        if len(segment):
            yield from _spans(rows, segment_of, segment, low, high, plan.window)


def _spans(rows: pa.Table, segment_of, segment, low, high, window) -> Iterator[pa.RecordBatch]:
    """The places of repeated windows, by block."""
    order = np.argsort(segment, kind="stable")
    segment, low, high = segment[order], low[order], high[order]
    a, b = np.searchsorted(segment, segment_of), np.searchsorted(segment, segment_of, "right")
    hit = np.flatnonzero(b > a)
    places = rows.column("places").take(pa.array(hit)).to_pylist()
    blocks = rows.column("block").to_numpy()[hit]
    start, end, owner = [], [], []
    for i, (p, block) in enumerate(zip(places, blocks.tolist())):
        where = np.frombuffer(p, np.int64)[:, None]
        s, e = a[hit[i]], b[hit[i]]
        start.append((where + low[s:e]).ravel())
        end.append((where + high[s:e] + (window - 1)).ravel())
        owner.append(np.full(len(start[-1]), block))
    start, end, owner = (np.concatenate(x) for x in (start, end, owner))
    order = np.argsort(owner, kind="stable")
    start, end, owner = start[order], end[order], owner[order]
    first = runs(owner)
    last = np.append(first[1:], len(owner))
    yield pa.RecordBatch.from_pydict(
        {
            "block": pa.array(owner[first], pa.int64()),
            "starts": pa.array([start[x:y].tobytes() for x, y in zip(first, last)], pa.binary()),
            "ends": pa.array([end[x:y].tobytes() for x, y in zip(first, last)], pa.binary()),
        }
    )


# ---- the whole -------------------------------------------------------------------------

# Gets the rows of a block, its symbols and which of them are covered by repeated windows.
Finish = Callable[[pa.RecordBatch, object, np.ndarray], dict]


def _finish(blocks: pa.Table, marks: pa.Table, plan: Plan, finish: Finish, names: list[str]) -> pa.Table:
    batch = unpack(blocks.column("payload")[0].as_py())
    symbols = plan.symbols(texts_of(batch))

    def joined(name: str, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join([b for b in marks.column(name).to_pylist() if b]), kind)

    starts, ends, pairs = joined("starts", np.int64), joined("ends", np.int64), joined("pairs", np.uint64)
    if len(pairs):
        hot = _hot_windows(symbols, pairs.reshape(-1, 2), plan.window)
        starts, ends = np.concatenate([starts, hot]), np.concatenate([ends, hot + plan.window])
    out = finish(batch, symbols, covered(len(symbols), starts, ends))
    return pa.table({n: out[n] for n in names})


def without_repeats(docs: DataFrame, plan: Plan, solver: Solver, finish: Finish, schema: StructType) -> DataFrame:
    """One row per document: what ``finish`` makes of it and of its repeated symbols.

    ``docs`` has a column ``text`` and whatever else ``finish`` needs.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = pack_blocks(docs)
    buckets = max(parts, -(-blocks.count() // BUCKET_BLOCKS))
    asked = blocks.mapInArrow(lambda it: _questions(it, plan, buckets), QUESTIONS)
    answers = asked.groupBy("bucket").applyInArrow(lambda t: _answers(t, 1, plan.group_limit), ANSWERS)
    segments = (
        blocks.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(lambda b, a: _segments(b, a, plan), SEGMENT_SCHEMA)
    )
    spans = (
        segments.repartition(parts, "key")
        .sortWithinPartitions("key", "same")
        .mapInArrow(lambda it: _repeated(it, plan, solver), "block long, starts binary, ends binary")
    )
    hot = (
        blocks.groupBy("block")
        .cogroup(answers.where("hot").groupBy("block"))
        .applyInArrow(lambda b, a: _hot_questions(b, a, plan, buckets), QUESTIONS)
        .groupBy("bucket")
        .applyInArrow(lambda t: _answers(t, 2, plan.group_limit), ANSWERS)
    )
    none = F.lit(None).cast("binary")
    marks = spans.withColumn("pairs", none).unionByName(
        hot.select("block", none.alias("starts"), none.alias("ends"), F.col("keys").alias("pairs"))
    )
    names = schema.fieldNames()
    return (
        blocks.groupBy("block")
        .cogroup(marks.groupBy("block"))
        .applyInArrow(lambda b, s: _finish(b, s, plan, finish, names), schema)
    )
