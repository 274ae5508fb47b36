"""Benchmark decontamination with a positional inverted index.

The corpus is indexed in shards of whole documents. A shard row holds the sorted terms of its
documents and, for each term, the places where it stands. A test phrase is looked up in every
shard: the place lists of its terms, each shifted by the term's offset in the phrase, are
intersected from the rarest term on; what is left are the exact occurrences. Proximity search
uses the same lists. As a shard holds every posting of its documents, nothing is shuffled by
term, and a very frequent term is spread over all shards.

Terms are kept as 64-bit hashes. Test items are read in blocks of bounded size, one pass over
the index for each block; a long item is cut into runs that overlap, so that it can be in many.

Defined results: a null or empty text, and one without words, has no words and no hits; items
without words have no phrase; items without an id are left out; rows with the same item id count
as one item; repeated documents are judged each for itself; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.words import FOLDED, find_words, slices, texts_of
from shelfcast.session import scratch_path

SHARD_BYTES = 4 << 20
# Words of test items held at a time.
BLOCK_WORDS = 1 << 20

INDEX_SCHEMA = "shard long, doc_ids array<long>, firsts binary, terms binary, offsets binary, postings binary"
HIT_SCHEMA = "shard long, doc int, doc_id long, n_words long, items array<string>, starts binary, ends binary"


def packed(a: np.ndarray, kind) -> bytes:
    return a.astype(kind).tobytes()


# ---- the index -------------------------------------------------------------------------


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard = TaskContext.get().partitionId() << 32
    for part in slices(batches, limit=SHARD_BYTES):
        words = find_words(texts_of(part), FOLDED)
        order = np.argsort(words.hashes, kind="stable")
        ordered = words.hashes[order]
        offsets = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, int)
        # Places rise within a term: gaps are small numbers and compress well.
        gaps = np.diff(order, prepend=0)
        gaps[offsets] = order[offsets]
        yield pa.RecordBatch.from_pydict(
            {
                "shard": pa.array([shard], pa.int64()),
                "doc_ids": pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                "firsts": [packed(words.first, np.int64)],
                "terms": [packed(ordered[offsets], np.uint64)],
                "offsets": [packed(np.append(offsets, len(ordered)), np.int64)],
                "postings": [packed(gaps, np.int32)],
            }
        )
        shard += 1


def build_index(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Index every word of every document; the index is a Parquet table at ``path``."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows.mapInArrow(_index_rows, INDEX_SCHEMA).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(INDEX_SCHEMA).parquet(path)


class Shard:
    """One row of the index, ready for look-ups."""

    def __init__(self, row: dict):
        self.id = row["shard"]
        self.doc_ids = row["doc_ids"]
        self.first = np.frombuffer(row["firsts"], np.int64)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.offsets = np.frombuffer(row["offsets"], np.int64)
        self.gaps = np.frombuffer(row["postings"], np.int32)
        self._lists: dict[int, np.ndarray] = {}

    def find(self, terms: np.ndarray) -> np.ndarray:
        """The number of each term in this shard, -1 for one that is not here."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def lengths(self, numbers: np.ndarray) -> np.ndarray:
        return np.where(numbers < 0, 0, self.offsets[numbers + 1] - self.offsets[numbers])

    def places(self, number: int) -> np.ndarray:
        """The places of a term, rising."""
        if number not in self._lists:
            gaps = self.gaps[self.offsets[number] : self.offsets[number + 1]]
            self._lists[number] = np.cumsum(gaps, dtype=np.int64)
        return self._lists[number]

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, "right") - 1

    def phrase(self, numbers: np.ndarray) -> np.ndarray:
        """Places where the terms stand one after the other in one document."""
        order = np.argsort(self.lengths(numbers), kind="stable")
        starts = self.places(numbers[order[0]]) - order[0]
        for k in order[1:]:
            if not len(starts):
                return starts
            own = self.places(numbers[k])
            at = np.minimum(np.searchsorted(own, starts + k), len(own) - 1)
            starts = starts[own[at] == starts + k]
        starts = starts[starts >= 0]
        return starts[self.doc_of(starts) == self.doc_of(starts + len(numbers) - 1)]

    def near(self, numbers: np.ndarray, span: int) -> np.ndarray:
        """Places that begin a stretch of ``span`` words, in one document, with all the terms in any order.

        A stretch begins with one of the terms.
        """
        numbers = np.unique(numbers)
        lists = [self.places(n) for n in numbers[np.argsort(self.lengths(numbers), kind="stable")]]
        starts = np.unique(np.concatenate(lists))
        for own in lists:
            at = np.searchsorted(own, starts)
            reach = np.where(at < len(own), own[np.minimum(at, len(own) - 1)], np.iinfo(np.int64).max)
            starts = starts[reach < starts + span]
            if not len(starts):
                return starts
        last = starts.copy()
        for own in lists:
            last = np.maximum(last, own[np.searchsorted(own, starts)])
        return starts[self.doc_of(starts) == self.doc_of(last)]


# ---- test items ------------------------------------------------------------------------


@dataclass
class Phrases:
    """A block of test items: runs of words, in which every window of ``size`` words is a phrase."""

    items: list[str]  # the item of each run
    first: np.ndarray  # the words of run r are those from first[r] up to first[r + 1]
    terms: np.ndarray  # the distinct words
    words: np.ndarray  # for each word of the runs, which of the terms it is
    size: int

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, number of words and run of every window; a run of fewer words is one window."""
        counts = np.diff(self.first)
        run = np.repeat(np.arange(len(counts)), counts)
        length = np.minimum(counts, self.size)[run]
        at = np.flatnonzero(np.arange(len(run)) + length <= self.first[1:][run])
        return at, length[at], run[at]


def phrases_of(runs: list[tuple[str, bytes]], size: int) -> Phrases:
    first = np.cumsum([0, *(len(w) // 8 for _, w in runs)])
    terms, words = np.unique(np.frombuffer(b"".join(w for _, w in runs), np.uint64), return_inverse=True)
    return Phrases([i for i, _ in runs], first, terms, words.astype(np.int32), size)


def _run_rows(batches: Iterator[pa.RecordBatch], size: int, longest: int) -> Iterator[pa.RecordBatch]:
    def rows(found: list[tuple[str, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"item": pa.array([i for i, _ in found], pa.string()), "words": pa.array([w for _, w in found], pa.binary())})

    for part in slices(batches):
        words, found, held = find_words(texts_of(part), FOLDED), [], 0
        bounds = words.first.tolist()
        for item, begin, end in zip(part.column("item").to_pylist(), bounds[:-1], bounds[1:]):
            # Neighbours share size - 1 words: each window is whole in one run.
            for at in range(begin, max(end - size, begin) + 1 if end > begin else begin, longest - size + 1):
                own = words.hashes[at : min(at + longest, end)]
                found.append((item, packed(own, np.uint64)))
                held += len(own)
                if held >= longest:
                    yield rows(found)
                    found, held = [], 0
        yield rows(found)


def item_blocks(benchmark: DataFrame, size: int, item_id: str = "item_id", text: str = "text") -> Iterator[Phrases]:
    """The test items in blocks of at most BLOCK_WORDS words (two windows, if that is more).

    Tasks find the words and cut items into runs that fit; 8 bytes a word come here, one block at a time.
    """
    longest = max(BLOCK_WORDS, 2 * size)
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("binary").alias("text")).dropna()
    runs, held = [], 0
    for row in items.mapInArrow(lambda it: _run_rows(it, size, longest), "item string, words binary").toLocalIterator():
        n = len(row["words"]) // 8
        if held + n > longest:
            yield phrases_of(runs, size)
            runs, held = [], 0
        runs.append((row["item"], bytes(row["words"])))
        held += n
    if runs:
        yield phrases_of(runs, size)


# ---- search ----------------------------------------------------------------------------


def _search(batches: Iterator[pa.RecordBatch], phrases: Phrases, slop: int | None, all_docs: bool) -> Iterator[pa.RecordBatch]:
    at, length, run = phrases.windows()
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            shard = Shard(row)
            doc, item, start, end = [], [], [], []
            numbers = shard.find(phrases.terms)[phrases.words]
            absent = np.concatenate([[0], np.cumsum(numbers < 0)])
            for w in np.flatnonzero(absent[at + length] == absent[at]).tolist():
                n = int(length[w])
                own = numbers[at[w] : at[w] + n]
                places = shard.phrase(own) if slop is None else shard.near(own, n + slop)
                if len(places):
                    docs = shard.doc_of(places)
                    reach = n if slop is None else n + slop
                    doc.append(docs)
                    item.append(np.full(len(places), run[w]))
                    start.append(places - shard.first[docs])
                    end.append(np.minimum(places + reach, shard.first[docs + 1]) - shard.first[docs])
            yield _hit_rows(shard, phrases.items, doc, item, start, end, all_docs)


def _hit_rows(shard, names, doc, item, start, end, all_docs) -> pa.RecordBatch:
    doc, item, start, end = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (doc, item, start, end))
    order = np.argsort(doc, kind="stable")
    doc, item, start, end = doc[order], item[order], start[order], end[order]
    wanted = np.arange(len(shard.doc_ids)) if all_docs else np.unique(doc)
    low, high = np.searchsorted(doc, wanted), np.searchsorted(doc, wanted, "right")
    counts = np.diff(shard.first)
    return pa.RecordBatch.from_pydict(
        {
            "shard": pa.array([shard.id] * len(wanted), pa.int64()),
            "doc": pa.array(wanted, pa.int32()),
            "doc_id": pa.array([shard.doc_ids[d] for d in wanted], pa.int64()),
            "n_words": pa.array(counts[wanted], pa.int64()),
            "items": pa.array([sorted({names[k] for k in item[a:b]}) for a, b in zip(low, high)], pa.list_(pa.string())),
            "starts": pa.array([packed(start[a:b], np.int64) for a, b in zip(low, high)], pa.binary()),
            "ends": pa.array([packed(end[a:b], np.int64) for a, b in zip(low, high)], pa.binary()),
        }
    )


def search(index: DataFrame, benchmark: DataFrame, size: int = 13, slop: int | None = None, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """For each indexed document, the test items found in it and the word spans they hit.

    ``slop`` None finds windows of ``size`` words as exact phrases; a number finds places where
    all the words of a window stand, in any order, within that many words more than the window
    has. Columns: shard, doc (its number in the shard), doc_id, n_words, items (distinct, sorted)
    and spans (first and past-the-last word of each hit; they can overlap).
    """
    spark = index.sparkSession
    passes = []
    for block in item_blocks(benchmark, size, item_id, text):
        # Windows are made in the tasks: 12 bytes a word, at most, go to the executors.
        sent = spark.sparkContext.broadcast(block)
        passes.append(index.mapInArrow(lambda it, sent=sent, first=not passes: _search(it, sent.value, slop, first), HIT_SCHEMA))
    if not passes:
        none = phrases_of([], size)
        passes.append(index.mapInArrow(lambda it: _search(it, none, slop, True), HIT_SCHEMA))
    hits = passes[0]
    for more in passes[1:]:
        hits = hits.unionByName(more)
    return (
        hits.groupBy("shard", "doc")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").alias("n_words"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.collect_list(F.struct("starts", "ends")).alias("spans"),
        )
    )


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {"doc_id": batch.column("doc_id"), "n_words": batch.column("n_words"), "items": batch.column("items")}
        spans = batch.column("spans").to_pylist()
        n_hit, digests = [], []
        for parts, n in zip(spans, out["n_words"].to_pylist()):
            ends = np.frombuffer(b"".join(p["ends"] for p in parts), np.int64)
            starts = np.frombuffer(b"".join(p["starts"] for p in parts), np.int64)
            n_hit.append(int(merged_length(starts, ends)))
        for items in out["items"].to_pylist():
            digests.append(hashlib.sha256(",".join(items).encode()).hexdigest())
        out["n_hit"] = pa.array(n_hit, pa.int64())
        out["items_sha256"] = pa.array(digests, pa.string())
        yield pa.RecordBatch.from_pydict(out)


def merged_length(starts: np.ndarray, ends: np.ndarray) -> int:
    """How many places the spans cover together."""
    if not len(starts):
        return 0
    order = np.argsort(starts, kind="stable")
    reach = np.maximum.accumulate(ends[order])
    begin = np.maximum(starts[order], np.concatenate([[0], reach[:-1]]))
    return int(np.maximum(reach - begin, 0).sum())


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, slop: int | None = None, threshold: float = 0.05) -> DataFrame:
    """One row per document: doc_id, n_words, items, n_hit, items_sha256, contaminated.

    A document is contaminated if it has hit words and they are at least ``threshold`` of its words.
    """
    index = build_index(docs, scratch_path(docs.sparkSession, "postings"))
    found = search(index, benchmark, size, slop)
    schema = "doc_id long, n_words long, items array<string>, n_hit long, items_sha256 string"
    per_mille = round(1000 * threshold)
    rule = (F.col("n_hit") > 0) & (1000 * F.col("n_hit") >= per_mille * F.col("n_words"))
    return found.mapInArrow(_reports, schema).withColumn("contaminated", rule)
