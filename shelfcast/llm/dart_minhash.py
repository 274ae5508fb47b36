"""Near-duplicate documents by weighted MinHash with darts.

A document is a weighted set: its shingles of five words, each with the number of times it occurs.
Every shingle has a plane of weight and rank into which a hash throws darts, on average one on each
unit of area, the same for all documents. A dart hits a document if its weight lies below the
shingle's weight there. A dart also names a coordinate of the signature, and of the darts that hit,
each coordinate keeps the one of lowest rank. Two documents keep the same dart with a probability
equal to their weighted Jaccard similarity. A document needs only the darts of rank below
(k ln k + 3k) / size, about a thousand whatever its size; where a coordinate is still empty the
limit is doubled. The plane is cut into regions that double in width and height, so a shingle asks
the hash for a few regions only, and most of them are empty.

Signatures are cut into bands. Documents that share a band are compared exactly: first each with
the centre of the band, the document that meets most others, so that a group of near copies costs a
comparison each and not one for each pair. A document that is not near a centre may still be near
others that have the same centre: such open documents are compared with those in blocks, through an
inverted index of their shingles, and only links that connect something new are put out.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.components import connected_components
from shelfcast.llm.repeats import runs
from shelfcast.llm.words import SPACED, U64, find_words, mix, rolling, slices, texts_of
from shelfcast.session import discard, scratch_path, settle

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
# Darts a document of size 1 needs, about; and the height of the lowest region.
DARTS = COORDINATES * (math.log(COORDINATES) + 3)
LOWEST = DARTS / 2**14

SIGNATURE_SCHEMA = "row long, doc_id long, r1 long, r2 long, k1 long, k2 long, bands array<long>"


# ---- weighted sets ---------------------------------------------------------------------


def weighted_sets(texts: list[bytes | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight) of all texts, sorted by text and shingle.

    A text of fewer words than a shingle has one shingle, all its words; one without words has none.
    """
    words = find_words(texts, SPACED)
    counts = words.counts
    text = words.text_of()
    place = np.arange(len(text)) - words.first[text]
    starts = np.flatnonzero(place <= counts[text] - size)
    parts = [(text[starts], rolling(words.hashes, size)[starts] if len(starts) else np.empty(0, U64))]
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        if len(short):
            parts.append((short, rolling(words.hashes, n)[words.first[short]] ^ U64(n)))
    text, shingle = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((shingle, text))
    text, shingle = text[order], shingle[order]
    first = runs(text, shingle)
    return text[first], shingle[first], np.diff(np.append(first, len(text)))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets given as sorted shingles and their weights."""
    total = int(a[1].sum() + b[1].sum())
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    met = b[0][at] == a[0]
    shared = int(np.minimum(a[1][met], b[1][at[met]]).sum())
    return shared / (total - shared)


# ---- darts -----------------------------------------------------------------------------


@functools.cache
def _poisson_steps(area: float) -> np.ndarray:
    """The distribution function of the number of darts on an area."""
    most = int(area + 12 * math.sqrt(area) + 20)
    logs = [k * math.log(area) - area - math.lgamma(k + 1) for k in range(most)]
    return np.cumsum(np.exp(logs))


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> U64(11)).astype(np.float64) * 2.0**-53


def _bounds(level: int, lowest: float) -> tuple[float, float]:
    """Where a region begins, and its extent: [0, lowest), then doubling."""
    return (0.0, lowest) if level == 0 else (lowest * 2.0 ** (level - 1), lowest * 2.0 ** (level - 1))


def throw(shingle: np.ndarray, weight: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, ...]:
    """The darts that hit: number of the set element, coordinate, rank and identity of each.

    ``limit`` is the rank below which darts are wanted, for each element.
    """
    found = []
    heights = np.maximum(np.ceil(np.log2(limit / LOWEST)), 0).astype(np.int64)
    widths = np.ceil(np.log2(weight)).astype(np.int64)
    for width in range(int(widths.max(initial=-1)) + 1):
        for height in range(int(heights.max(initial=-1)) + 1):
            own = np.flatnonzero((widths >= width) & (heights >= height))
            if not len(own):
                continue
            (left, w), (low, h) = _bounds(width, 1.0), _bounds(height, LOWEST)
            steps = _poisson_steps(w * h)
            seed = mix(shingle[own] + U64((width * 64 + height + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            chance = _unit(mix(seed ^ U64(0x5851F42D4C957F2D)))
            some = np.flatnonzero(chance >= steps[0])
            n = np.searchsorted(steps, chance[some], "right")
            element = np.repeat(own[some], n)
            turn = np.arange(len(element)) - np.repeat(np.cumsum(n) - n, n)
            dart = mix(np.repeat(seed[some], n) + (turn + 1).astype(U64) * U64(0xD1342543DE82EF95))
            at = left + w * _unit(dart)
            rank = low + h * _unit(mix(dart ^ U64(0xA0761D6478BD642F)))
            hit = np.flatnonzero((at < weight[element]) & (rank < limit[element]))
            coordinate = (mix(dart ^ U64(0xE7037ED1A0B428DB)) % U64(COORDINATES)).astype(np.int64)
            found.append((element[hit], coordinate[hit], rank[hit], dart[hit]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 4


def signatures(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the texts that have words, and a row of dart identities for each."""
    text, shingle, weight = weighted_sets(texts)
    sizes = np.bincount(text, weights=weight, minlength=len(texts))
    having = np.flatnonzero(sizes > 0)
    out = np.zeros((len(texts), COORDINATES), U64)
    scale, todo = 1.0, having
    while len(todo):
        wanted = np.zeros(len(texts), bool)
        wanted[todo] = True
        own = np.flatnonzero(wanted[text])
        element, coordinate, rank, dart = throw(shingle[own], weight[own], scale * DARTS / sizes[text[own]])
        cell = text[own[element]] * COORDINATES + coordinate
        # Assigned in falling order of rank: the lowest stays.
        order = np.argsort(-rank, kind="stable")
        out.reshape(-1)[cell[order]] = dart[order]
        filled = np.zeros(len(texts) * COORDINATES, bool)
        filled[cell] = True
        todo = todo[~filled.reshape(len(texts), COORDINATES)[todo].all(axis=1)]
        scale *= 2
    return having, out[having]


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A row of band hashes for each signature."""
    parts = signature.reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64), parts.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key * U64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


def _signature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 40
    for part in slices(batches):
        texts = texts_of(part)
        digests = [hashlib.blake2b(t or b"", digest_size=16).digest() for t in texts]
        # One signature for each distinct text of the slice.
        first = {d: i for i, d in reversed(list(enumerate(digests)))}
        own = sorted(first.values())
        having, signature = signatures([texts[i] for i in own])
        bands: list = [None] * len(texts)
        for i, keys in zip(having, band_keys(signature).tolist()):
            bands[own[i]] = keys
        keys = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        has_words = {digests[own[i]] for i in having}
        yield pa.RecordBatch.from_pydict(
            {
                "row": pa.array(np.arange(row, row + len(texts)), pa.int64()),
                "doc_id": part.column("doc_id"),
                "r1": part.column("r1"),
                "r2": part.column("r2"),
                # A text without words is like no other.
                "k1": pa.array([k if d in has_words else None for k, d in zip(keys[:, 0].tolist(), digests)], pa.int64()),
                "k2": pa.array(keys[:, 1], pa.int64()),
                "bands": pa.array(bands, pa.list_(pa.int64())),
            }
        )
        row += len(texts)


# ---- comparing -------------------------------------------------------------------------


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices([whole], "text_a", 4 << 20):
            left, right = texts_of(batch, "text_a"), texts_of(batch, "text_b")
            different = {t: i for i, t in enumerate(dict.fromkeys(right))}
            sets = []
            for texts in (left, list(different)):
                text, shingle, weight = weighted_sets(texts)
                bounds = np.searchsorted(text, np.arange(len(texts) + 1))
                sets.append([(shingle[x:y], weight[x:y]) for x, y in zip(bounds[:-1], bounds[1:])])
            values = [similarity(sets[0][i], sets[1][different[t]]) for i, t in enumerate(right)]
            yield pa.RecordBatch.from_pydict(
                {"a": batch.column("a"), "b": batch.column("b"), "similarity": pa.array(values, pa.float64())}
            )


def compare(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Exact similarities of pairs (a, b) of rows; ``texts`` has row and text."""
    left = texts.select(F.col("row").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("row").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_compare, "a long, b long, similarity double")


# ---- open documents --------------------------------------------------------------------

BLOCK = 2048


def _connecting_links(rows: pa.Table, threshold: float) -> pa.Table:
    """Links between the open documents of a group and its members, as far as they connect
    components that are not connected yet."""
    is_open = rows.column("is_open").to_numpy(zero_copy_only=False)
    row, label = rows.column("row").to_numpy(), rows.column("component").to_numpy()
    text, shingle, weight = weighted_sets([t.encode() for t in rows.column("text").to_pylist()])
    sizes = np.bincount(text, weight, len(row))
    first = np.searchsorted(text, np.arange(len(row) + 1))
    order = np.argsort(shingle, kind="stable")
    listed = shingle[order]
    parent = {c: c for c in np.unique(label).tolist()}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    links = []
    for y in np.flatnonzero(is_open).tolist():
        own, own_weight = shingle[first[y] : first[y + 1]], weight[first[y] : first[y + 1]]
        low, high = np.searchsorted(listed, own), np.searchsorted(listed, own, "right")
        n = high - low
        at = order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        shared = np.bincount(text[at], np.minimum(weight[at], np.repeat(own_weight, n)), len(row))
        near = shared / (sizes[y] + sizes - shared) >= threshold
        for x in np.flatnonzero(near & ~is_open & (row != row[y])).tolist():
            p, q = root(int(label[y])), root(int(label[x]))
            if p != q:
                parent[p] = q
                links.append((int(row[y]), int(row[x])))
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def _open_links(compared: DataFrame, links: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links of documents that are not near a centre, to others with the same centre.

    Both sides of a centre's group are cut into blocks, so that a group of any size is spread.
    """
    members = compared.select(F.col("b").alias("centre"), F.col("a").alias("row"), (F.col("similarity") < threshold).alias("is_open"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    groups = (
        members.groupBy("centre")
        .agg(F.count("*").alias("n"), F.count_if("is_open").alias("n_open"))
        .where("n > 1 and n_open > 0")
        .select("centre", blocks(F.col("n")).alias("blocks"), blocks(F.col("n_open")).alias("open_blocks"))
    )
    label = connected_components(links).withColumnRenamed("node", "row")
    named = (
        members.join(groups, "centre")
        .join(label, "row", "left")
        .join(texts, "row")
        .select("centre", "row", "is_open", "text", F.coalesce("component", "row").alias("component"), "blocks", "open_blocks")
    )
    own = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["centre", "row", "is_open", "text", "component"]
    asking = named.where("is_open").select(*columns, own("open_blocks").alias("i"), every("blocks").alias("j"))
    asked = named.withColumn("is_open", F.lit(False)).select(*columns, every("open_blocks").alias("i"), own("blocks").alias("j"))
    return asking.union(asked).groupBy("centre", "i", "j").applyInArrow(lambda t: _connecting_links(t, threshold), "a long, b long")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: row (its number in this result), doc_id, r1, r2 (hashes of id and text),
    class_id, class_size and is_first.

    A class holds documents connected by similarities of ``threshold`` or more; equal texts are
    copies of each other. ``class_id`` is the smallest doc_id of the class; ``is_first`` marks one
    document, of smallest doc_id, in each class.

    Defined results: a null or empty text, or one without words, is in a class of its own; rows
    without an id take part, and name a class only if no row of it has an id (then class_id is null);
    repeated rows are documents each; extra columns are ignored.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns(
        {"r1": F.xxhash64("doc_id", "text"), "r2": F.xxhash64("text", "doc_id")}
    )
    path = scratch_path(spark, "signatures")
    keyed.select("doc_id", "text", "r1", "r2").mapInArrow(_signature_rows, SIGNATURE_SCHEMA).write.parquet(path)
    signed = spark.read.schema(SIGNATURE_SCHEMA).parquet(path)

    # Equal texts are one from here on: the row with the smallest number that has the bands.
    texts = settle(
        signed.where("k1 is not null")
        .groupBy("k1", "k2")
        .agg(F.min(F.when(F.col("bands").isNotNull(), F.col("row"))).alias("text_row"))
    )
    chosen = signed.where("bands is not null").join(texts.select(F.col("text_row").alias("row")), "row", "left_semi")
    banded = chosen.select("row", F.explode("bands").alias("band"))
    sizes = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    met = settle(banded.join(sizes, "band"))
    # The centre of a band: the one of its documents that meets most others in all bands.
    popular = met.groupBy("row").agg(F.sum("n").alias("meets"))
    centres = met.join(popular, "row").groupBy("band").agg(F.max(F.struct("meets", (-F.col("row")).alias("row"))).alias("best"))
    centres = centres.select("band", (-F.col("best.row")).alias("centre"))
    meetings = met.join(centres, "band").where("row <> centre")

    pairs = meetings.select(F.col("row").alias("a"), F.col("centre").alias("b")).distinct()
    pairs = settle(pairs)
    involved = pairs.select(F.col("a").alias("row")).union(pairs.select(F.col("b").alias("row"))).distinct()
    wanted = signed.select("row", "r1", "r2").join(involved, "row", "left_semi")
    # Repeated rows have the same hashes and the same text.
    found = keyed.select("r1", "r2", "text").join(wanted, ["r1", "r2"]).select("row", "text")
    found = settle(found.dropDuplicates(["row"]))
    compared = settle(compare(pairs, found))
    links = compared.where(F.col("similarity") >= threshold).select("a", "b")

    opened = settle(_open_links(compared, links, found, threshold))
    links = links.union(opened)

    label = connected_components(links).select(F.col("node").alias("text_row"), "component")
    classes = texts.join(label, "text_row", "left").select("k1", "k2", F.coalesce("component", "text_row").alias("class"))
    placed = signed.select("row", "doc_id", "r1", "r2", "k1", "k2").join(classes, ["k1", "k2"], "left")
    placed = settle(placed.select("row", "doc_id", "r1", "r2", F.coalesce("class", "row").alias("class")))
    # Only the classes are read from here on.
    discard(signed, texts, met, pairs, found, compared, opened)
    # Written, so that the join below has a plain exchange on both sides and a large class can be split.
    heads = settle(
        placed.groupBy("class").agg(
            F.min("doc_id").alias("class_id"),
            F.count("*").alias("class_size"),
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("head"),
        )
    )
    return placed.join(heads, "class").select(
        "row", "doc_id", "r1", "r2", "class_id", "class_size", (F.col("row") == F.col("head.row")).alias("is_first")
    )


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each class of near-duplicates, all columns kept.

    The document that stays has the smallest id of its class; of repeated rows one stays.
    """
    first = near_duplicates(docs, threshold).where("is_first").select("r1", "r2")
    doc_id = F.col("doc_id").cast("long")
    whole = F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("doc")
    keyed = docs.select(F.xxhash64(doc_id, "text").alias("r1"), F.xxhash64("text", doc_id).alias("r2"), whole)
    return keyed.join(first, ["r1", "r2"], "left_semi").dropDuplicates(["r1", "r2"]).select("doc.*")
