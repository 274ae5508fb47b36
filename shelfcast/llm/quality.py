"""Quality of documents: random-indexing word vectors, pooled, and a small network.

*Random indexing.* Every word has an index vector: a few entries of +1 or -1 at places given by its
hash, zeros elsewhere. The vector of a word is the sum of the index vectors of the words around it,
over the whole corpus. Words share a fixed number of rows by hash, so the table has a fixed size;
its entries are whole numbers, added up exactly in any order. The form of a word (letter case,
digits, symbols, length) is a second stream of words with rows of its own.

*Pooling.* A document is the mean of the vectors of its words and of its forms, with the mean
agreement of the index vectors of neighbours, and its length.

*Network.* Two layers in NumPy, trained on a bounded sample of labelled documents; the probability is
calibrated by a temperature fitted on rows that the training did not see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from shelfcast.llm.labelled import held_out, training_sample
from shelfcast.llm.totals import SCHEMA, add_up, parts
from shelfcast.llm.words import SPACED, U64, Words, find_words, mix, slices, texts_of

DIMENSIONS = 48
WORD_ROWS = 8192
FORM_ROWS = 512
TABLE_ROWS = WORD_ROWS + FORM_ROWS
ENTRIES = 2
REACH = 2
PART_ROWS = 64
HIDDEN = 32
#: Labelled documents of each label that the network is trained on, at most.
PER_LABEL = 4000
FEATURES = 2 * DIMENSIONS + 2 * REACH + 1


# ---- streams of words ------------------------------------------------------------------


def _class_counts(words: Words, wanted: np.ndarray) -> np.ndarray:
    """How many bytes of a class each word has."""
    done = np.concatenate([[0], np.cumsum(wanted[words.data], dtype=np.int64)])
    return done[words.ends] - done[words.starts]


def _bytes(of: bytes) -> np.ndarray:
    wanted = np.zeros(256, bool)
    wanted[list(of)] = True
    return wanted


UPPER = _bytes(bytes(range(0x41, 0x5B)))
LOWER = _bytes(bytes(range(0x61, 0x7B)))
DIGIT = _bytes(bytes(range(0x30, 0x3A)))
PAUSE = _bytes(b".,;:?'-")
OTHER = _bytes(bytes(range(0x21, 0x30)) + b":;<=>?@[\\]^_`{|}~") & ~PAUSE


def forms(words: Words) -> np.ndarray:
    """A small number for the form of each word."""
    size = words.ends - words.starts
    upper, lower, digit, other, pause = (_class_counts(words, c) for c in (UPPER, LOWER, DIGIT, OTHER, PAUSE))
    case = np.where(upper == 0, 0, np.where((upper == 1) & (lower > 0), 1, np.where(lower == 0, 3, 2)))
    form = case
    form = form * 3 + np.minimum(other, 2)
    form = form * 2 + (digit > 0)
    form = form * 2 + (pause > 0)
    return form * 4 + np.searchsorted([3, 8, 20], size)


def streams(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of each word, and of each word's form."""
    form = forms(words).astype(U64)
    word_row = (words.hashes % U64(WORD_ROWS)).astype(np.int64)
    return [(word_row, words.hashes), (WORD_ROWS + (form % U64(FORM_ROWS)).astype(np.int64), mix(form + U64(1)))]


def index_entries(hashes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The places and signs of the entries of each index vector."""
    out = []
    for e in range(ENTRIES):
        h = mix(hashes ^ U64(0x9E3779B97F4A7C15 * (e + 1) & 0xFFFFFFFFFFFFFFFF))
        out.append(((h % U64(DIMENSIONS)).astype(np.int64), 1.0 - 2.0 * (h >> U64(63)).astype(np.float64)))
    return out


# ---- the table of word vectors ---------------------------------------------------------


def _context_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = TABLE_ROWS * DIMENSIONS
    sums = np.zeros(size)
    for part in slices(batches):
        words = find_words(texts_of(part), SPACED)
        text = words.text_of()
        for row, hashes in streams(words):
            entries = index_entries(hashes)
            for gap in range(1, REACH + 1):
                together = np.flatnonzero(text[gap:] == text[:-gap])
                for here, there in ((together, together + gap), (together + gap, together)):
                    for place, sign in entries:
                        sums += np.bincount(row[here] * DIMENSIONS + place[there], sign[there], size)
    yield parts(sums, PART_ROWS * DIMENSIONS)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The table of word vectors, each of length 1, summed over all documents.

    It has a fixed size (8,704 rows of 48 numbers), whatever the corpus.
    """
    rows = docs.select("text").mapInArrow(_context_sums, SCHEMA)
    table = add_up(rows, (TABLE_ROWS, DIMENSIONS), PART_ROWS * DIMENSIONS)
    length = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.maximum(length, 1)).astype(np.float32)


# ---- documents as vectors --------------------------------------------------------------


def features(texts: list[bytes | None], vectors: np.ndarray) -> np.ndarray:
    """A row for each text; one without words is all zeros."""
    words = find_words(texts, SPACED)
    text, counts = words.text_of(), words.counts
    filled = np.flatnonzero(counts)
    out = np.zeros((len(texts), FEATURES), np.float32)
    if not len(filled):
        return out
    starts, n = words.first[filled], counts[filled]
    for k, (row, hashes) in enumerate(streams(words)):
        means = np.add.reduceat(vectors[row], starts, axis=0, dtype=np.float64) / n[:, None]
        out[filled, k * DIMENSIONS : (k + 1) * DIMENSIONS] = means
        if k == 0:
            entries = index_entries(hashes)
        for gap in range(1, REACH + 1):
            agree = np.zeros(len(text))
            if len(text) > gap:
                own = index_entries(hashes) if k else entries
                for place, sign in own:
                    for place_2, sign_2 in own:
                        agree[gap:] += (place[gap:] == place_2[:-gap]) * sign[gap:] * sign_2[:-gap]
                agree[gap:] *= text[gap:] == text[:-gap]
            at = 2 * DIMENSIONS + k * REACH + gap - 1
            out[filled, at] = np.add.reduceat(agree, starts) / (ENTRIES * n)
    out[filled, -1] = np.log1p(n)
    return out


# ---- the network -----------------------------------------------------------------------


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def loss(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    p = np.clip(sigmoid(z), 1e-9, 1 - 1e-9)
    return float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum())


def fit_temperature(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The temperature with the smallest log loss.

    The goal of a label is (n + 1) / (n + 2) rather than 1, with n rows of it, so that scores
    without an error stay no surer than so many rows allow.
    """
    ones, zeros = y.sum(), (1 - y).sum()
    goal = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    grid = np.exp(np.linspace(np.log(0.25), np.log(16), 81))
    return float(min(grid, key=lambda t: loss(z / t, goal, weight))) if len(z) else 1.0


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 7, epochs: int = 60, batch: int = 64) -> Network:
    """Fit the network by Adam on four fifths of the rows and the temperature on the rest."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64)
    spare = np.arange(len(x)) % 5 == 4
    mean, scale = x[~spare].mean(axis=0), x[~spare].std(axis=0) + 1e-3
    xs = (x[~spare] - mean) / scale
    ys, ws = y[~spare], weight[~spare] / weight[~spare].mean()
    share = np.clip((ws * ys).sum() / ws.sum(), 0.01, 0.99)
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.log(share / (1 - share))]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(xs))
        for at in range(0, len(order), batch):
            i = order[at : at + batch]
            hidden = np.tanh(xs[i] @ p[0] + p[1])
            error = ws[i] * (sigmoid(hidden @ p[2] + p[3]) - ys[i]) / len(i)
            back = np.outer(error, p[2]) * (1 - hidden**2)
            grads = [xs[i].T @ back + 1e-4 * p[0], back.sum(axis=0), hidden.T @ error + 1e-4 * p[2], error.sum()]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.005 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    network = Network(mean, scale, p[0], p[1], p[2], float(p[3]), 1.0)
    network.temperature = fit_temperature(network.logits(x[spare]), y[spare], weight[spare])
    return network


def _feature_rows(batches: Iterator[pa.RecordBatch], vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        x = features(texts_of(part), vectors)
        yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "x": pa.array(list(x), pa.list_(pa.float32()))})


def _score_rows(batches: Iterator[pa.RecordBatch], vectors: np.ndarray, network: Network, names: list[str]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        scores = network.scores(features(texts_of(part), vectors))
        columns = {n: part.column(n) for n in names}
        yield pa.RecordBatch.from_pydict(columns | {"score": pa.array(scores, pa.float64())})


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = PER_LABEL) -> tuple[np.ndarray, Network]:
    """Word vectors of all documents, and the network trained on a bounded labelled sample.

    Documents with the same id count once in training. Without any labelled document every score
    is one half.
    """
    vectors = word_vectors(docs)
    sample = training_sample(labels, label, per_label)
    # At most 2 * per_label ids.
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")
    rows = chosen.mapInArrow(lambda it: _feature_rows(it, vectors), "doc_id long, x array<float>")
    rows = rows.groupBy("doc_id").agg(F.min("x").alias("x")).join(sample, "doc_id")
    found = sorted(rows.collect(), key=lambda r: (hash_of(r["doc_id"]), r["doc_id"]))
    if not found:
        zero = np.zeros(FEATURES)
        return vectors, Network(zero, zero + 1, np.zeros((FEATURES, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0, 1.0)
    x = np.array([r["x"] for r in found], np.float32)
    y, weight = (np.array([float(r[c]) for r in found]) for c in ("label", "weight"))
    return vectors, train(x, y, weight)


def hash_of(doc_id: int) -> int:
    """A fixed shuffle of the ids."""
    return int(mix(np.array([doc_id], np.int64).view(U64))[0])


def score(docs: DataFrame, labels: DataFrame, columns: list[str], label: str = "quality") -> DataFrame:
    """``columns`` of every document and ``score``, the probability of label 1. A column of that
    name cannot be among them; put it into a struct.

    Only text goes into a score. Defined results: null and empty texts have the score of a document
    without words; repeated rows get equal scores; other columns are ignored.
    """
    vectors, network = fit(docs, labels, label)
    chosen = docs.select(*dict.fromkeys([*columns, "text"]))
    schema = StructType([*chosen.select(*columns).schema.fields, StructField("score", DoubleType())])
    return chosen.mapInArrow(lambda it: _score_rows(it, vectors, network, columns), schema)


def judged(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score(docs, labels, ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
