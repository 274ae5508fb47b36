"""Language of documents by unigrams of vocabulary pieces, over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary of byte strings. A unit
(a run of letters with a blank before it) can be cut into pieces in many ways; its probability in a
language is the sum over all of them of the product of the pieces' probabilities, which the forward
algorithm adds up from left to right. A text's probability is the product over its units.

Learning is expectation-maximisation over whole texts: backward sums beside the forward ones give how
often each piece is expected in the units of a language, over all segmentations. The first round
starts from equal probabilities of all pieces. Sums are kept in whole steps, so they do not depend on
the order of tasks. A piece's share in a language is mixed with its share in all languages and with
equal shares, in fixed proportions.

Units are runs of a-z and of bytes above ASCII in the lower-cased text, in stretches of at most 31
bytes. Every byte that can occur is a piece of its own, so every unit has a segmentation.

Defined results: ``und`` with score 0 for a text that is null or has no letter, and for every text if
nothing was learned. A row without an id is judged, but not learned from. Equal texts get equal
results; among equally likely languages the first by code point is chosen. Other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from shelfcast.llm.totals import SCHEMA, add_up, parts
from shelfcast.llm.words import BASE, BYTE_CODES, U64, WordForm, _hash_spans, find_words, powers, slices, texts_of

#: A file of byte pieces: base64 and rank in each line.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
UNKNOWN = "und"
FOLDS, HELD_OUT = 4, 2
ROUNDS = 1
# Bytes of a unit, without the blank before it.
STRETCH = 31
# Shares of all languages' distribution in a language's, and of equal probabilities in that.
POOLED, EQUAL = 0.01, 0.01
# Expected counts are kept in steps of 1 / FINE.
FINE = 1 << 16
PART_COUNTS = 1 << 12
SLICE = 4 << 20
# Distinct units kept at a time, and probabilities worked on at a time.
KEPT, CELLS = 1 << 17, 1 << 22


def _letters() -> WordForm:
    word = np.zeros(256, bool)
    word[0x61:0x7B] = word[0x80:] = True
    return WordForm("letters", word, BYTE_CODES)


LETTERS = _letters()
_STEP = powers(BASE, STRETCH + 2)


# ---- the vocabulary --------------------------------------------------------------------


@dataclass
class Pieces:
    """Pieces by number, and for each length the hashes of their beginnings with the piece that ends there, or -1."""

    names: list[bytes]
    heads: list[np.ndarray] = field(default_factory=list)
    ends: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def of(cls, names: Sequence[bytes]) -> Pieces:
        """The pieces that can occur in a unit: letters, at most a blank before them, and single bytes."""
        single = [b" ", *[bytes([b]) for b in range(256) if LETTERS.is_word[b]]]
        usable = {p for p in names if 0 < len(p) <= STRETCH + 1 and all(LETTERS.is_word[b] for b in (p[1:] if p[:1] == b" " else p))}
        pieces = cls(sorted(usable | set(single)))
        by_length: list[dict[int, int]] = [{} for _ in range(STRETCH + 2)]
        for number, name in enumerate(pieces.names):
            marks = np.cumsum(BYTE_CODES[np.frombuffer(name, np.uint8)] * _STEP[: len(name)]).tolist()
            for length, mark in enumerate(marks, 1):
                if length == len(name):
                    by_length[length][mark] = number
                else:
                    by_length[length].setdefault(mark, -1)
        for found in by_length:
            marks = np.array(sorted(found), U64)
            pieces.heads.append(marks)
            pieces.ends.append(np.array([found[int(m)] for m in marks], np.int64))
        return pieces

    def __len__(self) -> int:
        return len(self.names)


def read_vocabulary(path: str = VOCABULARY) -> Pieces:
    with open(path, "rb") as lines:
        return Pieces.of([base64.b64decode(line.split()[0]) for line in lines if line.strip()])


# ---- units -----------------------------------------------------------------------------


@dataclass
class Units:
    """Distinct units: hashes in order, bytes after a blank in rows of one width, and lengths with the blank."""

    hashes: np.ndarray
    letters: np.ndarray
    lengths: np.ndarray

    def __len__(self) -> int:
        return len(self.hashes)

    def pick(self, which: np.ndarray) -> Units:
        return Units(self.hashes[which], self.letters[which], self.lengths[which])


def units_of(texts: list[bytes | None]) -> tuple[Units, np.ndarray, np.ndarray]:
    """(distinct units of lower-cased texts, which of them each unit is, which text it is in)."""
    words = find_words(texts, LETTERS)
    size = words.ends - words.starts
    runs = -(-size // STRETCH)
    first = np.repeat(words.starts, runs) + STRETCH * (np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs))
    last = np.minimum(first + STRETCH, np.repeat(words.ends, runs))
    hashes = words.hashes if len(first) == len(size) else _hash_spans(words.data, first, last, BYTE_CODES)
    found, at, which = np.unique(hashes, return_index=True, return_inverse=True)
    place = first[at][:, None] + np.arange(STRETCH)
    inside = place < last[at][:, None]
    letters = np.full((len(found), STRETCH + 1), ord(" "), np.uint8)
    letters[:, 1:] = np.where(inside, words.data[np.where(inside, place, 0)] if len(words.data) else 0, 0)
    return Units(found, letters, last[at] - first[at] + 1), which, np.repeat(words.text_of(), runs)


Hit = tuple[int, int, np.ndarray, np.ndarray]


def forward(units: Units, pieces: Pieces, chances: np.ndarray, hits: list[Hit] | None = None) -> np.ndarray:
    """Sums over all segmentations of each unit's first bytes: (unit, bytes, column of ``chances``).

    ``hits`` receives (start, end, units, pieces) of all places where a piece fits.
    """
    codes = BYTE_CODES[units.letters]
    sums = np.zeros((len(units), STRETCH + 2, chances.shape[1]))
    sums[:, 0] = 1
    for start in range(STRETCH + 1):
        # Units that still follow the beginning of some piece from here on.
        alive = np.flatnonzero(units.lengths > start)
        mark = np.zeros(len(alive), U64)
        for end in range(start + 1, STRETCH + 2):
            if end > start + 1:
                longer = units.lengths[alive] >= end
                alive, mark = alive[longer], mark[longer]
            if not len(alive):
                break
            mark = mark + codes[alive, end - 1] * _STEP[end - 1 - start]
            heads = pieces.heads[end - start]
            at = np.minimum(np.searchsorted(heads, mark), max(len(heads) - 1, 0))
            on = heads[at] == mark if len(heads) else np.zeros(len(mark), bool)
            alive, mark, piece = alive[on], mark[on], pieces.ends[end - start][at[on]]
            here = piece >= 0
            found, piece = alive[here], piece[here]
            sums[found, end] += sums[found, start] * chances[piece]
            if hits is not None:
                hits.append((start, end, found, piece))
    return sums


def totals_of(units: Units, sums: np.ndarray) -> np.ndarray:
    return sums[np.arange(len(units)), units.lengths]


def expected(units: Units, pieces: Pieces, chances: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the units: (column of ``weight``, piece).

    ``weight`` has the occurrences of each unit; ``chances`` one column for all, or one for each of its columns.
    """
    out = np.zeros((weight.shape[1], len(pieces)))
    block = max(1, CELLS // ((STRETCH + 2) * chances.shape[1]))
    for at in range(0, len(units), block):
        part, own = units.pick(np.s_[at : at + block]), weight[at : at + block]
        hits: list[Hit] = []
        before = forward(part, pieces, chances, hits)
        behind = np.zeros_like(before)
        behind[np.arange(len(part)), part.lengths] = 1
        whole = totals_of(part, before)
        for start, end, found, piece in reversed(hits):
            behind[found, start] += chances[piece] * behind[found, end]
        for start, end, found, piece in hits:
            share = own[found] * (before[found, start] * chances[piece] * behind[found, end] / whole[found])
            for k in range(len(out)):
                out[k] += np.bincount(piece, share[:, k], len(pieces))
    return out


# ---- learning --------------------------------------------------------------------------


@dataclass
class Languages:
    """Pieces and their probabilities, a column for each language."""

    pieces: Pieces
    names: list[str]
    chances: np.ndarray


def mixed(counts: np.ndarray) -> np.ndarray:
    """Probabilities (piece, language) from expected counts (language, piece)."""
    n_pieces = counts.shape[1]
    equal = np.full(n_pieces, 1 / n_pieces)
    pooled = counts.sum(axis=0)
    pooled = (1 - EQUAL) * pooled / pooled.sum() + EQUAL * equal if pooled.any() else equal
    sums = counts.sum(axis=1, keepdims=True)
    own = np.where(sums > 0, counts / np.where(sums > 0, sums, 1), pooled)
    return ((1 - POOLED) * own + POOLED * pooled).T


def _count_rows(batches: Iterator[pa.RecordBatch], model: Languages, padded: int) -> Iterator[pa.RecordBatch]:
    """This task's expected counts; equal units of up to KEPT different ones are worked on once."""
    place = {name: k for k, name in enumerate(model.names)}
    total = np.zeros((len(model.names), len(model.pieces)))
    waiting: list[tuple[Units, np.ndarray]] = []

    def merged() -> tuple[Units, np.ndarray]:
        both = [np.concatenate(c) for c in zip(*[(u.hashes, u.letters, u.lengths, w) for u, w in waiting])]
        _, at, which = np.unique(both[0], return_index=True, return_inverse=True)
        weight = np.zeros((len(at), both[3].shape[1]))
        np.add.at(weight, which, both[3])
        return Units(both[0][at], both[1][at], both[2][at]), weight

    for part in slices(batches, limit=SLICE):
        units, which, text = units_of(texts_of(part))
        language = np.array([place[name] for name in part.column("lang").to_pylist()], np.int64)
        cells = np.bincount(which * len(place) + language[text], minlength=len(units) * len(place))
        waiting.append((units, cells.reshape(len(units), len(place)).astype(np.float64)))
        if sum(len(u) for u, _ in waiting) > KEPT:
            waiting = [merged()]
            if len(waiting[0][0]) > KEPT // 2:
                total += expected(waiting[0][0], model.pieces, model.chances, waiting[0][1])
                waiting = []
    if waiting:
        units, weight = merged()
        total += expected(units, model.pieces, model.chances, weight)
    table = np.zeros((len(model.names), padded), np.int64)
    table[:, : len(model.pieces)] = np.rint(total * FINE)
    yield parts(table, PART_COUNTS)


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS


def fit(docs: DataFrame, vocabulary: str = VOCABULARY, rounds: int = ROUNDS) -> Languages:
    """Piece probabilities of each language, learned from ``text`` and ``lang`` of all rows given.

    What comes to the driver is one count for each language and piece.
    """
    pieces = read_vocabulary(vocabulary)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", F.lower("text").alias("text"))
    names = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    model = Languages(pieces, names, np.full((len(pieces), 1), 1 / len(pieces)))
    padded = -(-len(pieces) // PART_COUNTS) * PART_COUNTS
    for _ in range(rounds if names else 0):
        rows = known.mapInArrow(lambda it, model=model: _count_rows(it, model, padded), SCHEMA)
        counts = add_up(rows, (len(names), padded), PART_COUNTS)[:, : len(pieces)] / FINE
        model = Languages(pieces, names, mixed(counts))
    return model


# ---- prediction ------------------------------------------------------------------------


class Memory:
    """Log probabilities of units already seen in a task, up to KEPT of them."""

    def __init__(self, model: Languages):
        self.model = model
        self.hashes = np.empty(0, U64)
        self.logs = np.empty((0, len(model.names)))

    def logs_of(self, units: Units) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, units.hashes), max(len(self.hashes) - 1, 0))
        seen = self.hashes[at] == units.hashes if len(self.hashes) else np.zeros(len(units), bool)
        out = np.empty((len(units), self.logs.shape[1]))
        out[seen] = self.logs[at[seen]]
        new = units.pick(~seen)
        fresh = [np.empty((0, self.logs.shape[1]))]
        block = max(1, CELLS // ((STRETCH + 2) * self.logs.shape[1]))
        for start in range(0, len(new), block):
            part = new.pick(np.s_[start : start + block])
            fresh.append(np.log(totals_of(part, forward(part, self.model.pieces, self.model.chances))))
        out[~seen] = np.concatenate(fresh)
        if len(self.hashes) + len(new) > KEPT:
            self.hashes, self.logs = units.hashes, out
        elif len(new):
            hashes = np.concatenate([self.hashes, new.hashes])
            order = np.argsort(hashes)
            self.hashes, self.logs = hashes[order], np.concatenate([self.logs, out[~seen]])[order]
        return out


def text_logs(texts: list[bytes | None], memory: Memory) -> np.ndarray:
    """The log probability of each lower-cased text in each language."""
    units, which, text = units_of(texts)
    logs = memory.logs_of(units)
    return np.stack([np.bincount(text, logs[which, k], len(texts)) for k in range(logs.shape[1])], axis=1)


def _predicted_rows(batches: Iterator[pa.RecordBatch], model: Languages, names: list[str]) -> Iterator[pa.RecordBatch]:
    memory = Memory(model)
    languages = np.array(model.names, object)
    for part in slices(batches, "_text", SLICE):
        logs = text_logs(texts_of(part, "_text"), memory)
        best = logs.argmax(axis=1)
        score = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        columns = {n: part.column(n) for n in names}
        yield pa.RecordBatch.from_pydict(columns | {"lang_pred": pa.array(languages[best], pa.string()), "score": pa.array(score, pa.float64())})


def predict(docs: DataFrame, model: Languages, columns: list[str]) -> DataFrame:
    """``columns`` of every document, ``lang_pred`` and ``score``, its share of the probability of all
    languages. Neither name can be among ``columns``; put such a one into a struct."""
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    chosen = docs.select(*columns, lettered.alias("_lettered"), F.when(lettered, F.lower("text")).alias("_text"))
    if not model.names:
        return chosen.select(*columns, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    passed = [*columns, "_lettered"]
    schema = StructType([*chosen.select(*passed).schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    found = chosen.mapInArrow(lambda it: _predicted_rows(it, model, passed), schema)
    return found.select(
        *columns,
        F.when(F.col("_lettered"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("_lettered"), F.col("score")).otherwise(0.0).alias("score"),
    )


def judged(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; learned from the other fold."""
    model = fit(docs.where(fold() != HELD_OUT), vocabulary)
    held_out = F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out")
    return predict(docs, model, ["doc_id"]).select("doc_id", held_out, "lang_pred", "score")
