"""Words of many texts at once, as NumPy arrays over their UTF-8 bytes.

Both word patterns used here are decided byte by byte: every byte of a character outside ASCII
is a word byte. So words are found and hashed without making a Python object of each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
# Odd multiplier of the polynomial hashes, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
# Bytes hashed at a time.
PIECE = 1 << 19
# Words of so many bytes are hashed by a digest.
LONG = 256
# Text handled at a time by the operators.
SLICE_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a one-to-one mapping)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(n, U64)
    out[1:] = U64(base)
    return np.multiply.accumulate(out)


BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_UP, _DOWN = powers(BASE, PIECE + 1), powers(INVERSE, PIECE + 1)


@dataclass(frozen=True)
class WordForm:
    """Which bytes belong to words, and whether A-Z count as a-z."""

    name: str
    is_word: np.ndarray
    codes: np.ndarray


def _spaced() -> WordForm:
    word = np.ones(256, bool)
    word[[0x20, *range(0x09, 0x0E)]] = False
    return WordForm("spaced", word, BYTE_CODES)


def _folded() -> WordForm:
    word = np.zeros(256, bool)
    word[0x30:0x3A] = word[0x41:0x5B] = word[0x61:0x7B] = word[0x80:] = True
    codes = BYTE_CODES.copy()
    codes[0x41:0x5B] = codes[0x61:0x7B]
    return WordForm("folded", word, codes)


# ``[^\x20\x09-\x0D]+``, unchanged.
SPACED = _spaced()
# ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
FOLDED = _folded()


@dataclass
class Words:
    """The words of consecutive texts.

    ``starts`` and ``ends`` are byte offsets in ``data``; the words of text ``t`` are those from
    ``first[t]`` up to ``first[t + 1]``.
    """

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def _hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        at = int(starts[i])
        j = int(np.searchsorted(ends, at + PIECE, "right"))
        if j <= i:  # one word longer than a piece
            total, scale = 0, 1
            for p in range(at, int(ends[i]), PIECE):
                part = codes[data[p : min(p + PIECE, int(ends[i]))]]
                total += int((part * _UP[: len(part)]).sum(dtype=U64)) * scale
                scale = scale * pow(BASE, PIECE, 1 << 64) & ((1 << 64) - 1)
            out[i] = total & ((1 << 64) - 1)
            i += 1
            continue
        stop = int(ends[j - 1])
        sums = np.zeros(stop - at + 1, U64)
        np.cumsum(codes[data[at:stop]] * _UP[: stop - at], out=sums[1:])
        s = starts[i:j] - at
        out[i:j] = (sums[ends[i:j] - at] - sums[s]) * _DOWN[s]
        i = j
    for k in np.flatnonzero(ends - starts >= LONG):
        # Some long runs of two letters and of their exchange have one polynomial value modulo 2**64.
        digest = hashlib.blake2b(codes[data[starts[k] : ends[k]]].tobytes(), digest_size=8)
        out[k] = int.from_bytes(digest.digest(), "little")
    return mix(out)


def find_words(texts: list[bytes | None], form: WordForm) -> Words:
    """The words of each text, in order; a null text has none."""
    joined = b" ".join([t or b"" for t in texts])
    data = np.frombuffer(joined, np.uint8)
    edge = np.zeros(len(data) + 2, np.int8)
    edge[1:-1] = form.is_word[data]
    step = np.diff(edge)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    lengths = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    first = np.searchsorted(starts, bounds)
    return Words(data, starts, ends, first, _hash_spans(data, starts, ends, form.codes))


def rolling(symbols: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n consecutive symbols; one entry for each place where a run starts."""
    count = len(symbols) - n + 1
    if count <= 0:
        return np.empty(0, U64)
    out = np.empty(count, U64)
    for at in range(0, count, PIECE - n):
        stop = min(at + PIECE - n, count)
        part = symbols[at : stop + n - 1]
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(part * _UP[: len(part)], out=sums[1:])
        out[at:stop] = (sums[n:] - sums[:-n]) * _DOWN[: stop - at]
    return mix(out)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], name: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in runs of about ``limit`` bytes of text; a longer text is a run of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
        done = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(done, done[at] + limit, "right")) - 1)
            yield batch.slice(at, stop - at)
            at = stop


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For n places, whether any of the half-open spans covers each."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]) > 0
