"""Quality rules: counts of each text, and the log-likelihood ratio of its hashed n-grams between
trusted documents and the whole corpus.

Words and pairs of neighbours are hashed into a fixed number of buckets. Two multinomials over the
buckets are counted: one over all documents, one over trusted documents. A document's score is the
mean, over its n-grams, of log(trusted share / corpus share); it is kept if the score reaches a
threshold and the base rules hold. Every document is judged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.quality import _bytes, _class_counts
from shelfcast.llm.totals import SCHEMA, add_up, parts
from shelfcast.llm.words import SPACED, U64, Words, covered, find_words, mix, rolling, slices, texts_of

BUCKETS = 1 << 16
PART = 1 << 11
# Share of the corpus multinomial mixed into the target: the ratio of a bucket without trusted
# counts is about this.
MIXED_IN = 0.02
THRESHOLD = -0.15
LEAST_WORDS = 50

SYMBOLS = _bytes(b"#*$%&|<>")
# Bytes that begin a character.
LEADING = np.array([not 0x80 <= b < 0xC0 for b in range(256)])


# ---- counts of a text ------------------------------------------------------------------


def repeated_words(words: Words, n: int = 3) -> np.ndarray:
    """How many words of each text are in runs of ``n`` words that occur twice or more in it."""
    text = words.text_of()
    if len(text) < n:
        return np.zeros(len(words.counts), np.int64)
    starts = np.flatnonzero(text[n - 1 :] == text[: len(text) - n + 1])
    key = rolling(words.hashes, n)[starts] ^ mix(text[starts].astype(U64) + U64(1))
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    again = starts[counts[inverse] > 1]
    return np.bincount(text[covered(len(text), again, again + n)], minlength=len(words.counts))


def repeated_lines(text: bytes | None) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [line for line in (text or b"").split(b"\n") if line.split()]
    return len(lines) - len(set(lines))


def base_counts(texts: list[bytes | None], words: Words) -> dict[str, np.ndarray]:
    text, size = words.text_of(), len(texts)
    total = lambda each: np.bincount(text, each, size).astype(np.int64)
    return {
        "n_words": words.counts,
        "word_chars": total(_class_counts(words, LEADING)),
        "n_symbols": total(_class_counts(words, SYMBOLS)),
        "n_dup_lines": np.array([repeated_lines(t) for t in texts], np.int64),
        "n_repeat_words": repeated_words(words),
    }


# ---- the two multinomials --------------------------------------------------------------


def buckets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word and every pair of neighbours."""
    text = words.text_of()
    pairs = np.flatnonzero(text[1:] == text[:-1])
    both = rolling(words.hashes, 2)[pairs] if len(pairs) else np.empty(0, U64)
    bucket = np.concatenate([words.hashes, both]) % U64(BUCKETS)
    return np.concatenate([text, text[pairs]]), bucket.astype(np.int64)


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, BUCKETS), np.int64)
    for part in slices(batches):
        words = find_words(texts_of(part), SPACED)
        text, bucket = buckets(words)
        counts[0] += np.bincount(bucket, minlength=BUCKETS)
        trusted = part.column("trusted").to_numpy(zero_copy_only=False)
        counts[1] += np.bincount(bucket[trusted[text]], minlength=BUCKETS)
    yield parts(counts, PART)


def log_ratios(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """log(trusted share / corpus share) of each bucket. ``trusted`` has distinct ids, any number of them."""
    # Both sides grow with the input: sorted and merged at every size, never broadcast.
    good = trusted.select("doc_id", F.lit(True).alias("trusted")).hint("merge")
    flagged = docs.select("doc_id", "text").join(good, "doc_id", "left")
    rows = flagged.select("text", F.coalesce("trusted", F.lit(False)).alias("trusted")).mapInArrow(_bucket_counts, SCHEMA)
    counts = add_up(rows, (2, BUCKETS), PART).astype(np.float64)
    if not counts[1].any():
        return np.zeros(BUCKETS)
    corpus = (counts[0] + 1) / (counts[0] + 1).sum()
    target = (1 - MIXED_IN) * counts[1] / counts[1].sum() + MIXED_IN * corpus
    return np.log(target / corpus)


def trusted_documents(labels: DataFrame) -> DataFrame:
    """Ids of all documents labelled as good, each once."""
    return labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


# ---- judging ---------------------------------------------------------------------------


def _judge(batches: Iterator[pa.RecordBatch], ratios: np.ndarray, threshold: float, names: list[str]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        texts = texts_of(part)
        words = find_words(texts, SPACED)
        out = base_counts(texts, words)
        text, bucket = buckets(words)
        n = np.bincount(text, minlength=len(texts))
        score = np.bincount(text, ratios[bucket], len(texts)) / np.maximum(n, 1)
        out["score"] = score
        out["base_failed"] = (out["n_words"] < LEAST_WORDS) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
        out["kept"] = ~out["base_failed"] & (score >= threshold)
        columns = {n: part.column(n) for n in names}
        yield pa.RecordBatch.from_pydict(columns | {k: pa.array(v) for k, v in out.items()})


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the counts, score, base_failed and kept of every document.

    Defined results: a null text has no words, as an empty one, and fails the base rules; without
    trusted documents every score is 0; ids that occur twice are trusted or not together; extra
    columns are ignored.
    """
    ratios = log_ratios(docs, trusted_documents(labels))
    schema = (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "score double, base_failed boolean, kept boolean"
    )
    return docs.select("doc_id", "text").mapInArrow(lambda it: _judge(it, ratios, threshold, ["doc_id"]), schema)
