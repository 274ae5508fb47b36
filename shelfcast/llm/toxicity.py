"""Toxicity of documents: a bidirectional gated recurrent network over overlapping windows.

A word enters the network as the vector of its hash, the mean vector of its character n-grams
(bytes of UTF-8, with marks at both ends) and that of its beginnings. A gated recurrent network reads each window of words
forwards and another backwards; attention pools their states; a logistic unit gives the window's
logit. A document has the highest logit of its windows, which overlap and cover it whole, made a
probability by a line. The line is fitted to a fifth of the sample, scored by a network that was
trained on the other four; the network that scores documents is then trained on all of it.

Labels are given for documents, not windows. So the odds of words and n-grams between toxic and
other documents are counted first; they start the first entry of each vector, and they choose the
windows to train on: the most suspicious one of a toxic document, and of others the two most
suspicious and one by chance. All is trained in NumPy on that bounded sample, by backpropagation.
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
from shelfcast.llm.quality import hash_of, sigmoid
from shelfcast.llm.totals import SCHEMA, add_up, parts
from shelfcast.llm.words import BYTE_CODES, FOLDED, U64, Words, find_words, rolling, slices, texts_of
from shelfcast.session import settle

# Half a window: a passage of up to WINDOW - STRIDE + 1 words is whole in some window.
WINDOW, STRIDE = 32, 16
# What a word is made of, and the rows of each table of vectors.
PARTS = ("word", "char", "stem")
ROWS = 1 << 15
GRAMS = (3, 4, 5)
STEMS = (3, 5, 6, 7, 8, 9)  # lengths of beginnings, with the mark
PART = 4  # entries of a vector
WITHOUT_WORD = 0.3
#: One in so many documents of the sample is kept for the calibration.
CALIBRATION = 5
STATE = 8
GLANCE = 8
#: Labelled documents of each label that the network is trained on, at most.
PER_LABEL = 4000
SLICE = 2 << 20
SAMPLE_FILES = 8
# Counts of all rows and of the documents, in parts.
PART_COUNTS = 1 << 12
TABLE = len(PARTS) * ROWS + PART_COUNTS


# ---- inputs ----------------------------------------------------------------------------


@dataclass
class Vocabulary:
    """The distinct words of some texts, and which one each word is.

    ``rows`` has the rows of all distinct words in the table of each part, one word after the other,
    ``first`` where those of each word begin (and the end of all).
    """

    rows: dict[str, np.ndarray]
    first: dict[str, np.ndarray]
    token: np.ndarray

    def __len__(self) -> int:
        return len(self.rows["word"])


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20


def vocabulary(words: Words) -> Vocabulary:
    hashes, first, token = np.unique(words.hashes, return_index=True, return_inverse=True)
    starts, size = words.starts[first], words.ends[first] - words.starts[first]
    # Each word between two marks (0x02 and 0x03) in one buffer.
    begin = np.cumsum(size + 2) - (size + 2)
    buffer = np.full(int((size + 2).sum()), 2, np.uint8)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    buffer[np.repeat(begin + 1, size) + inside] = _FOLD[words.data[np.repeat(starts, size) + inside]]
    buffer[begin + size + 1] = 3
    codes = BYTE_CODES[buffer]
    owner = np.repeat(np.arange(len(size)), size + 2)
    left = np.repeat(begin + size + 2, size + 2) - np.arange(len(buffer))
    rows, firsts = {"word": (hashes % U64(ROWS)).astype(np.int64)}, {"word": np.arange(len(size) + 1)}
    for part, lengths in (("char", GRAMS), ("stem", STEMS)):
        owners, found = [], []
        for n in lengths:
            # The marks make every word three bytes long at least.
            fits = np.flatnonzero(left >= n) if part == "char" else begin[size + 2 >= n]
            owners.append(owner[fits])
            found.append((rolling(codes, n)[fits] ^ U64(n)) % U64(ROWS))
        owners, found = np.concatenate(owners), np.concatenate(found).astype(np.int64)
        order = np.argsort(owners, kind="stable")
        rows[part], firsts[part] = found[order], np.searchsorted(owners[order], np.arange(len(size) + 1))
    return Vocabulary(rows, firsts, token.astype(np.int64))


def window_table(words: Words, pad: int, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, tokens) of all windows: WINDOW words each, every STRIDE words, padded at the end."""
    counts = words.counts
    n = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE)), 0)
    text = np.repeat(np.arange(len(counts)), n)
    start = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    place = start[:, None] + np.arange(WINDOW)
    inside = place < counts[text][:, None]
    at = words.first[text][:, None] + np.where(inside, place, 0)
    return text, np.where(inside, token[at], pad) if len(text) else np.zeros((0, WINDOW), np.int64)


def means(table: np.ndarray, v: Vocabulary, part: str) -> np.ndarray:
    """The mean vector of each distinct word's rows in the table of a part (it has one at least)."""
    sizes = np.diff(v.first[part])
    return np.add.reduceat(table[v.rows[part]], v.first[part][:-1], axis=0) / sizes.reshape(-1, *[1] * (table.ndim - 1))


# ---- the network -----------------------------------------------------------------------


class Network:
    """Parameters by name, and the passes through the network."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p

    @classmethod
    def fresh(cls, odds: np.ndarray, seed: int = 11) -> Network:
        """Before training: the odds of each part's rows, one part after the other, and noise."""
        rng = np.random.default_rng(seed)
        near = lambda *shape: (rng.normal(0, shape[0] ** -0.5, shape)).astype(np.float32)
        p = {part: 0.05 * rng.normal(size=(ROWS, PART)).astype(np.float32) for part in PARTS}
        for k, part in enumerate(PARTS):
            p[part][:, 0] = odds[k * ROWS : (k + 1) * ROWS]
        for way in ("f", "b"):
            p |= {f"w{way}": near(len(PARTS) * PART, 3 * STATE), f"u{way}": near(STATE, 3 * STATE), f"d{way}": np.zeros(3 * STATE, np.float32)}
        p |= {"wa": near(2 * STATE, GLANCE), "da": np.zeros(GLANCE, np.float32), "va": near(GLANCE, 1)[:, 0]}
        p |= {"wo": near(2 * STATE, 1)[:, 0], "do": np.zeros(1, np.float32), "calibration": np.array([1.0, 0.0])}
        return cls(p)

    def calibrated(self, z: np.ndarray) -> np.ndarray:
        """Probabilities of documents from their highest logits."""
        slope, offset = self.p["calibration"]
        return sigmoid(slope * z + offset)

    def inputs(self, v: Vocabulary) -> np.ndarray:
        """The input vector of each distinct word."""
        return np.concatenate([means(self.p[part], v, part) for part in PARTS], axis=1)

    def _read(self, projected: np.ndarray, tokens: np.ndarray, way: str, trace: list | None) -> np.ndarray:
        """States (step, window, entry) of one direction. ``projected`` has a row for each distinct word."""
        u, pad = self.p[f"u{way}"], len(projected) - 1
        state = np.zeros((tokens.shape[0], STATE), np.float32)
        out = np.empty((WINDOW, *state.shape), np.float32)
        for t in range(WINDOW) if way == "f" else range(WINDOW - 1, -1, -1):
            x, h = projected[tokens[:, t]], state @ u
            gates = 0.5 + 0.5 * np.tanh(0.5 * (x[:, : 2 * STATE] + h[:, : 2 * STATE]))
            keep, reset = gates[:, :STATE], gates[:, STATE:]
            new = np.tanh(x[:, 2 * STATE :] + reset * h[:, 2 * STATE :])
            there = (tokens[:, t] != pad)[:, None]
            if trace is not None:
                trace.append((t, state, keep, reset, new, h[:, 2 * STATE :], there))
            state = np.where(there, new + keep * (state - new), state)
            out[t] = state
        return out

    def forward(self, x: np.ndarray, tokens: np.ndarray, traces: dict | None = None) -> np.ndarray:
        """The logit of each window. ``x`` has the inputs of the distinct words; its end is the padding."""
        p = self.p
        padded = np.vstack([x, np.zeros((1, x.shape[1]), np.float32)])
        states = []
        for way in ("f", "b"):
            trace = [] if traces is not None else None
            states.append(self._read(padded @ p[f"w{way}"] + p[f"d{way}"], tokens, way, trace))
            if traces is not None:
                traces[way] = trace
        states = np.concatenate(states, axis=2)
        glance = np.tanh(states @ p["wa"] + p["da"])
        force = np.where((tokens != len(x)).T, glance @ p["va"], np.float32(-1e9))
        force = np.exp(force - force.max(axis=0))
        attention = force / force.sum(axis=0)
        pooled = np.einsum("tb,tbs->bs", attention, states)
        if traces is not None:
            traces |= {"states": states, "glance": glance, "attention": attention, "pooled": pooled, "padded": padded}
        return pooled @ p["wo"] + p["do"][0]

    def backward(self, tokens: np.ndarray, error: np.ndarray, t: dict) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters, and of the inputs of the distinct words."""
        p, g = self.p, {}
        g["wo"], g["do"] = t["pooled"].T @ error, error.sum(keepdims=True)
        pooled = np.outer(error, p["wo"])
        states = t["attention"][:, :, None] * pooled
        pull = np.einsum("bs,tbs->tb", pooled, t["states"])
        force = t["attention"] * (pull - (t["attention"] * pull).sum(axis=0))
        g["va"] = np.einsum("tb,tbk->k", force, t["glance"])
        glance = force[:, :, None] * p["va"] * (1 - t["glance"] ** 2)
        g["wa"], g["da"] = np.einsum("tbs,tbk->sk", t["states"], glance), glance.sum(axis=(0, 1))
        states = states + glance @ p["wa"].T
        inputs = np.zeros_like(t["padded"])
        for k, way in enumerate(("f", "b")):
            u = p[f"u{way}"]
            gu, gx = np.zeros_like(u), np.zeros((len(inputs), 3 * STATE), np.float32)
            carry = np.zeros((tokens.shape[0], STATE), np.float32)
            for step, before, keep, reset, new, hidden, there in reversed(t[way]):
                total = carry + states[step][:, k * STATE : (k + 1) * STATE]
                own = np.where(there, total, 0)
                d_new = own * (1 - keep) * (1 - new**2)
                d_keep = own * (before - new) * keep * (1 - keep)
                d_reset = d_new * hidden * reset * (1 - reset)
                d_hidden = np.concatenate([d_keep, d_reset, d_new * reset], axis=1)
                gu += before.T @ d_hidden
                np.add.at(gx, tokens[:, step], np.concatenate([d_keep, d_reset, d_new], axis=1))
                carry = np.where(there, own * keep, total) + d_hidden @ u.T
            g[f"u{way}"], g[f"w{way}"], g[f"d{way}"] = gu, t["padded"].T @ gx, gx.sum(axis=0)
            inputs += gx @ p[f"w{way}"].T
        return g, inputs[:-1]


def _embedding_gradients(v: Vocabulary, inputs: np.ndarray) -> dict:
    out = {part: np.zeros((ROWS, PART), np.float32) for part in PARTS}
    for k, part in enumerate(PARTS):
        sizes = np.diff(v.first[part])
        share = np.repeat(inputs[:, k * PART : (k + 1) * PART] / sizes[:, None], sizes, axis=0)
        for e in range(PART):
            out[part][:, e] = np.bincount(v.rows[part], share[:, e], ROWS)
    return out


def train(
    network: Network, texts: list[bytes], y: np.ndarray, weight: np.ndarray, seed: int = 5, epochs: int = 6, batch: int = 128, least_steps: int = 150
) -> Network:
    """Fit by Adam; every text is one window. A small table is gone through more often.

    In each step some words lack the vector of their hash, so that what they are made of has to tell.
    """
    epochs = max(epochs, -(-least_steps // -(-len(texts) // batch)))
    rng = np.random.default_rng(seed)
    weight = weight / weight.mean()
    p = network.p
    m, s = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            i = order[at : at + batch]
            words = find_words([texts[k] for k in i], FOLDED)
            v = vocabulary(words)
            _, tokens = window_table(words, len(v), v.token)
            traces: dict = {}
            x = network.inputs(v)
            there = np.ones_like(x)
            there[:, :PART] = rng.random((len(x), 1)) >= WITHOUT_WORD
            z = network.forward(x * there, tokens, traces)
            error = (weight[i] * (sigmoid(z) - y[i]) / len(i)).astype(np.float32)
            g, inputs = network.backward(tokens, error, traces)
            g |= _embedding_gradients(v, inputs * there)
            step += 1
            for k, a in g.items():
                m[k] = 0.9 * m[k] + 0.1 * a
                s[k] = 0.999 * s[k] + 0.001 * a * a
                p[k] -= (0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return network


# ---- what to train on ------------------------------------------------------------------


def _odds_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents of each label each row of the tables occurs."""
    counts = np.zeros((2, TABLE), np.int64)
    for part in slices(batches, limit=SLICE):
        for text, label in zip(texts_of(part), part.column("label").to_pylist()):
            words = find_words([text], FOLDED)
            if len(words.hashes):
                v = vocabulary(words)
                for k, part in enumerate(PARTS):
                    counts[label, k * ROWS + np.unique(v.rows[part])] += 1
            counts[label, len(PARTS) * ROWS] += 1
    yield parts(counts, PART_COUNTS)


def _log_odds(counts: np.ndarray) -> np.ndarray:
    counts = counts[:, : len(PARTS) * ROWS + 1]
    toxic, other = counts[1] + 0.5, counts[0] + 0.5
    odds = np.log(toxic[:-1] / (counts[1, -1] + 1)) - np.log(other[:-1] / (counts[0, -1] + 1))
    # Rows seen in few documents say little.
    return (odds * (1 - np.exp(-(counts[0] + counts[1])[:-1] / 8)) / 4).astype(np.float32)


def _suspicion(v: Vocabulary, odds: np.ndarray) -> np.ndarray:
    return sum(np.maximum(means(odds[k * ROWS : (k + 1) * ROWS], v, part), 0) for k, part in enumerate(PARTS))


def _window_rows(batches: Iterator[pa.RecordBatch], odds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The windows to train on, as text."""
    for part in slices(batches, limit=SLICE):
        words = find_words(texts_of(part), FOLDED)
        out: dict = {"doc_id": [], "label": [], "weight": [], "text": []}
        if len(words.hashes):
            v = vocabulary(words)
            text, tokens = window_table(words, len(v), v.token)
            worst = np.append(_suspicion(v, odds), -1)[tokens]
            rank = worst.max(axis=1) + 0.01 * np.maximum(worst, 0).sum(axis=1)
            first = np.searchsorted(text, np.arange(part.num_rows + 1))
            ids, labels, weights = (part.column(c).to_pylist() for c in ("doc_id", "label", "weight"))
            for d in range(part.num_rows):
                a, b = int(first[d]), int(first[d + 1])
                if a == b:
                    continue
                by_rank = (a + np.argsort(-rank[a:b], kind="stable")).tolist()
                chosen = by_rank[:1] if labels[d] else dict.fromkeys([*by_rank[:2], a + hash_of(ids[d]) % (b - a)])
                for w in chosen:
                    lo = int(words.first[d]) + (w - a) * STRIDE
                    hi = min(lo + WINDOW, int(words.first[d + 1])) - 1
                    out["doc_id"].append(ids[d])
                    out["label"].append(labels[d])
                    out["weight"].append(weights[d])
                    out["text"].append(words.data[words.starts[lo] : words.ends[hi]].tobytes())
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array(out["doc_id"], pa.int64()),
                "label": pa.array(out["label"], pa.int32()),
                "weight": pa.array(out["weight"], pa.float64()),
                "text": pa.array(out["text"], pa.binary()),
            }
        )


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_label: int = PER_LABEL) -> Network:
    """The network trained on windows of at most ``per_label`` documents of each label.

    Documents with the same id count once. Without labelled documents every score is one half.
    """
    sample = training_sample(labels, label, per_label)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")
    rows = texts.groupBy("doc_id").agg(F.min("text").alias("text")).join(sample, "doc_id").select("doc_id", "text", "label", "weight")
    # At most 2 * per_label rows, read a few times.
    rows = settle(rows.repartition(SAMPLE_FILES).withColumn("kept_out", F.pmod(F.xxhash64(F.lit("line"), "doc_id"), F.lit(CALIBRATION)) == 0))
    draft = _trained(rows.where(~F.col("kept_out")))
    network = _trained(rows)
    scored = rows.where("kept_out").mapInArrow(lambda it: _logit_rows(it, draft), "doc_id long, label int, weight double, logit double").collect()
    scored = sorted((r for r in scored if np.isfinite(r["logit"])), key=lambda r: hash_of(r["doc_id"]))
    if scored and np.any(draft.p["wo"]):
        z, y, weight = (np.array([float(r[c]) for r in scored]) for c in ("logit", "label", "weight"))
        network.p["calibration"] = fit_line(z, y, weight)
    return network


def _trained(rows: DataFrame) -> Network:
    """The network trained on the most telling windows of (doc_id, text, label, weight)."""
    counts = add_up(rows.select("text", "label").mapInArrow(_odds_rows, SCHEMA), (2, TABLE), PART_COUNTS)
    odds = _log_odds(counts)
    network = Network.fresh(odds)
    found = rows.mapInArrow(lambda it: _window_rows(it, odds), "doc_id long, label int, weight double, text binary").collect()
    found = sorted(found, key=lambda r: (hash_of(r["doc_id"]), bytes(r["text"])))
    if not found:
        network.p["wo"][:] = 0
        return network
    y = np.array([r["label"] for r in found], np.float32)
    # Both labels weigh the same in training: the windows were chosen, not drawn.
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    return train(network, [bytes(r["text"]) for r in found], y, weight)


def fit_line(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Slope and offset of the logits with the smallest log loss, by Newton's method.

    The goal of a label is (n + 1) / (n + 2) rather than 1, with n rows of it, which keeps the
    slope finite where the labels are fully separated.
    """
    ones, zeros = y.sum(), (1 - y).sum()
    goal = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.stack([z, np.ones_like(z)], axis=1)
    line = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(x @ line)
        slope = x.T @ (weight * (p - goal))
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        line = line - np.clip(np.linalg.solve(bend, slope), -1, 1)
    return np.array([max(line[0], 1e-3), line[1]])


# ---- scoring ---------------------------------------------------------------------------


def text_logits(texts: list[bytes | None], network: Network) -> np.ndarray:
    """The highest logit of any window of each text; minus infinity without words."""
    words = find_words(texts, FOLDED)
    out = np.full(len(texts), -np.inf)
    if len(words.hashes):
        v = vocabulary(words)
        text, tokens = window_table(words, len(v), v.token)
        x = network.inputs(v)
        for at in range(0, len(tokens), 8192):
            np.maximum.at(out, text[at : at + 8192], network.forward(x, tokens[at : at + 8192]))
    return out


def text_scores(texts: list[bytes | None], network: Network) -> np.ndarray:
    if not np.any(network.p["wo"]):
        return np.full(len(texts), 0.5)
    z = text_logits(texts, network)
    return np.where(np.isfinite(z), network.calibrated(np.where(np.isfinite(z), z, 0)), 0.0)


def _logit_rows(batches: Iterator[pa.RecordBatch], network: Network) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, limit=SLICE):
        columns = {n: part.column(n) for n in ("doc_id", "label", "weight")}
        yield pa.RecordBatch.from_pydict(columns | {"logit": pa.array(text_logits(texts_of(part), network), pa.float64())})


def _score_rows(batches: Iterator[pa.RecordBatch], network: Network, names: list[str]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, limit=SLICE):
        columns = {n: part.column(n) for n in names}
        yield pa.RecordBatch.from_pydict(columns | {"score": pa.array(text_scores(texts_of(part), network), pa.float64())})


def score(docs: DataFrame, labels: DataFrame, columns: list[str], label: str = "toxic") -> DataFrame:
    """``columns`` of every document and ``score``, the probability that it is toxic. A column of
    that name cannot be among them; put it into a struct.

    Only text goes into a score. Defined results: a null text, an empty one and one without words
    score 0; repeated rows get equal scores; other columns are ignored.
    """
    network = fit(docs, labels, label)
    chosen = docs.select(*dict.fromkeys([*columns, "text"]))
    schema = StructType([*chosen.select(*columns).schema.fields, StructField("score", DoubleType())])
    return chosen.mapInArrow(lambda it: _score_rows(it, network, columns), schema)


def judged(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score(docs, labels, ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
