"""Verdicts on page addresses: rules on hosts and paths, and logistic regression for the rest.

The regression sees hashed character n-grams of the host and of the path, each under its own
hash, and is trained from a small table of labelled addresses.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.words import BYTE_CODES, U64, mix, rolling

BUCKETS = 1 << 14
GRAMS = (3, 4, 5)

# The rules: allow or block, and a host with the beginning of a path.
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]

# Names of labelled hosts, unwanted and harmless; none is one of the given tables.
UNWANTED = """
discount-pills pills-express pills-online cheap-meds cheap-viagra cheap-loans royal-casino casino-jackpot online-casino casino-slots
win-cash win-prizes win-jackpot spam-links spam-mailer spam-clicks link-farm content-farm click-farm live-bets bets-today sports-bets
free-spins free-cash free-viagra ads-server banner-ads pop-ads track-clicks track-users click-track adult-chat adult-cams adult-singles
xxx-tube xxx-cams hot-singles hot-cams poker-bonus poker-jackpot casino-bonus payday-loans quick-loans payday-cash replica-watches
cheap-replica crack-keygen keygen-serials torrent-warez warez-cracks
""".split()
HARMLESS = """
theatre weather nation station northstar otherness mathematics earthscience thirteenth heritage theory thermalbaths
education traditions stationery rations nationalpark therapy anthem authors brothers citylibrary museum university
newsroom gardens recipes historybooks archive physics timetable hospital villageschool choir riverwalk bakery carpenter
astronomy opendata lawreview poetry cycling chessclub orchard translation readingroom harbour wintersports library
city-museum public-library weather-maps earth-science law-school village-choir
""".split()
ENDINGS = ("example.net", "example.com")
PLACES = ("en/101", "fr/2300", "es/47.html", "de/805/", "en/9?page=2")


def addresses(names: list[str]) -> list[str]:
    """An address for each name; endings and paths go round, so that neither says anything of the label."""
    return [f"https://{n}.{ENDINGS[i % 2]}/{PLACES[i % 5]}" for i, n in enumerate(names)]


LABELLED = [*[(u, 1) for u in addresses(UNWANTED)], *[(u, 0) for u in addresses(HARMLESS)]]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as (rule, verdict); nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # The last one set wins: rules in order of their length.
    for decision, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


# ---- logistic regression ---------------------------------------------------------------


def grams(texts: list[bytes], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the n-grams of each text between two marks."""
    marked = [b"\x02" + t + b"\x03" for t in texts]
    codes = BYTE_CODES[np.frombuffer(b"".join(marked), np.uint8)]
    sizes = np.array([len(t) for t in marked])
    owner = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(owner))
    out = []
    for n in GRAMS:
        fits = np.flatnonzero(left >= n)
        if len(fits):
            bucket = mix(rolling(codes, n)[fits] + U64(8 * salt + n)) % U64(BUCKETS)
            out.append((owner[fits], bucket.astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 2


@dataclass
class Model:
    weights: np.ndarray
    offset: float

    def logits(self, hosts: list[bytes], paths: list[bytes]) -> np.ndarray:
        z = np.full(len(hosts), self.offset)
        for salt, texts in enumerate((hosts, paths)):
            text, bucket = grams(texts, salt)
            n = np.bincount(text, minlength=len(texts))
            z += np.bincount(text, self.weights[bucket], len(texts)) / np.sqrt(np.maximum(n, 1))
        return z


def split_url(url: str) -> tuple[bytes, bytes]:
    rest = url.partition("://")[2].split("#")[0].split("?")[0]
    host, slash, path = rest.partition("/")
    return host.lower().encode(), (slash + path).encode()


def train(labelled: list[tuple[str, int]], rounds: int = 400, rate: float = 0.5, ridge: float = 1e-4) -> Model:
    """Logistic regression by gradient descent on a table of (address, label) that fits on the driver."""
    model = Model(np.zeros(BUCKETS), 0.0)
    split = [split_url(u) for u, _ in labelled]
    hosts, paths = [h for h, _ in split], [p for _, p in split]
    y = np.array([label for _, label in labelled], float)
    inputs = []
    for salt, texts in enumerate((hosts, paths)):
        text, bucket = grams(texts, salt)
        inputs.append((text, bucket, 1 / np.sqrt(np.maximum(np.bincount(text, minlength=len(texts)), 1))))
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-model.logits(hosts, paths))) - y
        slope = ridge * model.weights
        for text, bucket, scale in inputs:
            slope = slope + np.bincount(bucket, (error * scale)[text], BUCKETS)
        model.weights -= rate * slope
        model.offset -= rate * error.mean()
    return model


def _scores(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, paths = (batch.column(c).cast(pa.binary()).to_pylist() for c in ("host", "path"))
        columns = {n: batch.column(n) for n in ("page_id", "host", "path", "rule", "decided")}
        score = 1 / (1 + np.exp(-np.clip(model.logits(hosts, paths), -30, 30)))
        yield pa.RecordBatch.from_pydict(columns | {"score": pa.array(score, pa.float64())})


def judged(pages: DataFrame, rules: list[tuple[str, str]] = RULES, labelled: list[tuple[str, int]] = LABELLED, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and score (probability of an unwanted page) of every page.

    The rule that fits decides; without one, pages with a score of ``threshold`` or more are blocked.
    Defined results: a null address, and one without ``://``, has an empty host and path, which no
    rule fits; repeated rows get equal verdicts; extra columns are ignored.
    """
    model = train(labelled)
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    ruled = parts.withColumns({"rule": rule, "decided": verdict})
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ruled.schema.fields)
    scored = ruled.mapInArrow(lambda it: _scores(it, model), f"{schema}, score double")
    method = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("decided", method).alias("verdict"), "score")
