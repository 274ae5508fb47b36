"""Labelled rows for training, and the fold that is kept out of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo the number of folds; null without an id."""
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def training_sample(labels: DataFrame, label: str, per_label: int) -> DataFrame:
    """(doc_id, label, weight): at most ``per_label`` rows of each label outside the held-out fold,
    taken by a hash of the id, weighted to stand for all of them.

    Rows without an id or a label of 0 or 1 are left out. A document labelled twice the same counts
    once; labelled both ways, it counts as 0.
    """
    usable = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold() != 0))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
    )
    counts = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    parts = []
    for value in (0, 1):
        n = counts.get(value, 0)
        weight = n / min(n, per_label) if n else 0.0
        one = usable.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        parts.append(one.withColumn("weight", F.lit(weight)))
    return parts[0].union(parts[1])
