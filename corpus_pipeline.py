"""Five stages from raw documents to a training mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as
the next one's ``docs``. All but the last return the columns of documents; the last adds ``copies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm import dart_minhash, decontaminate, mixture, quality, suffix_tree
from shelfcast.llm.tables import table
from shelfcast.session import settle

LEAST_QUALITY = 0.3


def whole(docs: DataFrame) -> Column:
    """All columns of a document as one, out of the way of the operators' own names."""
    return F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("doc")


def all_but_text(docs: DataFrame) -> Column:
    """The same without the text, for operators that return it: it moves once."""
    return F.struct(*[F.col(f"`{n}`") for n in docs.columns if n != "text"]).alias("doc")


def unpacked(docs: DataFrame, changed: dict[str, Column]) -> list[Column]:
    """The columns of ``docs`` again, from ``doc`` where they are not among the changed ones."""
    return [changed.get(n, F.col(f"doc.`{n}`")).alias(n) for n in docs.columns]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    chosen = docs.select("doc_id", "text", all_but_text(docs))
    scored = quality.score(chosen, table(spark, sf_dir, "labels"), ["doc", "text"])
    return scored.where(F.col("score") >= LEAST_QUALITY).select(unpacked(docs, {"text": F.col("text")}))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id."""
    return dart_minhash.drop_near_duplicates(docs)


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 35 words or more that occur elsewhere."""
    kept = suffix_tree.drop_repeats(docs.select("text", all_but_text(docs)), ["doc", "text"])
    return kept.select(unpacked(docs, {"text": F.col("text"), "n_chars": F.length("text").cast("long")}))


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by a benchmark item."""
    key = F.xxhash64("doc_id", "text")
    found = decontaminate.contamination(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    bad = found.where("contaminated").select(F.col("doc_id").alias("_key")).distinct()
    return docs.select(key.alias("_key"), whole(docs)).join(bad, "_key", "left_anti").select("doc.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix of sources takes, with ``copies``: how often it takes each."""
    return mixture.mixed_documents(docs)


STAGES = [
    ("quality_classifier", good_documents),
    ("near_dedup", one_of_each),
    ("substring_dedup", without_passages),
    ("decontamination", clean_of_benchmarks),
    ("source_mixing", mixed),
]

# The first stage is a trained model: SQL cannot express it. Tests replay every stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
