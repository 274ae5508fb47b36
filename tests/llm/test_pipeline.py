"""The pipeline, replayed stage by stage by brute force."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as cp
from shelfcast.llm import quality
from shelfcast.session import settle
from tests.llm.samples import documents, odd_rows, prose
from tests.llm.test_mixture import shared_out
from tests.llm.test_near_dedup import classes
from tests.llm.test_repeats import covered_by_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, root):
    """The rows after each stage, the input first."""
    docs = spark.read.parquet(f"{root}/documents.parquet")
    out = [docs.collect()]
    for _, stage in cp.STAGES:
        docs = settle(stage(spark, docs, root))
        out.append(docs.collect())
    return out


def test_names_and_registration(spark):
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "near_dedup", "substring_dedup", "decontamination", "source_mixing"]
    assert entry.queries()["pipeline"] is cp.run and cp.ORACLE_SQL is None


def test_columns(stages):
    for rows in stages[1:5]:
        assert rows[0].__fields__ == COLUMNS
    assert stages[5][0].__fields__ == [*COLUMNS, "copies"]


def test_rejected_documents_go(spark, root, stages):
    docs = spark.read.parquet(f"{root}/documents.parquet")
    scores = {r.doc_id: r.score for r in quality.score(docs, spark.read.parquet(f"{root}/labels.parquet"), ["doc_id"]).collect()}
    assert sorted(stages[1]) == sorted(r for r in stages[0] if scores[r.doc_id] >= 0.3)


def test_one_document_of_each_group_stays(stages):
    first = {c for _, c, _ in classes([(r.doc_id, r.text) for r in stages[1]])}
    assert sorted(stages[2]) == sorted(r for r in stages[1] if r.doc_id in first)


def test_repeated_passages_go(stages):
    words = [r.text.encode().split() for r in stages[2]]
    expected = {}
    for r, own, mask in zip(stages[2], words, covered_by_repeats(words, 35)):
        expected[r.doc_id] = (r, [w.decode() for w, m in zip(own, mask) if not m], any(mask))
    assert len(stages[3]) == len(stages[2])
    for r in stages[3]:
        before, kept, cut = expected[r.doc_id]
        assert r.text.split() == kept and r.n_chars == len(r.text)
        assert cut or r.text == before.text


def test_contaminated_documents_go(spark, root, stages):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    windows = set()
    for r in spark.read.parquet(f"{root}/benchmark.parquet").collect():
        own = words(r.text)
        windows |= {tuple(own[i : i + 13]) for i in range(max(len(own) - 12, 1))}
    kept = []
    for r in stages[3]:
        own, hit = words(r.text), set()
        for n in {len(w) for w in windows if w}:
            for i in range(len(own) - n + 1):
                if tuple(own[i : i + n]) in windows:
                    hit.update(range(i, i + n))
        if not hit or 20 * len(hit) < len(own):
            kept.append(r)
    assert sorted(stages[4]) == sorted(kept) and len(kept) < len(stages[3])


def test_sources_meet_their_targets(stages):
    before = {r.doc_id: r for r in stages[4]}
    sizes = Counter()
    for r in stages[4]:
        sizes[r.source] += len(r.text.split())
    taken = Counter()
    for r in stages[5]:
        assert before[r.doc_id] == r[:5] and 1 <= r.copies <= 3
        taken[r.source] += r.copies * len(r.text.split())
    for source, target in shared_out(dict(sizes)).items():
        assert abs(taken[source] - target) <= max(len(r.text.split()) for r in stages[4] if r.source == source)


def test_run_gives_the_last_stage(spark, root, stages):
    assert sorted(cp.run(spark, root).collect()) == sorted(stages[5])


def test_stages_take_odd_rows_and_other_columns(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, columns with the operators' own names, no rows."""
    rng = random.Random(3)
    rows = odd_rows(rng) + [(100 + i, prose(rng, 60), f"s{i % 3}") for i in range(30)] + [(200, None, None)]
    spark.createDataFrame([(100 + i, 1) for i in range(30)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "w1 w2 w3"), (None, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (documents(spark, rows), documents(spark, [])):
        docs = settle(docs.withColumns({n: F.lit("y") for n in ("_key", "doc", "score", "r1", "_size", "copies")}))
        columns = docs.columns
        for name, stage in cp.STAGES:
            after = settle(stage(spark, docs, str(tmp_path)))
            assert sorted(after.columns) == sorted(columns), name
            extra = [n for n in columns if n not in ("text", "n_chars", "copies", "doc_id", "lang", "source")]
            assert after.select(*extra).distinct().count() <= 1, name
            docs = after
