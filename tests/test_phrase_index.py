"""Indexed phrase search against a scan."""

import pytest

from ledgerline.operators import phrase_index as P

TEXTS = [
    "The Ferry left the harbour.", "the ferry", "THE FERRY LEFT", "", None, "ab", "abc", "aaa aaa", "Ünïcode naïve 你好世界", "😂😂😂 x",
    "a_b%c\\d", "line\nbreak", "ferry left" * 300, "İstanbul ﬁne",
]
PHRASES = [
    "the ferry", "FERRY LEFT", "ferry left the harbour.", "a", "ab", "abc", "aaaa", "aaa", "naïve 你好", "😂😂😂", "_b%", "e\nb", "not there", "xyz", "left" + "ferry left" * 9,
    "", "ﬁn", "c\\d", "i̇st",
]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    docs = spark.createDataFrame([(f"d{k}", t) for k, t in enumerate(TEXTS)], "id string, text string").cache()
    return docs, P.build(docs, "id", "text", f"{tmp_path_factory.mktemp('index')}/i", buckets=8)


def test_equals_the_scan(indexed):
    docs, index = indexed
    for phrase in PHRASES:
        want = sorted(r.id for r in docs.filter(P.contains_ci("text", phrase)).collect())
        assert sorted(r.id for r in index.matches(docs, "id", "text", phrase).collect()) == want, phrase
    some = docs.filter("id <> 'd1'")
    assert sorted(r.id for r in index.matches(some, "id", "text", "the ferry").collect()) == ["d0", "d2"]


def test_reads_only_the_lists_of_the_phrase(indexed):
    docs, index = indexed
    plan = index.matches(docs, "id", "text", "harbour")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "PushedFilters: [In(run" in plan


def test_no_texts(spark, tmp_path):
    docs = spark.createDataFrame([], "id string, text string")
    index = P.build(docs, "id", "text", f"{tmp_path}/i")
    assert index.matches(docs, "id", "text", "abc").count() == 0 and index.matches(docs, "id", "text", "a").count() == 0


def test_runs_found_in_bulk_are_those_of_each_text(spark, indexed, monkeypatch):
    """The index holds the runs that ``runs`` gives, however a batch is cut."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    docs, index = indexed
    want = sorted((r.id, r.run) for r in docs.select("id", F.explode(P.runs(F.col("text"))).alias("run")).collect())
    assert sorted((r.id, r.run) for r in index.lists.select("id", "run").collect()) == want
    lower = [(r.id, r.text) for r in docs.select("id", F.lower("text").alias("text")).collect()]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in lower]), pa.array([t for _, t in lower], pa.string())], names=["id", "text"])
    monkeypatch.setattr(P, "CHARS", 5)
    assert sorted((r["id"], r["run"]) for b in P._listed([batch]) for r in b.to_pylist()) == want
