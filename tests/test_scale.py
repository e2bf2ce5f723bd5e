"""Steps whose cost must grow no faster than their input: what they move."""

from pyspark.sql import functions as F

from ledgerline.plans import serving
from ledgerline.schema import BASE_FIELDS, GRAINS
from ledgerline.sources import testdata


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_both_releases_come_from_one_pass(spark):
    from __spark_entry__ import SMOKE_DIR

    shown = plan(testdata.incoming(spark, SMOKE_DIR))
    assert shown.count("lineitem.parquet") == 1 and shown.count("orders.parquet") == 1


def test_grains_are_shuffled_once_and_not_repeated_before(spark):
    extras = [c for name in GRAINS for c in GRAINS[name]]
    rows = [(f"2020-01-0{k % 3 + 1}", None if k % 5 == 0 else "c", "n", "p", "P", None, "i" if k % 2 else None, None, "TX" if k % 4 else None, "web", 1, k % 2) for k in range(40)]
    gold = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in BASE_FIELDS + extras) + ", complaint_count int, narrative_count int")
    for tasks in (None, 3):
        grains = serving.all_grains(gold, tasks)
        shown = plan(grains)
        assert shown.count("Exchange") == 1 and shown.index("Exchange") > shown.index("Generate")
        for name in GRAINS:
            want = sorted(map(repr, serving.grain(gold, name).collect()))
            got = serving.split_grain(grains, name, ["complaint_count", "narrative_count"])
            assert sorted(map(repr, got.collect())) == want, name
    assert serving.task_count(0) == 1 and serving.task_count(serving.TASK_ROWS + 1) == 2
    assert grains.where(F.col("complaint_count").isNull()).count() == 0


def test_terms_meet_the_vocabulary_without_a_shuffle(spark, monkeypatch):
    """No row per document and term is shuffled, and the vocabulary found among
    frequent words only is that of all terms."""
    from collections import Counter

    from ledgerline.operators import tfidf

    texts = [" ".join(f"w{'abcdefgh'[(i * j) % 8]}{'xyz'[(i + j) % 3]}" for j in range(i % 9 + 2)) for i in range(60)] + [None, "", "\U0001d41aabc \U0001d7d8ghi ab_def déf alone \U0001f600glad"]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "complaint_id string, excerpt string")
    df, cf = Counter(), Counter()
    for row in tfidf.terms(docs, "complaint_id", "excerpt").collect():
        cf.update(row.terms)
        df.update(set(row.terms))
    assert {"alone", "glad"} <= set(cf) and not {"abc", "def", "ghi"} & set(cf)
    usable = [t for t in cf if 2 <= df[t] <= 0.95 * len(texts)]
    for size in (5, 12, 4000):
        want = sorted(sorted(usable, key=lambda t: (-cf[t], t))[:size])
        for numbered in (tfidf.NUMBERED_WORDS, 1):
            monkeypatch.setattr(tfidf, "NUMBERED_WORDS", numbered)
            model = tfidf.fit(docs, max_features=size)
            assert [(r.term, r.df, r.cf) for r in model.vocabulary.orderBy("term_index").collect()] == [(t, df[t], cf[t]) for t in want]
            assert "Exchange" not in plan(model.weights)
        monkeypatch.undo()


def test_stored_raw_rows_are_deduplicated_where_they_lie(spark):
    """The overlap dedup neither shuffles the wide rows nor loses one: same rows
    as from the plain raw rows."""
    from __spark_entry__ import SMOKE_DIR

    from ledgerline.plans import bronze
    from ledgerline.plans.warehouse import for_testdata

    w = for_testdata(spark, SMOKE_DIR)
    kept, plain = bronze.dedup_latest(w._raw()), bronze.dedup_latest(w["incoming"])
    assert "Exchange" not in plan(kept) and "Exchange" in plan(plain)
    assert kept.columns == plain.columns == w["bronze_complaints"].columns and bronze.KEY not in w["incoming"].columns
    assert kept.count() == plain.count() == w["bronze_complaints"].count() and kept.exceptAll(plain).isEmpty()


def test_a_stored_step_leaves_no_shuffle_on_disk(spark):
    """What is stored is read from there: its shuffle is gone."""
    import time

    from ledgerline.session import shared_table

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        return {n for n in (files.apply(k).getName() for k in range(files.size())) if n.startswith("shuffle_")}

    before = shuffles()
    table = shared_table(spark.range(1000).repartition(3, F.col("id") % 7), "step")
    until = time.time() + 20  # files are removed behind the query
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before and table.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_stored_raw_rows_are_not_joined_again(spark, tmp_path):
    """A later warehouse over the same store reads it and starts no job of the
    raw rows' build; the rows without texts are dropped once those with them are
    stored."""
    import os

    from __spark_entry__ import SMOKE_DIR

    from ledgerline.plans.warehouse import Warehouse

    steps, built, seen = [], [], []

    def incoming():
        built.append(1)
        rows = testdata.incoming(spark, SMOKE_DIR, 2, steps)
        seen.extend(os.path.dirname(t.inputFiles()[0].removeprefix("file://")) for t in steps)
        assert all(map(os.path.isdir, seen))
        return rows

    rows = [Warehouse(spark, incoming, str(tmp_path), buckets=2, steps=steps)["incoming"].count() for _ in range(2)]
    assert rows[0] == rows[1] > 0 and len(built) == 1
    assert len(seen) == 1 and not steps and not os.path.exists(seen[0])


def test_a_block_of_csv_lines_reaches_python_in_small_batches():
    """A block may be spread over any number of batches: none has to hold a
    whole block, let alone a task's blocks."""
    import pyarrow as pa

    from ledgerline.sources.csv_ranges import _cut

    kinds = {"line": pa.string(), "file": pa.string(), "start": pa.int64(), "seq": pa.int32(), "open": pa.bool_(), "before": pa.int64()}
    blocks = [(("f", 0, 0, False, 0), ["h", 'a,"x', "", 'y"\r', "", "b", 'c,"']), (("f", 0, 1, True, 3), ['z"', "d"]), (("g", 0, 0, False, 0), ["h"])]
    rows = [(line, *(block if i == 0 else (None,) * 5)) for block, lines in blocks for i, line in enumerate(lines)]
    want = [("f", 0, "h", True), ("f", 1, 'a,"x\n\ny"', True), ("f", 2, "b", True), ("f", 3, 'c,"', False), ("f", 3, 'z"', False), ("f", 4, "d", True), ("g", 0, "h", True)]
    for size in (1, 2, 3, len(rows)):
        batches = [pa.RecordBatch.from_pylist([dict(zip(kinds, r)) for r in rows[k : k + size]], pa.schema(kinds.items())) for k in range(0, len(rows), size)]
        got = [(r["file"], r["number"], r["text"], r["whole"]) for out in _cut(iter(batches)) for r in out.to_pylist()]
        assert got == want, size
