"""The driver contract: entry, query registry and oracle SQL."""

import duckdb

import __spark_entry__ as E
from tables import SF_SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"period", "complaints", "narratives", "coverage_pct"} <= set(df.columns)


def test_oracles_cover_queries():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    own = {k for k in q if k != "pipeline" and not k.startswith("op")}
    assert own <= set(o)  # every query of the library itself has SQL


def test_fixed_lists_have_the_documented_sizes():
    """Counts of the inventory, so that a check or flag cannot go missing on
    both sides at once."""
    from ledgerline.plans.quality import PRESERVES, SUITE
    from ledgerline.schema import FLAGS, OUTCOMES, RATIOS, STATE_CODES

    assert len(FLAGS) == 18 and len(STATE_CODES) == 51
    assert sum(len(nn) for nn, _, _ in SUITE.values()) == 81
    assert sum(len(u) for _, u, _ in SUITE.values()) == 18
    assert sum(len(r) for _, _, r in SUITE.values()) == 17
    assert len(OUTCOMES) == 5 and RATIOS and PRESERVES


def test_some_oracles_match_at_small_scale(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    for name in ["gold_complaint_metrics", "grain_overview", "headline", "outcome_mix", "mq_period",
                 "concern_summary", "profile_top_values", "qa_silver"]:
        df = E.queries()[name](spark, SF_SMALL)
        plain = lambda v: round(v, 9) if isinstance(v, float) else v
        got = sorted(map(repr, (tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())))
        cur = con.execute(E.oracle_sql()[name])
        cols = [d[0] for d in cur.description]
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        want = sorted(map(repr, (tuple(plain(r[i]) for i in order) for r in cur.fetchall())))
        assert sorted(cols) == sorted(df.columns), name
        assert len(got) == len(want), name
        assert got == want, name


def test_import_needs_no_spark_jars():
    """The registry must load where Spark's jars are not inside the Python package."""
    import os
    import subprocess
    import sys

    code = (
        "import glob; glob.glob = lambda *a, **k: []\n"
        "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, timeout=120)


def test_stop_words_equal_sparks(spark):
    from pyspark.ml.feature import StopWordsRemover

    from ledgerline.operators.tfidf import spark_english_stop_words

    assert list(spark_english_stop_words()) == StopWordsRemover.loadDefaultStopWords("english")
