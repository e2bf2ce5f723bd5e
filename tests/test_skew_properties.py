"""Property tests against brute force, including inputs where one key
holds a third or more of all rows."""

import hashlib

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.operators.dedup import latest_per_key
from ledgerline.operators.topk import hash_sample
from ledgerline.plans.profile import signature_duplicates

rows_strategy = st.lists(
    st.tuples(st.sampled_from(["hot", "a", "b", " hot ", "c"]), st.integers(1, 3), st.integers(1, 1000)),
    min_size=1,
    max_size=60,
)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows_strategy)
def test_dedup_matches_brute_force(spark, rows):
    rows = rows + [("hot", 1, i) for i in range(len(rows))]  # >= half the rows on one key
    df = spark.createDataFrame(rows, "id string, priority int, recno int").repartition(3)
    got = {
        (r["id"].strip(), r["priority"], r["recno"])
        for r in latest_per_key(df, F.trim("id"), [F.col("priority").desc(), F.col("recno").desc()]).collect()
    }
    pdf = pd.DataFrame(rows, columns=["id", "priority", "recno"])
    pdf["k"] = pdf.id.str.strip()
    best = pdf.sort_values(["priority", "recno"], ascending=False).groupby("k").head(1)
    want = {(k, p, r) for k, p, r in zip(best.k, best.priority, best.recno)}
    assert {(k, p, r) for k, p, r in got} == want


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 120), st.integers(1, 200))
def test_hash_sample_any_size(spark, n, total):
    ids = [f"id{i}" for i in range(total)]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    got = sorted(r["id"] for r in hash_sample(df, "id", n).collect())
    want = sorted(sorted(ids, key=lambda i: (hashlib.md5(i.encode()).hexdigest(), i))[:n])
    assert got == want


def test_hot_signature(spark):
    texts = ["same text"] * 40 + [f"text {i}" for i in range(20)] + ["other"] * 3
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = signature_duplicates(df, "doc_id", [F.col("text")]).collect()
    kept = {r["skipped_id"]: r["kept_id"] for r in out}
    assert len(kept) == 39 + 2
    assert all(kept[i] == 0 for i in range(1, 40)) and kept[61] == 60 and kept[62] == 60
