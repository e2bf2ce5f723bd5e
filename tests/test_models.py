"""The model graph end to end on the edge cases, and the full check suite."""

import datetime as dt

from pyspark.sql import functions as F

from fixtures import IDS, bronze_df, edge_rows
from ledgerline.plans import quality
from ledgerline.plans.warehouse import Warehouse


def build(spark):
    return Warehouse(spark, lambda: bronze_df(spark, edge_rows()))


def test_totals_follow_from_the_edge_cases(spark):
    w = build(spark)
    rows = edge_rows()
    told = [r for r in rows if r["Consumer complaint narrative"].strip()]
    assert w["fact_complaints"].count() == len(rows) == 9
    assert w["narrative_search_documents"].count() == len(told) == 7
    assert w["complaint_tags"].count() == 2 and w["companies"].count() == 2
    one = w["complaint_metrics"].agg(*[F.sum(c).alias(c) for c in ("sent_before_received_count", "known_timeliness_count", "timely_response_count")]).first()
    assert tuple(one) == (1, 9, 8)
    assert [r.zip_code for r in w["dim_geography"].filter("zip_code LIKE '00%'").collect()] == ["00420"]
    day = w["dim_date"].filter(F.col("calendar_date") == dt.date(2021, 1, 2)).first()
    assert (day["iso_year"], day["iso_week"]) == (2020, 53)


def test_suite_passes_on_edge_cases(spark):
    results = {r["check"]: r["failures"] for r in quality.run_suite(build(spark)).collect()}
    assert len(results) == 126
    assert {k: v for k, v in results.items() if v} == {}


def test_blank_and_key_rules(spark):
    w = build(spark)
    by_id = {r["complaint_id"]: r for r in w["stg_complaints_keyed"].collect()}
    stg = {name: by_id[i] for name, i in IDS.items()}
    assert stg["blank labels"]["issue"] is None and stg["narrative of spaces"]["narrative"] is None
    assert stg["ISO year before"]["date_received"] == dt.date(2021, 1, 2)
    assert stg["no narrative, odd company"]["company_name"] == 'Smith | "Sons" & Co'
    # a missing component keeps a key of its own, the same each time
    assert stg["blank labels"]["product_category_id"] != stg["ordinary"]["product_category_id"]
    assert stg["two tags"]["product_category_id"] == stg["ordinary"]["product_category_id"]
    assert [stg[n]["timely_response"] for n in ("sent too early", "ordinary")] == [False, True]
    assert sorted(r["tag_name"] for r in w["tags"].collect()) == ["Older American", "Servicemember"]


def test_grains_reconcile(spark):
    w = build(spark)
    totals = quality.grain_totals(w).drop("source").distinct().count()
    assert totals == 1


def test_stored_tables_are_reused(spark, tmp_path):
    import os

    store = str(tmp_path / "store")
    first = Warehouse(spark, lambda: bronze_df(spark, edge_rows()), store)
    assert first["complaint_metrics"].count() == 9
    marker = os.path.join(store, "complaint_metrics", "_SUCCESS")
    stamp = os.path.getmtime(marker)
    second = Warehouse(spark, lambda: bronze_df(spark, edge_rows()), store)
    assert second["complaint_metrics"].count() == 9
    assert os.path.getmtime(marker) == stamp  # read back, not rewritten
    grains = second["grain_issues"]
    assert grains.agg(F.sum("complaint_count")).first()[0] == 9
