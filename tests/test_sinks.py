"""Sinks, manifest, views, size guard and dataset inspection."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fixtures import bronze_df, metric_grains, edge_rows
from ledgerline.plans import serving
from ledgerline.plans.metric_query import inspect_datasets
from ledgerline.plans.scope import Scope
from ledgerline.plans.warehouse import Warehouse
from ledgerline.sources import sinks


@pytest.fixture(scope="module")
def wh(spark):
    return Warehouse(spark, lambda: bronze_df(spark, edge_rows()))


def test_verified_parquet_and_exports(spark, wh, tmp_path):
    back = sinks.write_parquet_verified(wh["complaint_metrics"], str(tmp_path / "gold"))
    assert back.count() == 9
    written = sinks.export_grains(
        wh["complaint_metrics"], {g: serving.grain(wh["complaint_metrics"], g) for g in serving.GRAINS}, str(tmp_path)
    )
    assert set(written) == set(serving.GRAINS)
    for df in written.values():
        assert df.agg(F.sum("complaint_count")).first()[0] == 9
    size = sinks.size_guard(spark, str(tmp_path / "overview"))
    assert 0 < size < 90 * 1024**2
    with pytest.raises(ValueError):
        sinks.size_guard(spark, str(tmp_path / "overview"), limit_bytes=10)


def test_verified_parquet_computes_the_source_once(spark, tmp_path):
    """The writing job counts its own rows; empty and appended tables too."""
    computed = spark.sparkContext.accumulator(0)

    def each(batches):
        for batch in batches:
            computed.add(len(batch))
            yield batch

    rows = spark.range(0, 1000, 1, 4).mapInPandas(each, "id long")
    path = str(tmp_path / "table")
    assert sinks.write_parquet_verified(rows, path).count() == 1000
    assert computed.value == 1000
    assert sinks.write_parquet_verified(rows, path, mode="append").count() == 2000
    assert sinks.write_parquet_verified(rows.where("false"), path).count() == 0
    assert sinks.write_parquet_verified(spark.range(3), str(tmp_path / "new"), mode="append").count() == 3
    with pytest.raises(ValueError):
        sinks.write_parquet_verified(rows, path, expected_rows=999)


def test_reconcile_detects_difference(spark, wh):
    m = wh["complaint_metrics"]
    assert serving.reconcile(m, serving.grain(m, "issues")).count() == 0
    broken = serving.grain(m, "issues").withColumn("narrative_count", F.lit(0))
    assert [r["metric"] for r in serving.reconcile(m, broken).collect()] == ["narrative_count"]


def test_manifest_csv_and_views(spark, wh, tmp_path):
    row = sinks.manifest(wh["complaint_metrics"], dt.date(2024, 1, 1), dt.date(2025, 2, 1)).first()
    assert row["complaints"] == 9 and row["complaint_count"] == 9 and row["narrative_count"] == 7
    assert row["observed_first_date"] == dt.date(2021, 1, 2)
    sinks.write_csv(wh["grain_overview"], str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.count() == wh["grain_overview"].count()
    names = sinks.register_views(spark, {"complaint_metrics_v": wh["complaint_metrics"]})
    assert names == ["complaint_metrics_v"]
    assert spark.sql("SELECT count(*) FROM complaint_metrics_v").first()[0] == 9
    assert sinks.metric_names(wh["complaint_metrics"])[0] == "complaint_count"


def test_inspect_datasets(spark):
    g = metric_grains(spark)
    scope = Scope(dt.date(2022, 5, 30), dt.date(2022, 5, 31))
    info = inspect_datasets(g["overview"], scope)
    assert info["snapshot_coverage"] == {"first_date": dt.date(2022, 5, 30), "last_date": dt.date(2022, 5, 31)}
    assert "timely_response_rate" in info["metrics"] and len(info["metrics"]) == 23


def test_release_manifest(spark, wh, tmp_path):
    written = sinks.export_grains(
        wh["complaint_metrics"], {"overview": serving.grain(wh["complaint_metrics"], "overview")}, str(tmp_path)
    )
    assert written
    record = sinks.release_manifest(
        spark, wh["complaint_metrics"], {"overview": str(tmp_path / "overview")}, overlap_records_removed=0
    )
    assert record["complaints"] == 9 and record["metric_totals"]["narrative_count"] == 7
    entry = record["exports"]["overview"]
    assert entry["bytes"] > 0 and entry["fingerprint"].startswith(f"{written['overview'].count()}:")
