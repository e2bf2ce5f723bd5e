"""Archive intake, validation gates, retention, release precedence and
rolling-window month coverage."""

import csv
import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerline.plans import bronze, coverage, profile, refresh
from ledgerline.plans.warehouse import Warehouse
from ledgerline.schema import RAW_FIELDS
from ledgerline.sources import raw


def write_archive(path, rows):
    path.mkdir(parents=True, exist_ok=True)
    with open(path / "complaints.csv", "w", newline="") as fh:
        w = csv.DictWriter(fh, fieldnames=RAW_FIELDS + ["Extra column"])
        w.writeheader()
        for r in rows:
            full = {c: "" for c in RAW_FIELDS}
            full.update(r)
            full["Extra column"] = "ignored"
            w.writerow(full)


def record(cid, received, company, narrative=""):
    return {"Complaint ID": cid, "Date received": received, "Company": company,
            "Product": "Card", "Submitted via": "Web", "Timely response?": "Yes", "Date sent to company": received,
            "Consumer complaint narrative": narrative}


STORY = 'First it rained,\nthen they said ""no"" and hung up\n'
#: The window in which the archives below are kept.
START, END = dt.date(2021, 4, 1), dt.date(2022, 4, 1)


@pytest.fixture()
def archives(tmp_path):
    """Rows on both sides of both borders of the window; the later archive
    revises one complaint and dates another out of the window."""
    write_archive(tmp_path / "spring", [
        record("50", "2021-03-31", "Elm Lender"),
        record("51", "2021-04-01", "Elm Lender", STORY),
        record("52", "03/31/2022", "Oak Lender"),
        record("53", "2021-11-05", "Oak Lender"),
        record("54", "4/1/2022", "Oak Lender"),
    ])
    write_archive(tmp_path / "summer", [record("55", "2022-04-02", "Fir Lender"), record("52", "2022-03-31", "Oak Lender (renamed)", "Now with a text")])
    return [(str(tmp_path / "spring"), "spring.zip", 1), (str(tmp_path / "summer"), "summer.zip", 2)]


def test_intake_numbers_window_and_precedence(spark, archives):
    incoming = raw.ingest(spark, archives, START, END, "2022-05-05T00:00:00+00:00")
    got = {(r["_source_archive"], r["Complaint ID"], r["_source_record_number"]) for r in incoming.collect()}
    # numbered in the whole file, then cut to the window
    assert got == {("spring.zip", "51", 2), ("spring.zip", "52", 3), ("spring.zip", "53", 4), ("summer.zip", "52", 2)}
    assert profile.overlap_excess(incoming).first()[0] == 1
    w = Warehouse(spark, lambda: incoming)
    gold = {r["complaint_id"]: r for r in w["complaint_metrics"].collect()}
    assert {i: r["company_name"] for i, r in gold.items()} == {"51": "Elm Lender", "52": "Oak Lender (renamed)", "53": "Oak Lender"}
    assert [gold[i]["narrative_count"] for i in ("51", "52", "53")] == [1, 1, 0]
    assert bronze.rows_outside_window(w["complaint_metrics"], START, END).first()[0] == 0
    assert w["complaint_narratives"].filter("complaint_id = '51'").first()["narrative"] == STORY


def test_validity_gate_rejects_bad_rows(spark, tmp_path):
    write_archive(tmp_path / "bad", [record("1", "not a date", "A"), record(" ", "2024-01-01", "A")])
    df = raw.read_csv(spark, str(tmp_path / "bad"))
    counts = raw.validity_counts(df).first()
    assert counts["unparsed_dates"] == 1 and counts["blank_ids"] == 1
    with pytest.raises(ValueError):
        raw.validate(df)
    with pytest.raises(ValueError):
        raw.require_columns(df.drop("Tags"))


def intervals(spark, months):
    rows = [(f"archive_{i}", i, first, last) for i, (first, last) in enumerate(months, 1)]
    return spark.createDataFrame(rows, "name string, priority int, first_month date, last_month date")


def test_rolling_window_and_gaps(spark):
    """36 months up to the last covered one, over a year's end; holes count."""
    day = dt.date
    years = [(day(2015, 2, 1), day(2017, 6, 1)), (day(2017, 7, 1), day(2019, 12, 1))]
    w = coverage.rolling_window(intervals(spark, years)).first()
    assert (w["window_start"], w["window_end"]) == (day(2017, 1, 1), day(2020, 1, 1))
    coverage.require_no_gaps(intervals(spark, years))
    later = [*years, (day(2020, 2, 1), day(2020, 3, 1))]  # January 2020 is missing
    w = coverage.rolling_window(intervals(spark, later)).first()
    assert (w["window_start"], w["window_end"]) == (day(2017, 4, 1), day(2020, 4, 1))
    assert coverage.gaps(intervals(spark, later)).count() == 1
    assert coverage.select_intervals(intervals(spark, later)).count() == 3
    assert coverage.select_intervals(intervals(spark, [*later, (day(2010, 1, 1), day(2010, 5, 1))])).count() == 3
    with pytest.raises(ValueError):
        coverage.require_no_gaps(intervals(spark, later))


def test_record_numbers_per_full_path(spark, tmp_path):
    """Forty files of one name, several read by one task: numbers restart in each."""
    for k in range(40):
        write_archive(tmp_path / f"f{k}", [record(f"{k}-{i}", "2024-01-01", "A") for i in range(3)])
    rows = raw.ingest(
        spark, [(f"{tmp_path}/f*", "all.zip", 1)], dt.date(2024, 1, 1), dt.date(2025, 1, 1), "now"
    )
    got = rows.groupBy("_source_record_number").count().collect()
    assert {(r["_source_record_number"], r["count"]) for r in got} == {(1, 40), (2, 40), (3, 40)}


def test_record_numbers_of_split_parquet(spark, tmp_path):
    columns = [F.lit("").alias(c) for c in RAW_FIELDS if c not in ("Complaint ID", "Date received")]
    frame = spark.range(200_000).coalesce(1).select(
        F.col("id").cast("string").alias("Complaint ID"), F.lit("2024-01-01").alias("Date received"), *columns
    )
    frame.write.option("parquet.block.size", 64 * 1024).parquet(str(tmp_path / "big"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
        rows = raw.ingest(
            spark, [(str(tmp_path / "big"), "big.zip", 1)], dt.date(2024, 1, 1), dt.date(2025, 1, 1), "now", fmt="parquet"
        ).select("Complaint ID", "_source_record_number")
        assert rows.rdd.getNumPartitions() > 1
        n = F.col("_source_record_number")
        assert rows.filter(n != F.col("`Complaint ID`").cast("long") + 1).count() == 0 and rows.count() == 200_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_gates(spark, archives, tmp_path):
    with pytest.raises(ValueError, match="retention window"):
        raw.ingest(spark, archives, dt.date(2030, 1, 1), dt.date(2031, 1, 1), "now")
    for blank in ("\t", "\u00a0", "\u2003\r\n"):
        write_archive(tmp_path / f"blank{ord(blank[0])}", [record(blank, "2024-01-01", "A")])
        with pytest.raises(ValueError, match="missing complaint IDs"):
            raw.ingest(spark, [(str(tmp_path / f"blank{ord(blank[0])}"), "x", 1)], dt.date(2024, 1, 1), dt.date(2025, 1, 1), "now")


def test_unicode_space_around_ids_is_one_complaint(spark, tmp_path):
    write_archive(tmp_path / "pad", [record("7", "2024-01-01", "A"), record("7\u00a0", "2024-01-02", "B")])
    rows = raw.ingest(spark, [(str(tmp_path / "pad"), "x", 1)], dt.date(2024, 1, 1), dt.date(2025, 1, 1), "now")
    assert bronze.dedup_latest(rows).count() == 1
    assert profile.overlap_excess(rows).first()[0] == 1
    assert Warehouse(spark, lambda: rows)["complaints"].count() == 1


def test_refresh_end_to_end(spark, archives, tmp_path):
    """Three complaints from four retained rows; gates stop a release."""
    out = str(tmp_path / "release")
    made = refresh.refresh(spark, archives, START, END, out, "2022-05-05T00:00:00+00:00")
    assert (made["complaints"], made["overlap_records_removed"], made["metric_totals"]["narrative_count"]) == (3, 1, 2)
    assert set(made["exports"]) == {"overview", "issues", "geography", "channels", "evidence"}
    assert len({e["fingerprint"] for e in made["exports"].values()}) == 5
    told = {r["complaint_id"]: r["company_name"] for r in spark.read.parquet(f"{out}/evidence").collect()}
    assert told == {"51": "Elm Lender", "52": "Oak Lender (renamed)"}
    with pytest.raises(ValueError, match="size guard"):
        refresh.refresh(spark, archives, START, END, str(tmp_path / "small"), "now", size_limit=100)
    with pytest.raises(ValueError, match="retention window"):
        refresh.refresh(spark, archives, dt.date(2030, 1, 1), dt.date(2031, 1, 1), str(tmp_path / "none"), "now")
