"""Ranges from running totals against scans of the rows."""

import datetime as dt
import random

from pyspark.sql import functions as F

from ledgerline.functions.dates import bucket
from ledgerline.operators import cumulative

DAYS = [dt.date(2019, 11, 20) + dt.timedelta(days=k) for k in range(130)]


def frames(spark):
    """Keys with null parts, days without rows, rows without a date, keys that
    begin late."""
    rng = random.Random(8)
    rows = [(rng.choice(DAYS[10:-5:3]), rng.choice(["a", "b", None]), rng.choice(["x", None]), rng.randrange(1, 9), rng.randrange(3)) for _ in range(400)]
    rows += [(None, "a", "x", 5, 5), (DAYS[-6], "late", "x", 2, 0)]
    grain = spark.createDataFrame(rows, "date_received date, product string, sub_product string, complaint_count long, narrative_count long")
    return grain, cumulative.build(grain, ("product", "sub_product")).cache()


def test_any_range_equals_a_scan(spark):
    grain, table = frames(spark)
    first, last = cumulative.bounds(table)
    keys = table.select("product", "sub_product").distinct().count()
    assert table.count() == keys * ((last - first).days + 1)
    rng = random.Random(2)
    ranges = [(DAYS[0], DAYS[-1]), (first, last), (first, first), (last, last), (DAYS[5], DAYS[3]), (DAYS[0], DAYS[2])]
    ranges += [tuple(sorted(rng.sample(DAYS, 2))) for _ in range(3)]
    for start, end in ranges:
        kept = grain.where(F.col("date_received").between(F.lit(start), F.lit(end)))
        want = kept.groupBy("product", "sub_product").agg(F.sum("complaint_count"), F.sum("narrative_count"))
        got = cumulative.between(table, start, end).drop("date_received")
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect()))), (start, end)
    for (start, end), interval in zip(ranges, ("month", "week", "day", "year", "month", "day", "week", "quarter", "month")):
        kept = grain.where(F.col("date_received").between(F.lit(start), F.lit(end)))
        want = kept.groupBy(bucket(interval, "date_received").alias("d"), "product", "sub_product").agg(F.sum("complaint_count"), F.sum("narrative_count"))
        got = cumulative.buckets(table, start, end, interval)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect()))), (start, end, interval)


def test_a_range_reads_two_days(spark, tmp_path):
    _, table = frames(spark)
    table.write.parquet(f"{tmp_path}/t")
    stored = spark.read.parquet(f"{tmp_path}/t")
    plan = cumulative.between(stored, DAYS[20], DAYS[60])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(date_received" in plan


def test_no_rows(spark):
    grain, _ = frames(spark)
    table = cumulative.build(grain.limit(0), ("product", "sub_product"))
    assert table.count() == 0 and cumulative.between(table, DAYS[0], DAYS[9]).count() == 0
    assert cumulative.buckets(table, DAYS[0], DAYS[9], "month").count() == 0
