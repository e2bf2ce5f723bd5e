"""Distinct counts from bitmaps against plain ones."""

import random

from pyspark.sql import functions as F

from ledgerline.operators import bitmaps


def test_counts_equal_plain_distinct(spark):
    """Many labels (several ranges of numbers), nulls, empty groups of labels."""
    rng = random.Random(5)
    rows = [(rng.choice("abc"), rng.randrange(20), None if rng.random() < 0.05 else f"L{rng.randrange(70_000)}") for _ in range(30_000)]
    rows += [("only null", 1, None)]
    grain = spark.createDataFrame(rows, "k string, day int, label string").withColumn("n_count", F.lit(1))
    numbers = bitmaps.number_labels(grain, "label").cache()
    distinct = {r[2] for r in rows if r[2]}
    assert [r.label_number for r in numbers.orderBy("label").collect()] == list(range(1, len(distinct) + 1))
    wide = numbers.withColumn("label_number", F.col("label_number") * 5)  # numbers may have gaps: four ranges of bits
    for table in (bitmaps.build(grain, "label", numbers), bitmaps.build(grain, "label", wide)):
        assert table.columns == ["k", "day", bitmaps.BUCKET, bitmaps.BITS]
        for by in ((), ("k",), ("k", "day")):
            for where in ("true", "day < 7 AND k <> 'a'", "day > 100"):
                got = sorted(map(tuple, bitmaps.count_distinct(table.where(where), by, "n").collect()))
                kept = grain.where(where)
                want = kept.groupBy(*by).agg(F.countDistinct("label")) if by else kept.agg(F.countDistinct("label"))
                assert got == sorted(map(tuple, want.collect())), (by, where)


def test_numbers_stay_when_labels_arrive(spark):
    first = bitmaps.number_labels(spark.createDataFrame([("b",), ("d",), (None,)], "label string"), "label")
    second = bitmaps.number_labels(spark.createDataFrame([("a",), ("d",), ("c",)], "label string"), "label", known=first)
    assert {r.label: r.label_number for r in second.collect()} == {"b": 1, "d": 2, "a": 3, "c": 4}
    empty = spark.createDataFrame([], "label string")
    assert bitmaps.number_labels(empty, "label").count() == 0
    assert bitmaps.number_labels(empty, "label", known=second).count() == 4


def test_no_distinct_shuffle(spark):
    table = spark.createDataFrame([("a", 1, bytearray(4096))], f"k string, {bitmaps.BUCKET} long, {bitmaps.BITS} binary")
    plan = bitmaps.count_distinct(table, ("k",), "n")._jdf.queryExecution().executedPlan().toString()
    assert "bitmap_or_agg" in plan and "distinct" not in plan.lower()


def test_no_bitmap_is_shuffled(spark):
    """Narrow rows meet once; bitmaps are built behind that shuffle, in key order."""
    grain = spark.createDataFrame([("a", "x", 1)], "k string, label string, n_count int")
    numbers = spark.createDataFrame([("x", 1)], "label string, label_number long")
    plan = bitmaps.build(grain, "label", F.broadcast(numbers))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.index("bitmap_construct_agg") < plan.index("Exchange hashpartitioning")  # the plan reads from its end
