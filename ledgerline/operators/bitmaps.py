"""Exact distinct counts that add up: labels as bits (AGG-4).

A distinct count cannot be summed over the rows of a grain, so each question
would have to shuffle the labels.  With labels numbered densely, a group's
labels are a few fixed-size bitmaps; the bitmaps of any set of groups are
joined by OR, and counting bits gives the exact distinct count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.schema import metric_columns

NUMBER, BUCKET, BITS = "label_number", "label_bucket", "label_bits"


def number_labels(df: DataFrame, label: str, known: DataFrame | None = None) -> DataFrame:
    """``label, label_number``: the distinct non-null labels, numbered from 1
    without gaps in label order.  With ``known`` (an earlier result) its numbers
    stay and new labels follow, so bitmaps of earlier releases stay valid.

    Positions come from the sizes of sorted partitions: no task sees all labels.
    """
    fresh = df.select(label).where(F.col(label).isNotNull()).distinct()
    first = 1
    if known is not None:
        fresh = fresh.join(known.select(label), label, "left_anti")
        first += known.agg(F.max(NUMBER)).first()[0] or 0
    fields = df.schema[label].dataType.simpleString()
    rows = fresh.orderBy(label).rdd.zipWithIndex().map(lambda pair: (pair[0][0], pair[1] + first))
    numbered = df.sparkSession.createDataFrame(rows, f"`{label}` {fields}, {NUMBER} long")
    return numbered if known is None else known.select(label, NUMBER).unionByName(numbered)


def build(grain: DataFrame, label: str, numbers: DataFrame, drop: Sequence[str] = ()) -> DataFrame:
    """The grain's other keys with the bitmaps of their labels: one row per key
    and range of 32,768 numbers.  Groups whose only label is null get an empty
    bitmap, so that they stay.  Metric columns and ``drop`` are left out.

    The narrow rows meet and are sorted before any bitmap exists, so a task
    holds one bitmap at a time, and none is shuffled."""
    keys = [c for c in grain.columns if c not in {label, *drop, *metric_columns(grain.columns)}]
    at = F.col(NUMBER)
    bucket = F.coalesce(F.bitmap_bucket_number(at), F.lit(1).cast("long"))
    numbered = grain.select(*keys, label).join(numbers, label, "left").select(*keys, bucket.alias(BUCKET), NUMBER)
    met = numbered.repartition(*keys, BUCKET).sortWithinPartitions(*keys, BUCKET)
    return met.groupBy(*keys, BUCKET).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias(BITS))


def count_distinct(table: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """The labels of each group of ``by`` (none: one row) among the rows of a
    bitmap table, filtered as you like.  Bitmaps meet by OR before any shuffle,
    so each task sends one bitmap per group and range."""
    joined = table.groupBy(*by, BUCKET).agg(F.bitmap_or_agg(BITS).alias(BITS))
    counted = joined.groupBy(*by) if by else joined
    return counted.agg(F.coalesce(F.sum(F.bitmap_count(BITS)), F.lit(0)).cast("long").alias(name))
