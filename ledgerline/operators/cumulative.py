"""Ranges of days by running totals (AGG-13, AGG-14, AGG-22, FLT-2).

A table of running totals per key over every day of the calendar answers any
range with two of its days: the totals at the end minus those before the
start.  Totals run within blocks (months) first and the blocks' totals over the
calendar, so no window holds more than a month of days or the list of months.
The results have the columns of a grain, so the dashboard's functions read them
as they read the grain itself.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.dates import bucket
from ledgerline.schema import metric_columns

DAY = "date_received"


def build(grain: DataFrame, keys: Sequence[str], day: str = DAY, block: str = "month") -> DataFrame:
    """``day``, the keys and the metrics' totals up to that day, for every key
    and every day between the first and the last one.  Rows without a date
    belong to no range and are left out."""
    names = metric_columns(grain.columns)
    daily = grain.where(F.col(day).isNotNull()).groupBy(day, *keys).agg(*[F.sum(m).alias(m) for m in names])
    span = daily.agg(F.min(day).alias("first"), F.max(day).alias("last"))
    # equal keys meet null-safely through one packed column
    packed = daily.withColumn("key", F.struct(*keys))
    calendar = (
        packed.select("key").distinct().join(F.broadcast(span))  # one row
        .select("key", F.explode(F.sequence("first", "last", F.expr("interval 1 day"))).alias(day))
    )
    found = packed.select(F.to_json("key", {"ignoreNullFields": "false"}).alias("at"), day, *names)
    dense = calendar.withColumn("at", F.to_json("key", {"ignoreNullFields": "false"})).join(found, ["at", day], "left")
    dense = dense.withColumn("block", bucket(block, day))
    inside = Window.partitionBy("at", "block").orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("at").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    running = dense.select("at", "block", "key", day, *[F.coalesce(F.sum(m).over(inside), F.lit(0)).alias(m) for m in names])
    blocks = dense.groupBy("at", "block").agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in names])
    offsets = blocks.select("at", "block", *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"before_{m}") for m in names])
    return (
        running.join(offsets, ["at", "block"])
        .select(day, "key.*", *[(F.col(m) + F.col(f"before_{m}")).alias(m) for m in names])
        .repartitionByRange(day)  # a stored file covers few days, so a lookup reads few files
        .sortWithinPartitions(day)
    )


def bounds(table: DataFrame, day: str = DAY) -> tuple[dt.date | None, dt.date | None]:
    """First and last day of the table."""
    return tuple(table.agg(F.min(day), F.max(day)).first())


def between(table: DataFrame, start: dt.date, end: dt.date, day: str = DAY) -> DataFrame:
    """The metrics of the closed range per key, dated at its start: two days
    of the table."""
    first, last = bounds(table, day)
    names = metric_columns(table.columns)
    keys = [c for c in table.columns if c not in {day, *names}]
    if first is None or start > end or end < first or start > last:
        return table.limit(0)
    upto, before = min(end, last), start - dt.timedelta(days=1)
    sign = F.when(F.col(day) == F.lit(upto), 1).otherwise(-1)
    two = table.where(F.col(day).isin(upto, before)).withColumns({m: F.col(m) * sign for m in names})
    summed = two.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in names]).where("complaint_count <> 0")
    return summed.select(F.lit(start).alias(day), *keys, *names)


def buckets(table: DataFrame, start: dt.date, end: dt.date, interval: str, day: str = DAY) -> DataFrame:
    """The metrics of the closed range per key and day, week, month, quarter or
    year, dated at the bucket's start: only the last days of buckets are read."""
    first, last = bounds(table, day)
    names = metric_columns(table.columns)
    keys = [c for c in table.columns if c not in {day, *names}]
    if first is None or start > end or end < first or start > last:
        return table.limit(0)
    upto, before = min(end, last), start - dt.timedelta(days=1)
    here, tomorrow = bucket(interval, day), bucket(interval, F.date_add(day, 1))
    inside = F.col(day).between(F.lit(start), F.lit(upto))
    edge = (inside & (here != tomorrow)) | F.col(day).isin(upto, before)
    adds = F.when(inside, F.struct(here.alias("period"), F.lit(1).alias("sign")))
    takes = F.when(F.col(day) < F.lit(upto), F.struct(tomorrow.alias("period"), F.lit(-1).alias("sign")))
    signed = table.where(F.col(day).between(F.lit(before), F.lit(upto)) & edge).withColumn("s", F.explode(F.array_compact(F.array(adds, takes))))
    summed = signed.groupBy("s.period", *keys).agg(*[F.sum(F.col(m) * F.col("s.sign")).alias(m) for m in names])
    return summed.where("complaint_count <> 0").withColumnRenamed("period", day).select(day, *keys, *names)
