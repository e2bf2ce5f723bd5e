"""Rolling-window archive selection and month-coverage checks (QA-17/18, FN-4).

Input is a table of archive intervals ``name, priority, first_month,
last_month`` (month starts).  All arithmetic is in calendar months.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.dates import parse_mixed_date, shift_months
from ledgerline.operators.totals import attach_totals


def intervals_from_rows(raw: DataFrame) -> DataFrame:
    """Archive intervals observed in raw rows: first and last received month."""
    d = parse_mixed_date(F.col("`Date received`"))
    return raw.groupBy(F.col("_source_archive").alias("name"), F.col("_source_priority").alias("priority")).agg(
        F.trunc(F.min(d), "month").alias("first_month"), F.trunc(F.max(d), "month").alias("last_month")
    )


def rolling_window(intervals: DataFrame, months: int = 36) -> DataFrame:
    """``[start, end)``: the ``months`` calendar months ending with the latest
    archive month (one row)."""
    last = intervals.agg(F.max("last_month").alias("last"))
    return last.select(
        shift_months(F.col("last"), -(months - 1)).alias("window_start"),
        shift_months(F.col("last"), 1).alias("window_end"),
    )


def select_intervals(intervals: DataFrame, months: int = 36) -> DataFrame:
    """Archives overlapping the window, in priority order (QA-18)."""
    w = rolling_window(intervals, months)
    return (
        attach_totals(intervals, w)
        .filter((F.col("last_month") >= F.col("window_start")) & (F.col("first_month") < F.col("window_end")))
        .select("name", "priority", "first_month", "last_month")
        .orderBy("priority", "name")
    )


def month_coverage(intervals: DataFrame, months: int = 36) -> DataFrame:
    """Every month of the window with the number of selected archives
    covering it; a 0 is a gap that blocks publication (QA-17).  The month
    series is bounded by ``months``; each interval expands to its own span."""
    w = rolling_window(intervals, months)
    expected = w.select(
        F.explode(F.sequence("window_start", shift_months(F.col("window_start"), months - 1), F.expr("INTERVAL 1 MONTH"))).alias("month")
    )
    covered = (
        attach_totals(select_intervals(intervals, months), w)
        .select(
            "name",
            F.explode(
                F.sequence(F.greatest("first_month", "window_start"), "last_month", F.expr("INTERVAL 1 MONTH"))
            ).alias("month"),
        )
        .groupBy("month")
        .agg(F.count_distinct("name").alias("archives"))
    )
    return expected.join(F.broadcast(covered), "month", "left").select(
        "month", F.coalesce(F.col("archives"), F.lit(0)).cast("long").alias("archives")
    )


def gaps(intervals: DataFrame, months: int = 36) -> DataFrame:
    return month_coverage(intervals, months).filter(F.col("archives") == 0)


def require_no_gaps(intervals: DataFrame, months: int = 36) -> None:
    if gaps(intervals, months).limit(1).count():
        raise ValueError("Archive catalog has gaps in the rolling window")
