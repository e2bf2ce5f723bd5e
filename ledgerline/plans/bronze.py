"""Bronze: release-precedence dedup, retention window and overlap metrics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.dates import parse_mixed_date
from ledgerline.functions.text import zs_trim
from ledgerline.operators.dedup import latest_per_key

ID = "Complaint ID"
#: The trimmed ID, where raw rows are stored in buckets of it.
KEY = "_dedup_key"


def with_key(incoming: DataFrame) -> DataFrame:
    return incoming.withColumn(KEY, zs_trim(ID))


def dedup_latest(incoming: DataFrame) -> DataFrame:
    """One row per trimmed complaint ID: the highest release priority wins,
    then the highest record number (WIN-1); the priority column is dropped.
    Rows stored in buckets of ``KEY`` are not shuffled."""
    best = latest_per_key(
        incoming,
        F.col(KEY) if KEY in incoming.columns else zs_trim(ID),
        [F.col("_source_priority").desc(), F.col("_source_record_number").desc()],
    )
    return best.drop("_source_priority", KEY)


def retain_window(raw: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Half-open retention ``[start, end)`` on the parsed received date."""
    d = parse_mixed_date(F.col("Date received"))
    return raw.filter((d >= F.lit(start)) & (d < F.lit(end)))


def rows_outside_window(gold: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Post-build retention check: gold rows outside the window (must be 0)."""
    d = F.col("date_received")
    return gold.agg(F.count_if((d < F.lit(start)) | (d >= F.lit(end))).alias("outside"))
