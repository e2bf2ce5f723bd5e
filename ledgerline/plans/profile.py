"""Profiling of raw (bronze) complaint rows: quality, coverage by year,
duplicate IDs, blanks per field, value frequencies, per-source inventory
and content-signature duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.dates import parse_mixed_date
from ledgerline.functions.text import zs_trim

# --- Fixed values that must equal the reference's --------------------------
BLANK_FIELDS = [
    "Company", "Product", "Sub-product", "Issue", "Sub-issue", "State", "ZIP code", "Tags",
    "Submitted via", "Date sent to company", "Company public response",
    "Company response to consumer", "Timely response?",
]
VALUE_FIELDS = ["Tags", "Submitted via", "Company response to consumer", "Timely response?"]
BLANK_VALUE = "[blank]"
# --- end of fixed values ----------------------------------------------------


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _has_narrative() -> Column:
    return F.coalesce(zs_trim(_c("Consumer complaint narrative")), F.lit("")) != ""


def _checked(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.nullif(zs_trim(_c("Complaint ID")), F.lit("")).alias("complaint_id_checked"),
        parse_mixed_date(_c("Date received")).alias("received_date_checked"),
        _has_narrative().alias("has_narrative"),
    )


def round_pct(num: Column, den: Column) -> Column:
    """``round(100 * num / den, 2)`` rounded half up on the exact ratio of
    the integer counts (decimal division, no binary floating point)."""
    n = (F.lit(20000) * num + den).cast("decimal(38,0)")
    d = (F.lit(2) * den).cast("decimal(38,0)")
    return (F.floor(n / d) / F.lit(100.0)).cast("double")


def overall_quality(raw: DataFrame) -> DataFrame:
    """Rows, date range, missing IDs, unparsed dates, narratives (AGG-9)."""
    c = _checked(raw)
    return c.agg(
        F.count(F.lit(1)).alias("raw_records"),
        F.min("received_date_checked").alias("earliest_date"),
        F.max("received_date_checked").alias("latest_date"),
        F.count_if(F.col("complaint_id_checked").isNull()).alias("missing_complaint_ids"),
        F.count_if(F.col("received_date_checked").isNull()).alias("missing_or_unparsed_dates"),
        F.count_if("has_narrative").alias("records_with_narrative"),
    )


def yearly_coverage(raw: DataFrame) -> DataFrame:
    """Rows and narrative coverage per received year, 2 decimals (AGG-10)."""
    c = _checked(raw)
    per = c.groupBy(F.year("received_date_checked").alias("year")).agg(
        F.count(F.lit(1)).alias("raw_records"), F.count_if("has_narrative").alias("records_with_narrative")
    )
    return per.select(
        "year", "raw_records", "records_with_narrative",
        round_pct(F.col("records_with_narrative"), F.col("raw_records")).alias("narrative_coverage_pct"),
    )


def duplicate_ids(raw: DataFrame) -> DataFrame:
    """Distinct non-empty IDs, IDs seen more than once, extra rows (AGG-8)."""
    ids = _checked(raw).filter(F.col("complaint_id_checked").isNotNull())
    counts = ids.groupBy("complaint_id_checked").agg(F.count(F.lit(1)).alias("occurrences"))
    return counts.agg(
        F.count(F.lit(1)).alias("distinct_nonempty_ids"),
        F.count_if(F.col("occurrences") > 1).alias("ids_appearing_multiple_times"),
        F.coalesce(F.sum(F.col("occurrences") - 1), F.lit(0)).cast("long").alias("extra_records"),
    )


def overlap_excess(raw: DataFrame) -> DataFrame:
    """``count(*) - count(distinct trim(id))`` (AGG-7)."""
    return raw.agg(
        (F.count(F.lit(1)) - F.count_distinct(zs_trim(_c("Complaint ID")))).alias("overlap_records_removed")
    )


def blanks_by_field(raw: DataFrame, fields: list[str] = BLANK_FIELDS) -> DataFrame:
    """Blank count of each field from a single scan, unpivoted (AGG-11)."""
    wide = raw.agg(
        *[F.count_if(F.coalesce(zs_trim(_c(f)), F.lit("")) == "").alias(f"b{i}") for i, f in enumerate(fields)]
    )
    rows = [F.struct(F.lit(f).alias("field"), F.col(f"b{i}").alias("blank_records")) for i, f in enumerate(fields)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.field", "r.blank_records")


def top_values(raw: DataFrame, fields: list[str] = VALUE_FIELDS, k: int = 20) -> DataFrame:
    """Top ``k`` values per field, blank shown as '[blank]' (AGG-12).

    One unpivot, one partially aggregated (field, value) count, then a
    per-field rank; the ranked input is the number of distinct values."""
    long = raw.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(f).alias("field"),
                        F.coalesce(F.nullif(zs_trim(_c(f)), F.lit("")), F.lit(BLANK_VALUE)).alias("value"),
                    )
                    for f in fields
                ]
            )
        ).alias("r")
    ).select("r.field", "r.value")
    counts = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("complaints"))
    w = Window.partitionBy("field").orderBy(F.col("complaints").desc(), F.col("value").asc())
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def source_inventory(raw: DataFrame) -> DataFrame:
    """Rows and narrative rows per source archive and file (SRC-9)."""
    return raw.groupBy("_source_archive", "_source_csv").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(_has_narrative()).alias("rows_with_narrative")
    )


def signature_duplicates(df: DataFrame, id_col: str, signature: list[Column]) -> DataFrame:
    """Rows whose content signature repeats an earlier row (SRC-10): each
    skipped row with the first row (lowest id) it duplicates.

    The first id per signature is a partially aggregated ``min`` (a hot
    signature collapses map-side), joined back on the signature; no group
    is ever gathered into one task.
    """
    key = (
        F.md5(signature[0].cast("string"))
        if len(signature) == 1
        else F.md5(F.to_json(F.array(*[s.cast("string") for s in signature])))
    )
    sig = df.select(F.col(id_col).alias("id"), key.alias("signature"))
    first = sig.groupBy("signature").agg(F.min("id").alias("kept_id"))
    return sig.join(first, "signature").filter(F.col("id") != F.col("kept_id")).select(
        F.col("id").alias("skipped_id"), "kept_id", "signature"
    )
