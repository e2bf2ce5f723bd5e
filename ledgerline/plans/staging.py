"""Staging: standardise types and blanks without filtering records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.dates import parse_mixed_date
from ledgerline.functions.keys import surrogate_key
from ledgerline.functions.text import clean_label, narrative_or_null, yes_no, zs_trim

LABELS = {
    "complaint_id": "Complaint ID",
    "company_name": "Company",
    "product": "Product",
    "sub_product": "Sub-product",
    "issue": "Issue",
    "sub_issue": "Sub-issue",
    "state": "State",
    "zip_code": "ZIP code",
    "tags_raw": "Tags",
    "submission_channel": "Submitted via",
    "company_public_response": "Company public response",
    "company_response": "Company response to consumer",
}


def stg_complaints(bronze: DataFrame) -> DataFrame:
    """One row per bronze row: cleaned labels, parsed dates, 3-valued timeliness."""
    c = F.col
    return bronze.select(
        *[clean_label(c(f"`{raw}`")).alias(name) for name, raw in LABELS.items()],
        parse_mixed_date(c("`Date received`")).alias("date_received"),
        parse_mixed_date(c("`Date sent to company`")).alias("date_sent_to_company"),
        yes_no(c("`Timely response?`")).alias("timely_response"),
        narrative_or_null(c("`Consumer complaint narrative`")).alias("narrative"),
        c("`Date sent to company`").alias("date_sent_raw"),
        c("`Timely response?`").alias("timely_response_raw"),
        "_source_archive",
        "_source_csv",
        "_source_record_number",
        "_ingested_at",
    )


def stg_complaints_keyed(stg: DataFrame) -> DataFrame:
    """Add stable category keys derived from the JSON-encoded labels."""
    return stg.select(
        "*",
        surrogate_key("company_name").alias("company_id"),
        surrogate_key("product", "sub_product").alias("product_category_id"),
        surrogate_key("product", "sub_product", "issue", "sub_issue").alias("issue_category_id"),
        surrogate_key("submission_channel").alias("submission_channel_id"),
    )


def stg_complaint_tags(stg: DataFrame) -> DataFrame:
    """Unique (complaint, tag) pairs from the comma-separated tag text."""
    tag = zs_trim(F.col("tag_value"))
    return (
        stg.select("complaint_id", F.explode(F.split(F.col("tags_raw"), ",")).alias("tag_value"))
        .filter(F.nullif(tag, F.lit("")).isNotNull())
        .select("complaint_id", tag.alias("tag_name"))
        .distinct()
    )
