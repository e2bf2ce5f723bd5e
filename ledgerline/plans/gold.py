"""Gold: the wide one-row-per-complaint metric table and the narrative view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.schema import flag_predicates

COMPLAINT_COLUMNS = [
    "complaint_id",
    "company_id",
    "product_category_id",
    "issue_category_id",
    "submission_channel_id",
    "date_received",
    "date_sent_to_company",
    "state",
    "zip_code",
    "company_public_response",
    "company_response",
    "timely_response",
    "has_narrative",
    "_source_archive",
    "_source_csv",
    "_source_record_number",
    "_ingested_at",
]


def complaint_metrics(
    complaints: DataFrame,
    companies: DataFrame,
    product_categories: DataFrame,
    issue_categories: DataFrame,
    submission_channels: DataFrame,
) -> DataFrame:
    """Denormalise complaints with four lookups (LEFT, row-preserving) and add
    the 18 additive flags plus the received -> sent day difference.

    The lookups are small relative to the fact; the planner (with adaptive
    execution) broadcasts them when their measured size is under the
    broadcast threshold and falls back to a sort-merge join otherwise.
    """
    c = complaints.alias("c")
    joined = (
        c.join(companies.alias("co"), F.col("c.company_id") == F.col("co.company_id"), "left")
        .join(
            product_categories.alias("p"),
            F.col("c.product_category_id") == F.col("p.product_category_id"),
            "left",
        )
        .join(
            issue_categories.alias("i"),
            F.col("c.issue_category_id") == F.col("i.issue_category_id"),
            "left",
        )
        .join(
            submission_channels.alias("ch"),
            F.col("c.submission_channel_id") == F.col("ch.submission_channel_id"),
            "left",
        )
        .select(
            *[F.col(f"c.{name}").alias(name) for name in COMPLAINT_COLUMNS],
            F.col("co.company_name"),
            F.col("p.product"),
            F.col("p.sub_product"),
            F.col("i.issue"),
            F.col("i.sub_issue"),
            F.col("ch.submission_channel"),
        )
    )
    flags = flag_predicates()
    complaint_count = flags.pop("complaint_count")
    return joined.select(
        "*",
        F.when(complaint_count, 1).otherwise(0).alias("complaint_count"),
        F.datediff("date_sent_to_company", "date_received").cast("long").alias(
            "days_to_send_to_company"
        ),
        *[F.when(pred, 1).otherwise(0).alias(name) for name, pred in flags.items()],
    )


def narrative_search_documents(metrics: DataFrame, narratives: DataFrame) -> DataFrame:
    """Narrative-bearing complaints with 12 context columns (an INNER join)."""
    return metrics.join(narratives, "complaint_id", "inner").select(
        "complaint_id",
        "date_received",
        "company_id",
        "company_name",
        "product",
        "sub_product",
        "issue",
        "sub_issue",
        "state",
        "company_response",
        "_source_archive",
        "_source_csv",
        "narrative",
    )
