"""Silver: normalised complaint table, narratives, lookups and tag bridge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.keys import surrogate_key


# Lookups take the distinct labels first and hash only those: the key columns
# of ``keyed`` are not read, so no key is computed per complaint.


def companies(keyed: DataFrame) -> DataFrame:
    labels = keyed.select("company_name").distinct()
    return labels.select(surrogate_key("company_name").alias("company_id"), "company_name")


def product_categories(keyed: DataFrame) -> DataFrame:
    labels = keyed.select("product", "sub_product").distinct()
    return labels.select(surrogate_key("product", "sub_product").alias("product_category_id"), "product", "sub_product")


def issue_categories(keyed: DataFrame) -> DataFrame:
    labels = keyed.select("product", "sub_product", "issue", "sub_issue").distinct()
    return labels.select(
        surrogate_key("product", "sub_product", "issue", "sub_issue").alias("issue_category_id"),
        surrogate_key("product", "sub_product").alias("product_category_id"),
        "issue",
        "sub_issue",
    )


def submission_channels(keyed: DataFrame) -> DataFrame:
    labels = keyed.select("submission_channel").distinct()
    return labels.select(surrogate_key("submission_channel").alias("submission_channel_id"), "submission_channel")


def complaints(keyed: DataFrame) -> DataFrame:
    """One row per complaint; the narrative text itself is stored separately."""
    return keyed.select(
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
        F.col("narrative").isNotNull().alias("has_narrative"),
        "_source_archive",
        "_source_csv",
        "_source_record_number",
        "_ingested_at",
    )


def complaint_narratives(stg: DataFrame) -> DataFrame:
    return stg.filter(F.col("narrative").isNotNull()).select("complaint_id", "narrative")


def tags(stg_tags: DataFrame) -> DataFrame:
    return stg_tags.select("tag_name").distinct().select(surrogate_key("tag_name").alias("tag_id"), "tag_name")


def complaint_tags(stg_tags: DataFrame) -> DataFrame:
    return stg_tags.select("complaint_id", surrogate_key("tag_name").alias("tag_id"))
