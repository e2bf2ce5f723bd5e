"""Star schema: fact_complaints and seven dimensions over the gold table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.dates import calendar_attributes, date_key
from ledgerline.functions.keys import surrogate_key
from ledgerline.schema import FLAGS


def _response_key() -> F.Column:
    return surrogate_key(
        "company_response", "company_public_response", F.col("timely_response").cast("string")
    )


def dim_company(companies: DataFrame) -> DataFrame:
    return companies.select("company_id", "company_name")


def dim_product(product_categories: DataFrame) -> DataFrame:
    return product_categories.select("product_category_id", "product", "sub_product")


def dim_submission_channel(channels: DataFrame) -> DataFrame:
    return channels.select("submission_channel_id", "submission_channel")


def dim_issue(issue_categories: DataFrame, product_categories: DataFrame) -> DataFrame:
    """Issue combinations flattened with their product context (INNER join)."""
    return (
        issue_categories.alias("i")
        .join(
            product_categories.alias("p"),
            F.col("i.product_category_id") == F.col("p.product_category_id"),
            "inner",
        )
        .select(
            F.col("i.issue_category_id"),
            F.col("p.product").alias("issue_product"),
            F.col("p.sub_product").alias("issue_sub_product"),
            F.col("i.issue"),
            F.col("i.sub_issue"),
        )
    )


def dim_geography(metrics: DataFrame) -> DataFrame:
    return metrics.select(
        surrogate_key("state", "zip_code").alias("geography_id"), "state", "zip_code"
    ).distinct()


def dim_response(metrics: DataFrame) -> DataFrame:
    return metrics.select(
        _response_key().alias("response_id"),
        "company_response",
        "company_public_response",
        "timely_response",
    ).distinct()


def dim_date(metrics: DataFrame) -> DataFrame:
    """One row per calendar day between the earliest and latest received or
    sent date.  The bounds are one aggregate row; the day series is generated
    from it (its length is the calendar span, not the data volume)."""
    bounds = metrics.agg(
        F.least(F.min("date_received"), F.min("date_sent_to_company")).alias("first_date"),
        F.greatest(F.max("date_received"), F.max("date_sent_to_company")).alias("last_date"),
    )
    days = bounds.select(
        F.explode(F.sequence("first_date", "last_date", F.expr("INTERVAL 1 DAY"))).alias("d")
    )
    attrs = calendar_attributes(F.col("d"))
    return days.select(*[col.alias(name) for name, col in attrs.items()])


def fact_complaints(metrics: DataFrame) -> DataFrame:
    return metrics.select(
        "complaint_id",
        "company_id",
        "product_category_id",
        "issue_category_id",
        "submission_channel_id",
        surrogate_key("state", "zip_code").alias("geography_id"),
        _response_key().alias("response_id"),
        date_key("date_received").alias("received_date_key"),
        date_key("date_sent_to_company").alias("sent_date_key"),
        "days_to_send_to_company",
        *FLAGS,
    )
