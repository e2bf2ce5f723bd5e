"""Raw schema, additive flag catalogue, metric catalogue and serving grains.

Everything here is data, not logic: the rest of the package derives its
projections, aggregates and validations from these tables so a rule is
written once and reused by the gold model, the serving grains, the
reconciliation checks and the governed metric query.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values that must equal the reference's --------------------------
# The 16 source CSV fields, in source order.
RAW_FIELDS = [
    "Date received",
    "Product",
    "Sub-product",
    "Issue",
    "Sub-issue",
    "Consumer complaint narrative",
    "Company public response",
    "Company",
    "State",
    "ZIP code",
    "Tags",
    "Submitted via",
    "Date sent to company",
    "Company response to consumer",
    "Timely response?",
    "Complaint ID",
]

# Provenance columns appended at ingest.
PROVENANCE = ["_source_archive", "_source_csv", "_source_record_number", "_ingested_at"]

# The 18 additive 0/1 flags of the gold table, in gold column order.
FLAGS = [
    "complaint_count",
    "timely_response_count",
    "not_timely_response_count",
    "known_timeliness_count",
    "unknown_timeliness_count",
    "narrative_count",
    "closed_with_explanation_count",
    "monetary_relief_count",
    "non_monetary_relief_count",
    "in_progress_count",
    "untimely_response_outcome_count",
    "unknown_response_outcome_count",
    "public_response_available_count",
    "missing_state_count",
    "missing_zip_count",
    "missing_issue_count",
    "missing_sub_issue_count",
    "sent_before_received_count",
]

# Recorded company-response outcomes with a flag of their own.
OUTCOMES = {
    "closed_with_explanation_count": "Closed with explanation",
    "monetary_relief_count": "Closed with monetary relief",
    "non_monetary_relief_count": "Closed with non-monetary relief",
    "in_progress_count": "In progress",
    "untimely_response_outcome_count": "Untimely response",
}

# Serving grains: base keys plus the extra keys of each grain.
BASE_FIELDS = [
    "date_received",
    "company_id",
    "company_name",
    "product_category_id",
    "product",
    "sub_product",
]
GRAINS = {
    "overview": [],
    "issues": ["issue", "sub_issue"],
    "geography": ["state"],
    "channels": ["submission_channel"],
}

# Dimensions a governed metric query may group or filter by, per grain.
SCOPE_FIELDS = ["company_name", "product", "sub_product"]
DIMENSIONS = {
    "overview": SCOPE_FIELDS,
    "issues": SCOPE_FIELDS + ["issue", "sub_issue"],
    "geography": SCOPE_FIELDS + ["state"],
    "channels": SCOPE_FIELDS + ["submission_channel"],
}
INTERVALS = ["day", "week", "month", "quarter", "year"]

# Ratio metrics: (numerator flag, denominator flag), as percentages.
RATIOS = {
    "timely_response_rate": ("timely_response_count", "known_timeliness_count"),
    "narrative_coverage": ("narrative_count", "complaint_count"),
    "monetary_relief_share": ("monetary_relief_count", "complaint_count"),
    "non_monetary_relief_share": ("non_monetary_relief_count", "complaint_count"),
}

# The 50 U.S. states and DC, the allow-list of the location map.
STATE_CODES = (
    "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO "
    "MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC"
).split()

MISSING_LABEL = "Missing label"
ISSUE_NOT_RECORDED = "Issue not recorded"
# --- end of fixed values ----------------------------------------------------

RAW_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in RAW_FIELDS])


def flag_predicates() -> dict[str, Column]:
    """Gold flag name -> boolean predicate over the joined gold row.

    The predicates use three-valued logic exactly like ``CASE WHEN p THEN 1
    ELSE 0``: a NULL predicate falls to 0.
    """
    c = F.col
    preds = {
        "complaint_count": F.lit(True),
        "timely_response_count": c("timely_response") == F.lit(True),
        "not_timely_response_count": c("timely_response") == F.lit(False),
        "known_timeliness_count": c("timely_response").isNotNull(),
        "unknown_timeliness_count": c("timely_response").isNull(),
        "narrative_count": c("has_narrative"),
    }
    for flag, label in OUTCOMES.items():
        preds[flag] = c("company_response") == F.lit(label)
    preds.update(
        {
            "unknown_response_outcome_count": c("company_response").isNull(),
            "public_response_available_count": c("company_public_response").isNotNull(),
            "missing_state_count": c("state").isNull(),
            "missing_zip_count": c("zip_code").isNull(),
            "missing_issue_count": c("issue").isNull(),
            "missing_sub_issue_count": c("sub_issue").isNull(),
            "sent_before_received_count": c("date_sent_to_company") < c("date_received"),
        }
    )
    assert list(preds) == FLAGS
    return preds


def metric_columns(columns: list[str] | None = None) -> list[str]:
    """Additive metrics are, by convention, every column ending ``_count``."""
    return [c for c in (columns if columns is not None else FLAGS) if c.endswith("_count")]


def metric_expressions() -> dict[str, Column]:
    """Governed metric catalogue: 18 sums, 4 ratios after aggregation, 1 distinct count."""
    exprs: dict[str, Column] = {name: F.sum(name) for name in FLAGS}
    for name, (num, den) in RATIOS.items():
        exprs[name] = ratio(F.sum(num), F.sum(den))
    exprs["company_count"] = F.count_distinct("company_name")
    return exprs


def ratio(numerator: Column, denominator: Column) -> Column:
    """Percentage after aggregation; a zero denominator yields NULL."""
    return F.lit(100.0) * numerator / F.nullif(denominator, F.lit(0))
