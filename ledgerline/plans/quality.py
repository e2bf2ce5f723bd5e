"""The model test suite (126 checks) as Spark jobs.

The suite is declared once as data (``SUITE``): generic ``not_null``,
``unique`` and ``relationships`` tests per model plus the singular
assertions.  ``run_suite`` evaluates it and returns ``check, failures``
rows; ``failures = 0`` is a pass.  All ``not_null`` tests of a model share
one scan; ``unique`` is a grouped count; ``relationships`` is an anti join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.quality import check_counts, duplicates, orphans
from ledgerline.plans import serving
from ledgerline.schema import FLAGS, OUTCOMES

# --- Fixed values that must equal the reference's --------------------------
# model -> (not_null columns, unique columns, {column: (parent model, parent column)})
SUITE: dict[str, tuple[list[str], list[str], dict[str, tuple[str, str]]]] = {
    "stg_complaints": (
        ["complaint_id", "company_name", "product", "submission_channel", "date_received",
         "date_sent_to_company", "timely_response"],
        ["complaint_id"],
        {},
    ),
    "companies": (["company_id"], ["company_id"], {}),
    "product_categories": (["product_category_id"], ["product_category_id"], {}),
    "issue_categories": (
        ["issue_category_id", "product_category_id"],
        ["issue_category_id"],
        {"product_category_id": ("product_categories", "product_category_id")},
    ),
    "submission_channels": (["submission_channel_id"], ["submission_channel_id"], {}),
    "complaints": (
        ["complaint_id", "company_id", "product_category_id", "issue_category_id",
         "submission_channel_id"],
        ["complaint_id"],
        {
            "company_id": ("companies", "company_id"),
            "product_category_id": ("product_categories", "product_category_id"),
            "issue_category_id": ("issue_categories", "issue_category_id"),
            "submission_channel_id": ("submission_channels", "submission_channel_id"),
        },
    ),
    "complaint_narratives": (
        ["complaint_id", "narrative"],
        ["complaint_id"],
        {"complaint_id": ("complaints", "complaint_id")},
    ),
    "tags": (["tag_id"], ["tag_id"], {}),
    "complaint_tags": (
        ["complaint_id", "tag_id"],
        [],
        {"complaint_id": ("complaints", "complaint_id"), "tag_id": ("tags", "tag_id")},
    ),
    "complaint_metrics": (
        ["complaint_id"] + FLAGS + ["date_received", "company_name", "product", "submission_channel"],
        ["complaint_id"],
        {},
    ),
    "narrative_search_documents": (["complaint_id", "narrative"], ["complaint_id"], {}),
    "dim_company": (["company_id"], ["company_id"], {}),
    "dim_product": (["product_category_id"], ["product_category_id"], {}),
    "dim_issue": (["issue_category_id"], ["issue_category_id"], {}),
    "dim_submission_channel": (["submission_channel_id"], ["submission_channel_id"], {}),
    "dim_geography": (["geography_id"], ["geography_id"], {}),
    "dim_response": (["response_id"], ["response_id"], {}),
    "dim_date": (["date_key"], ["date_key"], {}),
    "fact_complaints": (
        ["complaint_id", "company_id", "product_category_id", "issue_category_id",
         "submission_channel_id", "geography_id", "response_id", "received_date_key",
         "sent_date_key"] + FLAGS,
        ["complaint_id"],
        {
            "complaint_id": ("complaint_metrics", "complaint_id"),
            "company_id": ("dim_company", "company_id"),
            "product_category_id": ("dim_product", "product_category_id"),
            "issue_category_id": ("dim_issue", "issue_category_id"),
            "submission_channel_id": ("dim_submission_channel", "submission_channel_id"),
            "geography_id": ("dim_geography", "geography_id"),
            "response_id": ("dim_response", "response_id"),
            "received_date_key": ("dim_date", "date_key"),
            "sent_date_key": ("dim_date", "date_key"),
        },
    ),
}
# Row-preservation assertions: (name, model, model), row counts must match.
PRESERVES = [
    ("staging_preserves_rows", "bronze_complaints", "stg_complaints"),
    ("silver_preserves_complaints", "stg_complaints", "complaints"),
    ("gold_preserves_complaints", "complaints", "complaint_metrics"),
]
# --- end of fixed values ----------------------------------------------------

LAYERS = {
    "staging": ["stg_complaints"],
    "silver": ["companies", "product_categories", "issue_categories", "submission_channels",
               "complaints", "complaint_narratives", "tags", "complaint_tags"],
    "gold": ["complaint_metrics", "narrative_search_documents"],
    "star": ["dim_company", "dim_product", "dim_issue", "dim_submission_channel",
             "dim_geography", "dim_response", "dim_date", "fact_complaints"],
}


def _one(name: str, failures: DataFrame) -> DataFrame:
    return failures.select(F.lit(name).alias("check"), F.col("failures").cast("long"))


def _count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("failures"))


def generic_checks(w, model: str) -> list[DataFrame]:
    """Not-null and relationship checks of a model in one scan (each parent
    joins its distinct keys to the child's columns), and a grouped count per
    unique column."""
    not_null, unique, rels = SUITE[model]
    df = w[model]
    rows = df.select(*dict.fromkeys([*not_null, *rels]))
    checks = {f"not_null:{model}.{c}": F.col(c).isNull() for c in not_null}
    for k, (c, (parent, pc)) in enumerate(rels.items()):
        keys = w[parent].select(F.col(pc).alias(f"__parent{k}")).distinct()
        rows = rows.join(keys, F.col(c) == F.col(f"__parent{k}"), "left")
        checks[f"relationships:{model}.{c}->{parent}.{pc}"] = F.col(c).isNotNull() & F.col(f"__parent{k}").isNull()
    out = [check_counts(rows, checks)] if checks else []
    for c in unique:
        out.append(_one(f"unique:{model}.{c}", _count(duplicates(df.select(c), [c]))))
    return out


def flags_are_binary(metrics: DataFrame) -> DataFrame:
    bad = F.col("complaint_count") != 1
    for f in FLAGS[1:]:
        bad = bad | ~F.col(f).isin(0, 1)
    return metrics.filter(bad).select("complaint_id")


def flag_consistency(metrics: DataFrame) -> DataFrame:
    c = F.col
    outcomes = list(OUTCOMES) + ["unknown_response_outcome_count"]
    bad = (
        (c("timely_response_count") + c("not_timely_response_count") != c("known_timeliness_count"))
        | (c("known_timeliness_count") + c("unknown_timeliness_count") != 1)
        | (c("narrative_count") != F.when(c("has_narrative"), 1).otherwise(0))
        | (reduce(lambda a, b: a + b, [c(o) for o in outcomes]) != 1)
    )
    return metrics.filter(bad).select("complaint_id")


def product_issue_mismatch(complaints: DataFrame, issue_categories: DataFrame) -> DataFrame:
    """Complaints whose issue category sits under another product (JOIN-11)."""
    c, i = complaints.alias("c"), issue_categories.alias("i")
    return (
        c.join(i, F.col("c.issue_category_id") == F.col("i.issue_category_id"), "inner")
        .filter(F.col("c.product_category_id") != F.col("i.product_category_id"))
        .select("c.complaint_id")
    )


def _count_delta(a: DataFrame, b: DataFrame, where_b=None) -> DataFrame:
    """``|rows(a) - rows(b)|`` from one aggregate over the labelled union."""
    left = a.select(F.lit(1).alias("__side"))
    right = (b.filter(where_b) if where_b is not None else b).select(F.lit(2).alias("__side"))
    u = left.unionByName(right)
    return u.agg(
        F.abs(F.count_if(F.col("__side") == 1) - F.count_if(F.col("__side") == 2)).alias("failures")
    )


def star_matches_wide(fact: DataFrame, metrics: DataFrame) -> DataFrame:
    """Count of totals (rows + 18 flags) where star and wide differ, NULL-safe.

    One aggregate over the labelled union of both tables (no join)."""
    names = ["rows"] + FLAGS
    u = fact.select(F.lit("s").alias("__src"), F.lit(1).alias("rows"), *FLAGS).unionByName(
        metrics.select(F.lit("g").alias("__src"), F.lit(1).alias("rows"), *FLAGS)
    )
    sums = u.agg(
        *[F.sum(F.when(F.col("__src") == s, F.col(n))).alias(f"{s}_{n}") for n in names for s in ("s", "g")]
    )
    diff = sum(
        (F.when(~F.col(f"s_{n}").eqNullSafe(F.col(f"g_{n}")), 1).otherwise(0) for n in names), F.lit(0)
    )
    return sums.select(diff.cast("long").alias("failures"))


def singular_checks(w, layer: str) -> list[DataFrame]:
    out = []
    for name, a, b in PRESERVES:
        if name.startswith(layer):
            out.append(_one(name, _count_delta(w[a], w[b])))
    if layer == "silver":
        out.append(_one("silver_preserves_narratives",
                        _count_delta(w["complaint_narratives"], w["stg_complaints"], F.col("narrative").isNotNull())))
        out.append(_one("consistent_product_issue",
                        _count(product_issue_mismatch(w["complaints"], w["issue_categories"]))))
        out.append(_one("unique_complaint_tag_pairs",
                        _count(duplicates(w["complaint_tags"], ["complaint_id", "tag_id"]))))
    if layer == "gold":
        m = w["complaint_metrics"]
        narr = w["complaint_narratives"].select(F.lit(1).alias("__side"), F.lit(0).alias("n"))
        flagged = m.select(F.lit(2).alias("__side"), F.col("narrative_count").alias("n"))
        u = narr.unionByName(flagged).agg(
            F.abs(
                F.count_if(F.col("__side") == 1) - F.coalesce(F.sum(F.when(F.col("__side") == 2, F.col("n"))), F.lit(0))
            ).alias("failures")
        )
        out.append(_one("gold_preserves_narratives", u))
        out.append(_one("gold_flags_are_binary", _count(flags_are_binary(m))))
        out.append(_one("gold_flag_consistency", _count(flag_consistency(m))))
    if layer == "star":
        out.append(_one("star_matches_wide_gold", star_matches_wide(w["fact_complaints"], w["complaint_metrics"])))
    return out


def run_layer(w, layer: str) -> DataFrame:
    """``check, failures`` for every test of one layer."""
    parts = [df for model in LAYERS[layer] for df in generic_checks(w, model)]
    parts += singular_checks(w, layer)
    return reduce(DataFrame.unionByName, parts)


def run_suite(w) -> DataFrame:
    return reduce(DataFrame.unionByName, [run_layer(w, layer) for layer in LAYERS])


def grain_totals(w) -> DataFrame:
    """Grand totals of the gold table and of each serving grain: the exports
    reconcile when every row carries the same 18 sums (QA-14)."""
    parts = [serving.totals(w["complaint_metrics"]).select(F.lit("gold").alias("source"), "*")]
    for g in ("overview", "issues", "geography", "channels"):
        parts.append(serving.totals(w.grain(g)).select(F.lit(g).alias("source"), "*"))
    return reduce(DataFrame.unionByName, parts)
