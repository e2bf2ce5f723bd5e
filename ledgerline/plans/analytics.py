"""Dashboard analytics over a serving grain: KPIs, trends, ranks, shares,
outcome mix, locations and prior-period change.

All post-processing that the reference does in pandas (shares of the scope
total, the "other outcomes" remainder, prior-period change) stays in the
plan: scope totals are one-row aggregates joined back (a broadcast of one
row), never a driver round trip.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.dates import bucket
from ledgerline.operators.totals import attach_totals
from ledgerline.plans.scope import Scope
from ledgerline.schema import MISSING_LABEL, STATE_CODES, ratio


def _sum0(c: str) -> F.Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def headline(metrics: DataFrame, scope: Scope) -> DataFrame:
    """Complaints, timely, known, narratives, unknown and the two KPI rates (AGG-13)."""
    t = metrics.filter(scope.predicate()).agg(
        _sum0("complaint_count").alias("complaints"),
        _sum0("timely_response_count").alias("timely"),
        _sum0("known_timeliness_count").alias("known"),
        _sum0("narrative_count").alias("narratives"),
        _sum0("unknown_timeliness_count").alias("unknown"),
    )
    return t.select(
        "*",
        ratio(F.col("timely"), F.col("known")).alias("timely_rate_pct"),
        ratio(F.col("narratives"), F.col("complaints")).alias("narrative_coverage_pct"),
    )


def trend(metrics: DataFrame, scope: Scope, interval: str = "month") -> DataFrame:
    """Volume, narratives and coverage per received-date bucket (AGG-14)."""
    return (
        metrics.filter(scope.predicate())
        .groupBy(bucket(interval, "date_received").alias("period"))
        .agg(
            F.sum("complaint_count").alias("complaints"),
            F.sum("narrative_count").alias("narratives"),
        )
        .select("*", ratio(F.col("narratives"), F.col("complaints")).alias("coverage_pct"))
    )


def weekly_report(metrics: DataFrame, scope: Scope) -> DataFrame:
    """Weekly volume with timely-response rate and narrative coverage (AGG-28)."""
    return (
        metrics.filter(scope.predicate())
        .groupBy(bucket("week", "date_received").alias("week_start"))
        .agg(
            F.sum("complaint_count").alias("complaints"),
            ratio(F.sum("timely_response_count"), F.sum("known_timeliness_count")).alias(
                "timely_response_rate"
            ),
            ratio(F.sum("narrative_count"), F.sum("complaint_count")).alias("narrative_coverage"),
        )
    )


def rank(
    metrics: DataFrame,
    scope: Scope,
    column: str,
    limit: int | None = 10,
    extra=None,
) -> DataFrame:
    """Top ``limit`` labels (all with ``None``) by volume, ties by label; NULL
    -> 'Missing label' (AGG-15)."""
    df = metrics.filter(scope.predicate())
    if extra is not None:
        df = df.filter(extra)
    per = df.groupBy(F.coalesce(F.col(column), F.lit(MISSING_LABEL)).alias("category")).agg(
        F.sum("complaint_count").alias("complaints")
    )
    if limit is None:
        return per
    return per.orderBy(F.col("complaints").desc(), F.col("category").asc()).limit(limit)


def _scope_total(metrics: DataFrame, scope: Scope) -> DataFrame:
    return metrics.filter(scope.predicate()).agg(F.sum("complaint_count").alias("scope_total"))


def top_share(metrics: DataFrame, scope: Scope, column: str = "company_name", k: int = 5) -> DataFrame:
    """Share of the scope held by the top ``k`` labels (AGG-16)."""
    top = rank(metrics, scope, column, limit=k).agg(F.sum("complaints").alias("top_complaints"))
    return attach_totals(top, _scope_total(metrics, scope)).select(
        "top_complaints",
        "scope_total",
        (F.lit(100.0) * F.col("top_complaints") / F.col("scope_total")).alias("top_share_pct"),
    )


def company_comparison(metrics: DataFrame, scope: Scope) -> DataFrame:
    """Per company: volume, timely %, coverage % and share of the scope (AGG-17)."""
    per = (
        metrics.filter(scope.predicate())
        .groupBy(F.coalesce(F.col("company_name"), F.lit(MISSING_LABEL)).alias("company"))
        .agg(
            F.sum("complaint_count").alias("complaints"),
            ratio(F.sum("timely_response_count"), F.sum("known_timeliness_count")).alias(
                "timely_rate_pct"
            ),
            ratio(F.sum("narrative_count"), F.sum("complaint_count")).alias(
                "narrative_coverage_pct"
            ),
        )
    )
    return attach_totals(per, _scope_total(metrics, scope)).select(
        "company",
        "complaints",
        "timely_rate_pct",
        "narrative_coverage_pct",
        (F.lit(100.0) * F.col("complaints") / F.col("scope_total")).alias("complaint_share_pct"),
    )


def product_share(metrics: DataFrame, scope: Scope) -> DataFrame:
    """Every product with its share of the scope (AGG-18)."""
    return (
        attach_totals(rank(metrics, scope, "product", limit=None), _scope_total(metrics, scope))
        .select(
            "category",
            "complaints",
            (F.lit(100.0) * F.col("complaints") / F.col("scope_total")).alias("share_pct"),
        )
    )


# --- fixed values: outcome labels of the dashboard -----------------------------
OUTCOME_ROWS = [
    ("Closed with explanation", "closed_with_explanation_count"),
    ("Monetary relief", "monetary_relief_count"),
    ("Non-monetary relief", "non_monetary_relief_count"),
    ("In progress", "in_progress_count"),
    ("Untimely response outcome", "untimely_response_outcome_count"),
    ("Missing outcome", "unknown_response_outcome_count"),
]
OTHER_OUTCOMES = "Other outcomes"
# --- end of fixed values ---------------------------------------------------------


def outcome_mix(metrics: DataFrame, scope: Scope) -> DataFrame:
    """Six recorded outcomes plus 'Other outcomes' = max(0, total - their sum),
    each with its share of the scope, as a long table (AGG-19)."""
    wide = metrics.filter(scope.predicate()).agg(
        _sum0("complaint_count").alias("total"),
        *[_sum0(flag).alias(f"o{i}") for i, (_, flag) in enumerate(OUTCOME_ROWS)],
    )
    listed = sum((F.col(f"o{i}") for i in range(len(OUTCOME_ROWS))), F.lit(0))
    rows = [
        F.struct(F.lit(i).alias("position"), F.lit(label).alias("outcome"), F.col(f"o{i}").alias("complaints"))
        for i, (label, _) in enumerate(OUTCOME_ROWS)
    ]
    rows.append(
        F.struct(
            F.lit(len(OUTCOME_ROWS)).alias("position"),
            F.lit(OTHER_OUTCOMES).alias("outcome"),
            F.greatest(F.lit(0).cast("long"), F.col("total") - listed).alias("complaints"),
        )
    )
    return wide.select(F.col("total"), F.explode(F.array(*rows)).alias("r")).select(
        "r.position",
        "r.outcome",
        "r.complaints",
        (F.lit(100.0) * F.col("r.complaints") / F.col("total")).alias("share_pct"),
    )


def response_rates(metrics: DataFrame, scope: Scope) -> DataFrame:
    """Not-timely rate, recorded relief share and missing outcomes (AGG-20)."""
    return metrics.filter(scope.predicate()).agg(
        ratio(F.sum("not_timely_response_count"), F.sum("known_timeliness_count")).alias(
            "not_timely_rate_pct"
        ),
        ratio(
            F.sum("monetary_relief_count") + F.sum("non_monetary_relief_count"),
            F.sum("complaint_count"),
        ).alias("relief_share_pct"),
        _sum0("unknown_response_outcome_count").alias("missing_outcomes"),
    )


def location_totals(geography: DataFrame, scope: Scope) -> DataFrame:
    """All locations split into the map allow-list (50 states + DC) and
    the rest, which stays in totals but off the map (AGG-21, FLT-9)."""
    states = rank(geography, scope, "state", limit=None)
    mapped = F.col("category").isin(*STATE_CODES)
    return states.agg(
        _sum0_expr(F.when(mapped, F.col("complaints"))).alias("mapped_complaints"),
        _sum0_expr(F.when(~mapped, F.col("complaints"))).alias("omitted_complaints"),
        F.count_if(mapped).alias("mapped_locations"),
        F.count_if(~mapped).alias("omitted_locations"),
    )


def _sum0_expr(c: F.Column) -> F.Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def prior_period(metrics: DataFrame, scope: Scope, coverage_start: dt.date | None = None) -> DataFrame:
    """Scope volume against the equal-length window just before it (AGG-22).

    One scan with two conditional sums.  The comparison is available only
    when the whole prior window lies inside coverage; ``coverage_start``
    defaults to the grain's first received date (a one-row aggregate).
    """
    prior = scope.prior()
    labels = scope.labels_predicate()
    cur = labels & scope.dates_predicate()
    pre = labels & prior.dates_predicate()
    # one pass: both windows and the coverage start are conditional aggregates
    sums = metrics.agg(
        _sum0_expr(F.when(cur, F.col("complaint_count"))).alias("current_complaints"),
        _sum0_expr(F.when(pre, F.col("complaint_count"))).alias("previous_complaints"),
        (F.min("date_received") if coverage_start is None else F.lit(coverage_start)).alias("coverage_start"),
    )
    available = F.lit(prior.start) >= F.col("coverage_start")
    return sums.select(
        F.lit(prior.start).alias("prior_start"),
        F.lit(prior.end).alias("prior_end"),
        available.alias("available"),
        "current_complaints",
        F.when(available, F.col("previous_complaints")).alias("previous_complaints"),
        F.when(
            available & (F.col("previous_complaints") != 0),
            F.lit(100.0) * (F.col("current_complaints") / F.col("previous_complaints") - F.lit(1.0)),
        ).alias("change_pct"),
    )


def filter_options(metrics: DataFrame, column: str, products: tuple[str, ...] = ()) -> DataFrame:
    """Distinct non-NULL labels, sorted; sub-products cascade on products (FLT-10)."""
    df = metrics
    if products:
        df = df.filter(F.col("product").isin(*products))
    return df.filter(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def issue_drilldown(issues: DataFrame, scope: Scope, issue: str | None, column: str = "sub_issue") -> DataFrame:
    """Rank of ``column`` inside one issue (equality drill-down, FLT-6)."""
    extra = F.col("issue") == F.lit(issue) if issue is not None else None
    return rank(issues, scope, column, extra=extra)
