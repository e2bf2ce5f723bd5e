"""Governed metric query: a validated DataFrame builder over one serving grain.

Callers choose a grain, up to three dimensions (plus ``period``), one to
eight catalogue metrics, label filters and an order; the scope is always
applied.  Validation mirrors the reference's contract; the query itself is a
Catalyst plan (filter -> partial/final aggregate -> TakeOrderedAndProject).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.dates import bucket
from ledgerline.plans.scope import Scope, label_filter
from ledgerline.schema import DIMENSIONS, INTERVALS, metric_expressions

MAX_LIMIT, MAX_DIMS, MAX_FILTERS, MAX_METRICS, MAX_VALUES, MAX_LABEL = 50, 3, 8, 8, 20, 300


@dataclass(frozen=True)
class MetricRequest:
    dataset: str
    group_by: tuple[str, ...]
    metrics: tuple[str, ...]
    interval: str = "month"
    filters: tuple[tuple[str, tuple[str | None, ...]], ...] = ()
    start_date: str | None = None
    end_date: str | None = None
    order_by: str | None = None
    descending: bool = True
    limit: int = 10


def validate(req: MetricRequest, scope: Scope) -> list:
    """Raise ``ValueError`` for any request outside the contract; return the
    extra predicates (date narrowing, label filters) it implies."""
    catalogue = metric_expressions()
    if req.dataset not in DIMENSIONS or req.interval not in INTERVALS:
        raise ValueError("Unknown dataset or time interval.")
    if (
        not 1 <= req.limit <= MAX_LIMIT
        or len(req.group_by) > MAX_DIMS
        or len(req.filters) > MAX_FILTERS
        or not 1 <= len(req.metrics) <= MAX_METRICS
    ):
        raise ValueError("Query exceeds bounded dimensions, metrics, filters or result limit.")
    if len(set(req.group_by)) != len(req.group_by) or len(set(req.metrics)) != len(req.metrics):
        raise ValueError("Duplicate dimensions or metrics.")
    allowed = DIMENSIONS[req.dataset] + ["period"]
    if any(g not in allowed for g in req.group_by) or any(m not in catalogue for m in req.metrics):
        raise ValueError("Column or metric is not available in this grain.")
    if req.order_by not in list(req.group_by) + list(req.metrics):
        raise ValueError("Ordering must use a selected field.")
    preds = []
    for bound, op in ((req.start_date, ">="), (req.end_date, "<=")):
        if bound is not None:
            parsed = dt.date.fromisoformat(bound)
            if not scope.holds(parsed):
                raise ValueError("Requested dates are outside active filters.")
            col = F.col("date_received")
            preds.append(col >= F.lit(parsed) if op == ">=" else col <= F.lit(parsed))
    if req.start_date and req.end_date and req.start_date > req.end_date:
        raise ValueError("Start date exceeds end date.")
    for column, values in req.filters:
        if column not in DIMENSIONS[req.dataset] or not 1 <= len(values) <= MAX_VALUES:
            raise ValueError("Filter is unavailable or too large.")
        if any(v is not None and (not isinstance(v, str) or len(v) > MAX_LABEL) for v in values):
            raise ValueError("Invalid label filter.")
        preds.append(label_filter(column, list(values)))
    return preds


def query_metrics(grain: DataFrame, scope: Scope, req: MetricRequest) -> DataFrame:
    """Rows of the governed query plus a ``truncated`` flag (AGG-23, SRT-2/3).

    ``limit + 1`` rows are taken so truncation is detected without counting
    the full result; the bounded remainder (<= 51 rows) is then numbered.
    """
    preds = validate(req, scope)
    catalogue = metric_expressions()
    df = grain.filter(scope.predicate())
    for p in preds:
        df = df.filter(p)
    groups = [
        bucket(req.interval, "date_received").alias("period") if g == "period" else F.col(g)
        for g in req.group_by
    ]
    aggs = [catalogue[m].alias(m) for m in req.metrics]
    out = df.groupBy(*groups).agg(*aggs) if groups else df.agg(*aggs)
    first = F.col(req.order_by)
    order = [first.desc_nulls_last() if req.descending else first.asc_nulls_last()]
    order += [F.col(g).asc_nulls_last() for g in req.group_by if g != req.order_by]
    top = out.orderBy(*order).limit(req.limit + 1)
    w = Window.orderBy(*order)
    return (
        top.withColumn("__pos", F.row_number().over(w))
        .withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy()) > F.lit(req.limit))
        .filter(F.col("__pos") <= req.limit)
        .drop("__pos")
    )


def dataset_bounds(grain: DataFrame) -> DataFrame:
    """Snapshot coverage of a grain: first and last received date (AGG-24)."""
    return grain.agg(
        F.min("date_received").alias("first_date"), F.max("date_received").alias("last_date")
    )


def inspect_datasets(grain: DataFrame, scope: Scope) -> dict:
    """Coverage (one-row aggregate), grains, metric names and limits."""
    bounds = dataset_bounds(grain).first()
    return {
        "active_filters": scope,
        "snapshot_coverage": {"first_date": bounds["first_date"], "last_date": bounds["last_date"]},
        "grains": DIMENSIONS,
        "metrics": list(metric_expressions()),
        "limits": {
            "limit": MAX_LIMIT,
            "dimensions": MAX_DIMS,
            "filters": MAX_FILTERS,
            "metrics": MAX_METRICS,
            "values_per_filter": MAX_VALUES,
        },
    }
