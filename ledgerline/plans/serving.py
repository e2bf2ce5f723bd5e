"""Serving grains, grand totals and their reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.schema import BASE_FIELDS, GRAINS, metric_columns


def grain(metrics: DataFrame, name: str) -> DataFrame:
    """Pre-aggregate the gold table to one serving grain (AGG-2a..d).

    Group keys are the six base fields plus the grain's extras; NULL groups
    are kept.  Partial (map-side) aggregation runs before the shuffle, so
    each task sends at most one row per group it saw.
    """
    keys = BASE_FIELDS + GRAINS[name]
    sums = [F.sum(c).alias(c) for c in metric_columns(metrics.columns)]
    return metrics.groupBy(*keys).agg(*sums)


GRAIN_COLUMN = "grain"


#: Gold rows aggregated by one task, about: four grains of them, twice, in memory.
TASK_ROWS = 50_000


def all_grains(metrics: DataFrame, partitions: int | None = None) -> DataFrame:
    """Every serving grain from one scan of the gold table (AGG-2a..d).

    Each grain's groups lie within one combination of the base fields, so the
    narrow gold rows are shuffled once by those fields and repeated per grain
    only behind the shuffle; nothing is aggregated before it, as groups are
    hardly fewer than rows.  A grain's unused keys are NULL; its name keeps
    genuine NULL keys distinct from them.  ``grain(all_grains(m), name)``
    equals ``grain(m, name)``.  ``partitions`` (see :func:`task_count`) bounds
    the groups that one task holds; without it the planner decides.
    """
    names = metric_columns(metrics.columns)
    extras = [c for name in GRAINS for c in GRAINS[name]]
    narrow = metrics.select(*BASE_FIELDS, *extras, *names)
    met = narrow.repartition(*BASE_FIELDS) if partitions is None else narrow.repartition(partitions, *BASE_FIELDS)
    each = met.withColumn(GRAIN_COLUMN, F.explode(F.array(*[F.lit(name) for name in GRAINS])))
    owner = {c: name for name in GRAINS for c in GRAINS[name]}
    masked = [F.when(F.col(GRAIN_COLUMN) == owner[c], F.col(c)).alias(c) for c in extras]
    keys = [GRAIN_COLUMN, *BASE_FIELDS, *extras]
    return each.select(GRAIN_COLUMN, *BASE_FIELDS, *masked, *names).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names])


def task_count(rows: int) -> int:
    """Partitions for ``rows`` gold rows (see :func:`all_grains`)."""
    return max(1, -(-rows // TASK_ROWS))


def split_grain(grains: DataFrame, name: str, metric_names: list[str]) -> DataFrame:
    """One grain out of ``all_grains`` (a partition filter once stored)."""
    return grains.filter(F.col(GRAIN_COLUMN) == F.lit(name)).select(
        *(BASE_FIELDS + GRAINS[name]), *metric_names
    )


def totals(df: DataFrame) -> DataFrame:
    """Grand totals of every additive ``_count`` column (AGG-1), one row."""
    return df.agg(*[F.sum(c).alias(c) for c in metric_columns(df.columns)])


def reconcile(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Metric names whose totals differ (NULL-safe); empty means reconciled.

    Both inputs are labelled and unioned, so one aggregate computes the two
    sets of totals side by side (no join)."""
    names = metric_columns(expected.columns)
    both = expected.select(F.lit("e").alias("__src"), *names).unionByName(
        actual.select(F.lit("a").alias("__src"), *names)
    )
    sums = both.agg(
        *[F.sum(F.when(F.col("__src") == s, F.col(n))).alias(f"{s}_{n}") for n in names for s in ("e", "a")]
    )
    diffs = F.array(
        *[F.when(~F.col(f"e_{n}").eqNullSafe(F.col(f"a_{n}")), F.lit(n)) for n in names]
    )
    return sums.select(F.explode(F.array_compact(diffs)).alias("metric"))
