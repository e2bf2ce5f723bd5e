"""Data-quality operators: each returns a DataFrame of failures, so an empty
result is a pass and the failures themselves are inspectable.

The counting variants fold many checks into a single scan: one aggregate
with a ``count_if`` per check, unpivoted into (check, failures) rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_counts(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One scan: ``check, failures`` for each named failure predicate."""
    agg = df.agg(*[F.count_if(pred).alias(f"c{i}") for i, pred in enumerate(checks.values())])
    rows = [
        F.struct(F.lit(name).alias("check"), F.col(f"c{i}").alias("failures"))
        for i, name in enumerate(checks)
    ]
    return agg.select(F.explode(F.array(*rows)).alias("r")).select("r.check", "r.failures")


def not_null_counts(df: DataFrame, columns: list[str], prefix: str = "not_null") -> DataFrame:
    """NULL rows per column, in one scan (generic ``not_null`` tests)."""
    return check_counts(df, {f"{prefix}:{c}": F.col(c).isNull() for c in columns})


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values occurring more than once (generic ``unique`` test)."""
    return df.groupBy(*keys).count().filter(F.col("count") > 1)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str | None = None) -> DataFrame:
    """Child rows whose non-NULL key has no parent (``relationships`` test)."""
    parent_key = parent_key or child_key
    # an anti join is unaffected by repeated parent keys, so no distinct
    p = parent.select(F.col(parent_key).alias("__pk"))
    return child.filter(F.col(child_key).isNotNull()).join(
        p, F.col(child_key) == F.col("__pk"), "left_anti"
    )
