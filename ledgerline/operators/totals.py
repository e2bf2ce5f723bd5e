"""Attaching global totals to rows.

A global aggregate (``df.agg(...)`` with no grouping keys) always yields
exactly one row, so joining it to a frame adds columns without multiplying
rows.  ``attach_totals`` broadcasts that single row to every task; it is
the only cartesian-shaped join in the package and it is never used with a
side that could have more than one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_totals(df: DataFrame, totals: DataFrame) -> DataFrame:
    """``df`` with the columns of the one-row global aggregate ``totals``."""
    return df.crossJoin(F.broadcast(totals))
