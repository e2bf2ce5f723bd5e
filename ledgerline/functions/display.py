"""Display helpers: compact K/M/B counts and percentage text as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compact_number(c: Column | str) -> Column:
    """12 -> '12', 12_345 -> '12K', 1_234_567 -> '1.23 M', 2e9 -> '2.00 B'."""
    v = (F.col(c) if isinstance(c, str) else c).cast("double")
    a = F.abs(v)
    thousands = F.bround(v / 1000.0, 0)
    return (
        F.when(a >= 1e9, F.format_string("%.2f B", v / 1e9))
        .when(a >= 1e6, F.format_string("%.2f M", v / 1e6))
        .when((a >= 1e3) & (thousands >= 1000), F.format_string("%.2f M", v / 1e6))
        .when(a >= 1e3, F.format_string("%.0fK", thousands))
        .otherwise(F.format_string("%.0f", F.bround(v, 0)))
    )


def percent_text(numerator: Column | str, denominator: Column | str) -> Column:
    """'12.34%' or 'N/A' when the denominator is zero or NULL."""
    n = F.col(numerator) if isinstance(numerator, str) else numerator
    d = F.col(denominator) if isinstance(denominator, str) else denominator
    return F.when(
        F.coalesce(d, F.lit(0)) != 0, F.format_string("%.2f%%", F.lit(100.0) * n / d)
    ).otherwise(F.lit("N/A"))
