"""Deterministic hash sampling.

``hash_sample`` returns exactly the ``n`` rows that sort first by
``(md5(id), id)`` without funnelling the whole input through one task: a
1-row count picks a hash-prefix threshold expected to pass about ``2n``
rows; the filter runs map-side; only the survivors (bounded by the
threshold, not by the data) reach the final ordered take.  If fewer than
``n`` rows pass, the threshold widens and the step repeats, so the result
is always exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH = "__md5"
PREFIX_HEX = 12  # 48 bits of the hash decide the threshold


def hash_order(id_col: str) -> list[Column]:
    return [F.md5(F.col(id_col)), F.col(id_col)]


def hash_sample(df: DataFrame, id_col: str, n: int, total: int | None = None) -> DataFrame:
    """The first ``n`` rows of ``df`` in ``md5(id), id`` order (ties by id)."""
    if n < 1:
        raise ValueError("sample size must be positive")
    keyed = df.withColumn(HASH, F.md5(F.col(id_col)))
    if total is None:
        total = df.count()
    if total <= n:
        return keyed.drop(HASH)
    span = 16**PREFIX_HEX
    fraction = min(1.0, (2.0 * n + 64.0) / total)
    while True:
        threshold = f"{min(span - 1, int(fraction * span)):0{PREFIX_HEX}x}"
        candidates = keyed.filter(F.substring(F.col(HASH), 1, PREFIX_HEX) < F.lit(threshold))
        passed = candidates.count() if fraction < 1.0 else total
        if passed >= n or fraction >= 1.0:
            break
        fraction = min(1.0, fraction * 4)
    source = candidates if fraction < 1.0 else keyed
    return source.orderBy(F.col(HASH), F.col(id_col)).limit(n).drop(HASH)
