"""NULL-safe composite surrogate keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def surrogate_key(*cols: Column | str) -> Column:
    """MD5 of the JSON list of the labels, e.g. ``md5('["a",null]')``.

    NULL components stay distinguishable from any text, and labels holding
    the delimiter cannot collide, because JSON quotes and escapes them.
    """
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.md5(F.to_json(F.array(*parts)))
