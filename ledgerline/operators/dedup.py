"""Keep-one-row-per-key operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """Keep, for each ``key``, the row that sorts first by ``order``.

    ``row_number() = 1`` is planned as a WindowGroupLimit: each map task keeps
    only its best row per key *before* the shuffle, so a key holding a third
    of all rows reaches the reducer as one row per map task, not as a third
    of the data.
    """
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")


def repeated_keys(df: DataFrame, key: Column) -> DataFrame:
    """``__key``: the keys (NULL is one) that several rows have.  Only the key
    is shuffled, so a caller can spare rows that no other row competes with the
    wide shuffle of :func:`latest_per_key`."""
    return df.select(key.alias("__key")).groupBy("__key").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__key")
