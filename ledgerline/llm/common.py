"""Helpers shared by the training-data operators.

Every operator reads only the columns it needs, names them itself (so other
columns of the input can have any name) and cuts lineage either with a
reliable ``checkpoint()`` (narrow tables) or with a Parquet table in the
folder the cluster names in ``spark.checkpoint.dir`` (wide ones).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import ensure_checkpoint_dir, ship_package


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table of a data folder."""
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ready(spark: SparkSession) -> None:
    """Package on the workers, checkpoint folder set."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: an eager, reliable checkpoint in the shared folder."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ledgerline-llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucket_count(spark: SparkSession, total_bytes: int, bucket_bytes: int) -> int:
    """Buckets of about ``bucket_bytes`` for a stored table, no more than Spark
    allows a table to have: beyond that buckets hold more chunks each, which
    their tasks still take one by one."""
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total_bytes // bucket_bytes))
    return min(wanted, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")))


def text_or_empty(col: str = "text") -> Column:
    """A text column with null read as the empty string."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def sha256_text(col: Column) -> Column:
    """Lowercase hex SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(col.cast("binary"), 256)
