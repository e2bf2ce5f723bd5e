"""Raw complaint exports: scanning, entry gates and provenance.

CSV exports are read as all-string columns named by their header (no
inference), so identifiers and ZIP codes keep leading zeros and masks.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.dates import parse_mixed_date
from ledgerline.functions.text import SPACE_CLASS
from ledgerline.schema import RAW_FIELDS
from ledgerline.sources.csv_ranges import read_csv_numbered


def read_csv(spark: SparkSession, paths: list[str] | str, encoding: str = "UTF-8") -> DataFrame:
    """All-string scan of CSV exports with quoted multi-line fields (SRC-2).

    Spark reads empty and quoted-empty fields as NULL; the raw layer keeps
    them as '' like the source, so string columns are coalesced back.
    """
    df = (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("encoding", encoding)
        .option("inferSchema", False)
        .csv(paths)
    )
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def read_parquet(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Scan many Parquet parts with columns aligned by name (SRC-1)."""
    return spark.read.option("mergeSchema", True).parquet(*([paths] if isinstance(paths, str) else paths))


def require_columns(df: DataFrame, required: list[str] = RAW_FIELDS) -> DataFrame:
    """Fail unless every required field is present (SRC-3)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Required source columns changed: missing {missing}")
    return df


def validity_counts(df: DataFrame, *more) -> DataFrame:
    """One scan: unparseable received dates and complaint IDs of white space
    only, tabs and line ends included (SRC-4)."""
    return df.agg(
        F.count_if(parse_mixed_date(F.col("`Date received`")).isNull()).alias("unparsed_dates"),
        F.count_if(F.regexp_replace(F.coalesce(F.col("`Complaint ID`"), F.lit("")), SPACE_CLASS, "") == "").alias("blank_ids"),
        *more,
    )


def validate(df: DataFrame, *more) -> dict:
    """Abort the whole run on any invalid row, before retention filtering;
    returns the counts, with ``more`` aggregates from the same scan."""
    counts = validity_counts(df, *more).first().asDict()
    if counts["unparsed_dates"] or counts["blank_ids"]:
        raise ValueError("Source has invalid dates or missing complaint IDs")
    return counts


def with_record_numbers(df: DataFrame, file_col: str = "_source_file") -> DataFrame:
    """1-based logical record number per source file (SRC-5, WIN-3).

    ``file_col`` must hold the full path: files of the same name in different
    folders are different files.  :func:`read_csv` gives a multi-line file to
    one task, which reads it whole and in order; counting rows per file inside each
    task is therefore the record number.  This runs as an Arrow-batched
    ``mapInPandas`` over the scan: no shuffle, no sort, and the counter is
    evaluated exactly once.  Batch intake reads CSV in byte ranges
    (``csv_ranges.read_csv_numbered``); for Parquet, whose files are split too,
    use :func:`parquet_record_number`.
    """
    from ledgerline.session import ship_package

    ship_package(df.sparkSession)
    schema = T.StructType(df.schema.fields + [T.StructField("_source_record_number", T.LongType())])

    def number(batches):
        seen: dict[str, int] = {}
        for pdf in batches:
            files = pdf[file_col]
            base = files.map(lambda f: seen.get(f, 0))
            pdf["_source_record_number"] = base + pdf.groupby(file_col, sort=False).cumcount() + 1
            for f, n in files.value_counts().items():
                seen[f] = seen.get(f, 0) + int(n)
            yield pdf

    return df.mapInPandas(number, schema)


def parquet_record_number():
    """Record number of a Parquet row: its stored position in the file, the
    same however the file is split among tasks."""
    return (F.col("_metadata.row_index") + 1).alias("_source_record_number")


def ingest(
    spark: SparkSession,
    sources: list[tuple[str, str, int]],
    start: dt.date,
    end: dt.date,
    ingested_at: str,
    fmt: str = "csv",
) -> DataFrame:
    """Validated, provenance-tagged, retention-filtered rows of every source
    (SRC-2..5, FLT-1): ``sources`` is ``(path, archive name, priority)``.

    All sources are validated in one aggregate before any row is filtered; a
    window that retains no row is an error, as nothing could be published.
    """
    parts, gates = [], []
    for path, archive, priority in sources:
        columns = [F.col(f"`{c}`") for c in RAW_FIELDS]
        if fmt == "csv":
            raw = require_columns(read_csv_numbered(spark, path))
            numbered = raw.select(*columns, "_source_file", "_source_record_number")
        else:
            raw = require_columns(read_parquet(spark, path))
            numbered = raw.select(*columns, F.col("_metadata.file_path").alias("_source_file"), parquet_record_number())
        gates.append(raw.select("Date received", "Complaint ID"))
        parts.append(
            numbered.withColumn("_source_csv", F.regexp_extract("_source_file", r"([^/]+)$", 1))
            .drop("_source_file")
            .withColumn("_source_archive", F.lit(archive))
            .withColumn("_ingested_at", F.lit(ingested_at))
            .withColumn("_source_priority", F.lit(priority))
        )
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    d = parse_mixed_date(F.col("`Date received`"))
    retained = (d >= F.lit(start)) & (d < F.lit(end))
    rows = reduce(DataFrame.union, gates)
    if validate(rows, F.count_if(retained).alias("retained"))["retained"] == 0:
        raise ValueError("No source row falls into the retention window")
    return df.filter(retained)
