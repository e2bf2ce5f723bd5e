"""Sinks: verified ZSTD Parquet tables, grain exports with reconciliation,
exact-value CSV reports, size guards and the release manifest."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerline.plans import serving
from ledgerline.schema import metric_columns


def write_parquet_verified(df: DataFrame, path: str, expected_rows: int | None = None, mode: str = "overwrite") -> DataFrame:
    """Write ZSTD Parquet, re-read and check the row count (SRC-6).

    The count is taken from the written files, so the check proves what
    landed on storage; ``expected_rows`` defaults to the rows that the
    writing job itself observed, so the source is computed once. Rows
    already there count too when ``mode`` appends. Returns the re-read
    table."""
    before = _rows_at(df.sparkSession, path) if mode == "append" else 0
    written = Observation()
    df.observe(written, F.count(F.lit(1)).alias("rows")).write.mode(mode).option("compression", "zstd").parquet(path)
    expected = before + written.get["rows"] if expected_rows is None else expected_rows
    back = df.sparkSession.read.parquet(path)
    if back.count() != expected:
        raise ValueError(f"Written rows differ from the source rows at {path}")
    return back


def _rows_at(spark: SparkSession, path: str) -> int:
    """Rows of a written table, none where there is no table yet."""
    try:
        return spark.read.parquet(path).count()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0


def export_grains(
    metrics: DataFrame, grains: dict[str, DataFrame], base: str, limit_bytes: int | None = None
) -> dict[str, DataFrame]:
    """Write every serving grain (SRC-7) and reconcile each file's 18 totals
    with the gold table's (QA-14); any difference blocks the release, and so
    does a written grain of ``limit_bytes`` or more, if given (QA-19).

    The gold totals are one aggregate row computed once; each written file
    is summed from storage."""
    names = metric_columns(metrics.columns)
    expected = serving.totals(metrics).first()
    out = {}
    for name, grain in grains.items():
        path = f"{base.rstrip('/')}/{name}"
        grain.write.mode("overwrite").option("compression", "zstd").parquet(path)
        back = grain.sparkSession.read.parquet(path)
        actual = serving.totals(back).first()
        if any(expected[n] != actual[n] for n in names):
            raise ValueError(f"Metric totals differ in {name}")
        if limit_bytes is not None:
            size_guard(grain.sparkSession, path, limit_bytes)
        out[name] = back
    return out


def export_grain(metrics: DataFrame, name: str, path: str) -> DataFrame:
    """Aggregate one serving grain from the gold table, write and reconcile it."""
    base, leaf = path.rstrip("/").rsplit("/", 1)
    return export_grains(metrics, {leaf: serving.grain(metrics, name)}, base)[leaf]


def write_csv(df: DataFrame, path: str) -> None:
    """Exact-value CSV report with a header (SRC-8)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def output_bytes(spark: SparkSession, path: str) -> int:
    """Total size of the data files of a written table (QA-19)."""
    return int(
        spark.read.format("binaryFile").load(path).filter(~F.col("path").rlike(r"/[._][^/]*$"))
        .agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    )


def size_guard(spark: SparkSession, path: str, limit_bytes: int = 90 * 1024**2) -> int:
    size = output_bytes(spark, path)
    if size >= limit_bytes:
        raise ValueError("Export exceeds the serving size guard")
    return size


def manifest(metrics: DataFrame, window_start=None, window_end=None) -> DataFrame:
    """Release manifest as one row (SRC-12): window, observed dates,
    complaint rows and every metric total, from a single aggregate."""
    names = metric_columns(metrics.columns)
    row = metrics.agg(
        F.min("date_received").alias("observed_first_date"),
        F.max("date_received").alias("observed_last_date"),
        F.count(F.lit(1)).alias("complaints"),
        *[F.sum(c).alias(c) for c in names],
    )
    return row.select(
        F.lit(window_start).cast("date").alias("window_start"),
        F.lit(window_end).cast("date").alias("window_end_exclusive"),
        "*",
    )


def release_manifest(
    spark: SparkSession,
    metrics: DataFrame,
    exports: dict[str, str],
    window_start=None,
    window_end=None,
    overlap_records_removed: int | None = None,
) -> dict:
    """The release record (SRC-12) as a plain dict for a JSON file: window,
    observed dates, rows, every metric total, the overlap removed by the
    dedup and, per written export, its row count, bytes and an order-free
    content fingerprint (QA-16 compares that fingerprint later)."""
    from ledgerline.plans.narratives import fingerprint

    row = manifest(metrics, window_start, window_end).first().asDict()
    out = {
        "window_start": row.pop("window_start"),
        "window_end_exclusive": row.pop("window_end_exclusive"),
        "observed_first_date": row.pop("observed_first_date"),
        "observed_last_date": row.pop("observed_last_date"),
        "complaints": row.pop("complaints"),
        "metric_totals": {k: int(v) for k, v in row.items()},
        "exports": {},
    }
    if overlap_records_removed is not None:
        out["overlap_records_removed"] = int(overlap_records_removed)
    for name, path in exports.items():
        table = spark.read.parquet(path)
        out["exports"][name] = {
            "fingerprint": fingerprint(table).first()[0],
            "bytes": output_bytes(spark, path),
        }
    return out


def metric_names(df: DataFrame) -> list[str]:
    """Schema introspection: the additive metrics of a relation (SRC-11)."""
    return metric_columns(df.columns)


def register_views(spark: SparkSession, tables: dict[str, DataFrame]) -> list[str]:
    """Expose model DataFrames as named temporary views (SRC-13)."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return sorted(t.name for t in spark.catalog.listTables() if t.name in tables)
