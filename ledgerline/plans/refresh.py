"""One batch refresh: from raw archives to a published, reconciled release."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import SparkSession

from ledgerline.plans import bronze, narratives, quality
from ledgerline.plans.warehouse import Warehouse
from ledgerline.schema import GRAINS
from ledgerline.session import shared_path
from ledgerline.sources import raw, sinks

SIZE_LIMIT = 90 * 1024**2


def refresh(
    spark: SparkSession,
    sources: list[tuple[str, str, int]],
    start: dt.date,
    end: dt.date,
    publish: str,
    ingested_at: str,
    fmt: str = "csv",
    evidence_rows: int = 60_000,
    size_limit: int | None = SIZE_LIMIT,
) -> dict:
    """Run every step in order and return the release manifest.

    Gates, each of which stops the release: required columns, dates and IDs
    of all sources, a window that retains rows, no row outside the window
    after the build, the quality suite, export totals equal to gold's, every
    export below ``size_limit`` (``None`` lifts it), and evidence that
    reconciles with the overview.  ``publish`` must be shared storage.
    """
    incoming = raw.ingest(spark, sources, start, end, ingested_at, fmt)
    w = Warehouse(spark, lambda: incoming, shared_path(spark, "ledgerline-refresh", uuid.uuid4().hex))
    w._tables["incoming"] = w.derived("incoming_rows", lambda: incoming)  # read the archives once
    metrics = w["complaint_metrics"]
    if bronze.rows_outside_window(metrics, start, end).first()["outside"]:
        raise ValueError("The build holds rows outside the retention window")
    for layer in quality.LAYERS:
        failed = quality.run_layer(w, layer).filter("failures > 0").collect()
        if failed:
            raise ValueError(f"Quality checks failed: {[r['check'] for r in failed]}")
    grains = {name: w.grain(name) for name in GRAINS}
    sinks.export_grains(metrics, grains, publish, limit_bytes=size_limit)
    evidence = narratives.evidence_export(
        metrics, w["complaint_narratives"], w.grain("overview"), evidence_rows, exported_at=ingested_at
    )
    sinks.write_parquet_verified(evidence, f"{publish.rstrip('/')}/evidence")
    overlap = incoming.count() - metrics.count()
    exports = {name: f"{publish.rstrip('/')}/{name}" for name in [*grains, "evidence"]}
    return sinks.release_manifest(spark, metrics, exports, start, end, overlap)
