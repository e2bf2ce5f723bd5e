"""SparkSession construction and shared-storage locations."""

from __future__ import annotations

import os
import tempfile
import threading
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Defaults that suit both a laptop run and a cluster; a cluster's own
# settings (given at submit time) win because ``getOrCreate`` keeps them.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "ledgerline", **conf: str) -> SparkSession:
    """Get or build a session with the package defaults applied."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names in ``spark.checkpoint.dir``, if any."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the configured checkpoint folder.  Only a ``local`` master (tests,
    a laptop) may go without one and gets a fresh folder; on a cluster a
    machine-local folder would be a different one on each executor."""
    configured = checkpoint_dir(spark)
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="ledgerline-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder (for written intermediate tables)."""
    return os.path.join(ensure_checkpoint_dir(spark), *parts)


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_FREEING: dict[int, list] = {}  # by session: callers inside, the setting before the first
_FREEING_LOCK = threading.Lock()


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Shuffle files of the queries that run inside go when their query ends.
    Otherwise they stay until the driver happens to collect its garbage, so a
    chain of stored steps would hold the shuffles of all its steps on disk."""
    key = id(spark)
    with _FREEING_LOCK:
        if key not in _FREEING:
            _FREEING[key] = [0, spark.conf.get(FREE_SHUFFLES, None)]
            spark.conf.set(FREE_SHUFFLES, "true")
        _FREEING[key][0] += 1
    try:
        yield
    finally:
        with _FREEING_LOCK:
            _FREEING[key][0] -= 1
            if not _FREEING[key][0]:
                before = _FREEING.pop(key)[1]
                spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)


def shared_table(df, name: str):
    """Write ``df`` as Parquet in the shared folder and read it back: cuts
    lineage, and a lost executor takes nothing with it."""
    import uuid

    path = shared_path(df.sparkSession, "ledgerline-tables", f"{name}-{uuid.uuid4().hex}")
    with freed_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df) -> None:
    """Delete the files of a :func:`shared_table` that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def file_status(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """``(path, bytes, modification time)`` of what ``path`` (a glob) names, in
    whatever file system Spark reads it from; empty if it names nothing."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in found or [])


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``ledgerline`` importable in Python workers (``mapInPandas`` and
    RDD functions unpickle references to it): zip the package once per
    application and distribute it with ``addPyFile``, as ``--py-files``
    would on a cluster."""
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    archive = os.path.join(tempfile.mkdtemp(prefix="ledgerline-py-"), "ledgerline.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as zf:
        for folder, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(archive)
    _SHIPPED.add(key)
