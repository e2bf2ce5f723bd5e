"""The model graph: every layer as a named, memoised DataFrame.

``Warehouse`` wires bronze -> staging -> silver -> gold -> star -> serving.
Staging models are views (lazy); the others may be *materialised* as
Parquet tables in the shared checkpoint folder, which cuts lineage the way
the reference's table models do and lets the analytical queries read a
pre-aggregated grain instead of recomputing the whole graph.  A lost
executor then only recomputes from the last written table.
"""

from __future__ import annotations

import hashlib
import threading
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ledgerline.plans import bronze as B
from ledgerline.plans import gold as G
from ledgerline.plans import serving as S
from ledgerline.plans import silver as SV
from ledgerline.plans import staging as ST
from ledgerline.plans import star as SR
from ledgerline.session import drop_table, file_status, freed_shuffles, shared_path, ship_package

# Views are recomputed from their (stored) inputs on read: the staging models
# and the pure projections of stored tables.
VIEWS = {
    "stg_complaints",
    "stg_complaints_keyed",
    "stg_complaint_tags",
    "narrative_search_documents",
    "dim_company",
    "dim_product",
    "dim_submission_channel",
    "grain_overview",
    "grain_issues",
    "grain_geography",
    "grain_channels",
}
PARTITIONED = {"grains": "grain"}


class Warehouse:
    """Lazily built, optionally materialised model graph over one input."""

    def __init__(
        self,
        spark: SparkSession,
        incoming: Callable[[], DataFrame],
        store: str | None = None,
        bronze: DataFrame | None = None,
        buckets: int | None = None,
        steps: list[DataFrame] | None = None,
    ):
        """``bronze`` stands in for the dedup of ``incoming`` where its rows are
        known to be one per complaint.  With ``buckets``, stored raw rows lie in
        so many buckets of their trimmed ID, as ``incoming`` should be partitioned.
        ``steps`` is the list to which ``incoming`` adds the tables it stores on its
        way; they are dropped once its rows are stored."""
        self.spark = spark
        self._incoming = incoming
        self.store = store
        self._buckets = buckets
        self._steps = [] if steps is None else steps
        self._bucketed: dict[str, DataFrame] = {}
        self._tables: dict[str, DataFrame] = {}
        self._locks: dict[str, threading.Lock] = {}
        self._guard = threading.Lock()
        self._builders: dict[str, Callable[[], DataFrame]] = {
            "incoming": self._incoming,
            "bronze_complaints": lambda: B.dedup_latest(self._raw()) if bronze is None else bronze,
            "stg_complaints": lambda: ST.stg_complaints(self["bronze_complaints"]),
            "stg_complaints_keyed": lambda: ST.stg_complaints_keyed(self["stg_complaints"]),
            "stg_complaint_tags": lambda: ST.stg_complaint_tags(self["stg_complaints"]),
            "companies": lambda: SV.companies(self["stg_complaints_keyed"]),
            "product_categories": lambda: SV.product_categories(self["stg_complaints_keyed"]),
            "issue_categories": lambda: SV.issue_categories(self["stg_complaints_keyed"]),
            "submission_channels": lambda: SV.submission_channels(self["stg_complaints_keyed"]),
            "complaints": lambda: SV.complaints(self["stg_complaints_keyed"]),
            "complaint_narratives": lambda: SV.complaint_narratives(self["stg_complaints"]),
            "tags": lambda: SV.tags(self["stg_complaint_tags"]),
            "complaint_tags": lambda: SV.complaint_tags(self["stg_complaint_tags"]),
            "complaint_metrics": lambda: G.complaint_metrics(
                self["complaints"],
                self["companies"],
                self["product_categories"],
                self["issue_categories"],
                self["submission_channels"],
            ),
            "narrative_search_documents": lambda: G.narrative_search_documents(
                self["complaint_metrics"], self["complaint_narratives"]
            ),
            "dim_company": lambda: SR.dim_company(self["companies"]),
            "dim_product": lambda: SR.dim_product(self["product_categories"]),
            "dim_submission_channel": lambda: SR.dim_submission_channel(
                self["submission_channels"]
            ),
            "dim_issue": lambda: SR.dim_issue(
                self["issue_categories"], self["product_categories"]
            ),
            "dim_geography": lambda: SR.dim_geography(self["complaint_metrics"]),
            "dim_response": lambda: SR.dim_response(self["complaint_metrics"]),
            "dim_date": lambda: SR.dim_date(self["complaint_metrics"]),
            "fact_complaints": lambda: SR.fact_complaints(self["complaint_metrics"]),
            "grains": self._grains,
            "grain_overview": lambda: self._split("overview"),
            "grain_issues": lambda: self._split("issues"),
            "grain_geography": lambda: self._split("geography"),
            "grain_channels": lambda: self._split("channels"),
        }

    def _raw(self) -> DataFrame:
        """The raw rows, with their key where they are bucketed by it."""
        plain = self["incoming"]
        return self._bucketed.get("incoming", plain)

    def _grains(self) -> DataFrame:
        metrics = self["complaint_metrics"]
        # rows of a stored table are counted from its files' footers
        return S.all_grains(metrics, S.task_count(metrics.count()) if self.store else None)

    def _split(self, name: str) -> DataFrame:
        from ledgerline.schema import metric_columns

        return S.split_grain(self["grains"], name, metric_columns(self["complaint_metrics"].columns))

    def __getitem__(self, name: str) -> DataFrame:
        if name in self._tables:
            return self._tables[name]
        # one lock per model; models only wait on their (acyclic) inputs,
        # so concurrent builds cannot deadlock
        with self._guard:
            lock = self._locks.setdefault(name, threading.Lock())
        with lock:
            if name not in self._tables:
                build = self._builders[name]
                self._tables[name] = self._materialise(name, build) if self.store and name not in VIEWS else build()
        return self._tables[name]

    def built(self, name: str) -> DataFrame:
        """A model from its inputs, neither memoised nor stored."""
        return self._builders[name]()

    def build(self, names: list[str] | None = None, threads: int = 4) -> dict[str, DataFrame]:
        """Build (and store) models concurrently, like a DAG runner with
        ``threads`` workers: independent models become concurrent Spark jobs
        that share the cluster, dependent ones wait for their inputs."""
        from concurrent.futures import ThreadPoolExecutor

        names = names or self.names()
        with ThreadPoolExecutor(max_workers=max(1, threads)) as pool:
            return dict(zip(names, pool.map(self.__getitem__, names)))

    def memo(self, name: str, build: Callable[[], object]) -> object:
        """Build ``name`` once per warehouse, even under concurrent callers."""
        if name in self._tables:
            return self._tables[name]
        with self._guard:
            lock = self._locks.setdefault(name, threading.Lock())
        with lock:
            if name not in self._tables:
                self._tables[name] = build()
        return self._tables[name]

    def derived(self, name: str, build: Callable[[], DataFrame], materialise: bool = True) -> DataFrame:
        """Memoise (and optionally store) a table derived from the models,
        such as the published evidence sample."""
        def make() -> DataFrame:
            return self._materialise(name, build) if self.store and materialise else build()

        return self.memo(name, make)

    def names(self) -> list[str]:
        return list(self._builders)

    def grain(self, dataset: str) -> DataFrame:
        return self[f"grain_{dataset}"]

    def _materialise(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """Build and write once (a ``_SUCCESS`` marker proves a complete write),
        then read the table back so later plans start from the stored files."""
        path = f"{self.store.rstrip('/')}/{name}"
        if not _complete(self.spark, path):
            df = build()
            bucketed = name == "incoming" and self._buckets is not None
            writer = (B.with_key(df) if bucketed else df).write.mode("overwrite").option("compression", "zstd")
            if name in PARTITIONED:
                writer = writer.partitionBy(PARTITIONED[name])
            table = f"ledgerline_{name}_{uuid.uuid4().hex}"
            with freed_shuffles(self.spark):
                if bucketed:
                    writer.bucketBy(self._buckets, B.KEY).option("path", path).format("parquet").saveAsTable(table)
                else:
                    writer.parquet(path)
            if bucketed:
                self._bucketed[name] = self.spark.table(table)
            if name == "incoming":
                while self._steps:
                    drop_table(self._steps.pop())
        # in a later session there is no table of the buckets: the same rows, to be shuffled
        return self.spark.read.parquet(path).drop(B.KEY)


def _complete(spark: SparkSession, path: str) -> bool:
    return bool(file_status(spark, f"{path}/_SUCCESS"))


def _source_fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Identity of the input files and of this package's model code."""
    h = hashlib.sha256(sf_dir.encode())
    for found in file_status(spark, f"{sf_dir}/*.parquet") + file_status(spark, f"{sf_dir}/*.parquet/*"):
        h.update(repr(found).encode())
    pkg = Path(__file__).resolve().parents[1]
    for p in sorted(pkg.rglob("*.py")):
        if p.relative_to(pkg).parts[0] != "llm":
            h.update(p.read_bytes())
    return h.hexdigest()[:20]


_CACHE: dict[tuple[str, str, bool], Warehouse] = {}
_CACHE_LOCK = threading.Lock()


def for_testdata(spark: SparkSession, sf_dir: str, materialise: bool = True) -> Warehouse:
    """The warehouse over the driver's tables, memoised per session and input.

    Tables are stored under the shared ``spark.checkpoint.dir`` unless
    ``materialise`` is false; that argument alone decides.
    """
    ship_package(spark)
    key = (spark.sparkContext.applicationId, sf_dir, materialise)
    with _CACHE_LOCK:
        return _cached(spark, sf_dir, materialise, key)


def _cached(spark: SparkSession, sf_dir: str, materialise: bool, key) -> Warehouse:
    from ledgerline.sources import testdata

    if key not in _CACHE:
        store = shared_path(spark, "ledgerline-warehouse", _source_fingerprint(spark, sf_dir)) if materialise else None
        buckets = testdata.bucket_count(spark, sf_dir) if materialise else None
        steps: list[DataFrame] | None = [] if materialise else None
        _CACHE[key] = Warehouse(spark, lambda: testdata.incoming(spark, sf_dir, buckets, steps), store, buckets=buckets, steps=steps)
    return _CACHE[key]
