"""Bronze and its serving grains kept up to date release by release (WIN-1,
FLT-1, AGG-2a..d, QA-14).

Bronze is stored by received month.  A release first meets the narrow keys of
the stored rows; only months that gain or lose a row are written anew, into a
fresh folder, without a shuffle of their wide rows.  The grains take the same change as signed rows: those that
arrive count once, those that leave count minus once, and groups left without
a complaint vanish.  A change is stored beside the grains before it and summed
with them when a grain is read; after a number of changes all are summed into
one folder.  A version is one small file that names the folders of its months
and grains; it appears by a single rename, so a merge that dies before leaves
the version before it as the current one, and its folders unused.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.dates import parse_mixed_date
from ledgerline.functions.text import zs_trim
from ledgerline.operators.dedup import latest_per_key, repeated_keys
from ledgerline.plans import serving
from ledgerline.plans.bronze import ID
from ledgerline.plans.warehouse import Warehouse
from ledgerline.schema import BASE_FIELDS, metric_columns
from ledgerline.session import drop_table, freed_shuffles, shared_table

#: Month of rows without a readable date.
UNDATED = "undated"
#: Rows that a task writes into a month's file, about, where there are enough.
FILE_ROWS = 10_000
#: Rows for which one more task is begun while there are cores.
TASK_ROWS = 50_000
#: Keys that are broadcast at once to the stored rows that they leave.
LEAVING_KEYS = 1_000_000
#: Folders of grains that a reader sums, at most.
GRAIN_FOLDERS = 8


def _by_month(rows: DataFrame) -> dict[str, int]:
    return {r["_month"]: r["count"] for r in rows.groupBy("_month").count().collect()}  # calendar months


def _rounds(months, went: dict[str, int]):
    """Months to write at once: those that together lose at most
    ``LEAVING_KEYS`` rows, or one that loses more."""
    part: list[str] = []
    for m in sorted(months):
        if part and sum(went.get(n, 0) for n in [*part, m]) > LEAVING_KEYS:
            yield part
            part = []
        part.append(m)
    if part:
        yield part


class ReleaseStore:
    """A versioned bronze with its grains under ``root`` (shared storage)."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._steps: list[DataFrame] = []  # stored on the way to a version

    # -- versions

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        pattern, fs = self._fs(f"{self.root}/versions/*.json")
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.globStatus(pattern) or [])

    def manifest(self, version: int | None = None) -> dict:
        """The newest version's record, or the given one's; an empty one before
        the first release."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "months": {}, "grains": None, "changes": {}}
        path = f"{self.root}/versions/{known[-1] if version is None else version:08d}.json"
        return json.loads(self.spark.read.option("wholetext", True).text(path).first()[0])

    def _publish(self, record: dict) -> None:
        """One rename makes the version visible; a version of that number that
        someone else has published meanwhile is an error."""
        final, fs = self._fs(f"{self.root}/versions/{record['version']:08d}.json")
        draft, _ = self._fs(f"{self.root}/drafts/{uuid.uuid4().hex}")
        stream = fs.create(draft)
        stream.write(bytearray(json.dumps(record, sort_keys=True).encode()))
        stream.close()
        fs.mkdirs(final.getParent())
        if fs.exists(final) or not fs.rename(draft, final):
            raise ValueError(f"version {record['version']} exists already: merge again on top of it")

    # -- reading

    def _rows(self, months: dict[str, str]) -> DataFrame:
        return self.spark.read.parquet(*months.values())

    def bronze(self, version: int | None = None) -> DataFrame:
        """One row per complaint, as :func:`bronze.dedup_latest` gives it."""
        months = self.manifest(version)["months"]
        if not months:
            raise ValueError("no release yet")
        return self._rows(months).drop("_key", "_month", "_source_priority")

    def grains(self, version: int | None = None) -> DataFrame:
        """All serving grains of a version (see ``serving.split_grain``)."""
        return self._summed(self.manifest(version)["grains"])

    def grain(self, name: str, version: int | None = None) -> DataFrame:
        grains = self._summed(self.manifest(version)["grains"], name)
        return serving.split_grain(grains, name, metric_columns(grains.columns))

    def _summed(self, folders: list[str], name: str | None = None) -> DataFrame:
        """The grains (or one) of these folders of signed rows."""
        parts = [self.spark.read.parquet(f) for f in folders]
        if name is not None:
            parts = [p.where(F.col(serving.GRAIN_COLUMN) == name) for p in parts]
        both = parts[0]
        for part in parts[1:]:
            both = both.unionByName(part)
        if len(parts) == 1:
            return both
        names = metric_columns(both.columns)
        keys = [c for c in both.columns if c not in names]
        # as in serving.all_grains: rows meet once, and no task holds many groups
        tasks = serving.task_count(sum(p.count() for p in parts) // len(serving.GRAINS))
        met = both.repartition(tasks, *BASE_FIELDS)
        return met.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in names]).where("complaint_count <> 0")

    # -- changing

    @contextmanager
    def _changing(self):
        """What a change only needs on its way goes as soon as nothing reads it:
        shuffles with their query, stored steps with the change."""
        with freed_shuffles(self.spark):
            try:
                yield
            finally:
                while self._steps:
                    drop_table(self._steps.pop())

    def _step(self, df: DataFrame, name: str) -> DataFrame:
        self._steps.append(shared_table(df, f"release-{name}"))
        return self._steps[-1]

    def merge(self, release: DataFrame) -> dict:
        """Take in raw rows with provenance and ``_source_priority``; returns the
        new version's record.  A stored row gives way to one of higher priority,
        or of equal priority and higher record number, so taking in the same
        release again changes nothing."""
        with self._changing():
            return self._merged(release)

    def _merged(self, release: DataFrame) -> dict:
        now = self.manifest()
        best = self._best(release)
        if not now["months"]:
            return self._apply(now, best, None)
        best = self._step(best, "rows")
        place = F.struct("_source_priority", "_source_record_number")
        stored = self._rows(now["months"]).select("_key", F.col("_month").alias("old_month"), place.alias("old"))
        met = self._step(stored.join(best.select("_key", place.alias("new")), "_key"), "met")  # narrow columns
        stale = met.where("new <= old").select("_key")
        if not stale.isEmpty():
            best = self._step(best.join(stale, "_key", "left_anti"), "arriving")
        return self._apply(now, best, met.where("new > old").select("_key", F.col("old_month").alias("_month")))

    def _best(self, release: DataFrame) -> DataFrame:
        """One row per key.  The keys alone are looked at first: in a release
        without repeated ones no wide row is moved."""
        month = F.coalesce(F.date_format(parse_mixed_date(F.col("Date received")), "yyyy-MM"), F.lit(UNDATED))
        order = [F.col("_source_priority").desc(), F.col("_source_record_number").desc()]
        if repeated_keys(release, zs_trim(ID)).count():
            release = self._step(latest_per_key(release, zs_trim(ID), order), "best")
        return release.withColumns({"_key": zs_trim(ID), "_month": month})

    def expire(self, start: dt.date) -> dict:
        """Drop the months before ``start`` (the first of a month) from bronze
        and grains; rows without a readable date stay."""
        now = self.manifest()
        old = {m: p for m, p in now["months"].items() if m != UNDATED and m < f"{start:%Y-%m}"}
        if not old:
            return now
        with self._changing():
            return self._version(now, {m: p for m, p in now["months"].items() if m not in old}, None, self._rows(old), sorted(old))

    def _apply(self, now: dict, arriving: DataFrame, leaving: DataFrame | None) -> dict:
        """Write the months that change anew, without a shuffle of their rows:
        arriving rows go from their partitions to their months' files, stored
        ones meet the keys that leave where they lie.  The rows that leave go to
        folders of their own, for the grains."""
        if leaving is not None and leaving.isEmpty():
            leaving = None
        came, went = _by_month(arriving), {} if leaving is None else _by_month(leaving)
        touched = sorted({*came, *went})
        if not touched:
            return now
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        self._write(arriving.withColumn("_kept", F.lit(True)), sum(came.values()), len(came), folder)
        before = {m: now["months"][m] for m in touched if m in now["months"]}
        for part in _rounds(before, went):
            rows = self._rows({m: before[m] for m in part})
            lost = sum(went.get(m, 0) for m in part)
            kept = rows.withColumn("_kept", F.lit(True))
            if lost:
                keys = leaving.where(F.col("_month").isin(part)).select("_key", F.lit(False).alias("_stays"))
                met = rows.join(F.broadcast(keys) if lost <= LEAVING_KEYS else keys, "_key", "left")
                kept = met.withColumn("_kept", F.col("_stays").isNull()).drop("_stays")
            self._write(kept, rows.count(), len(part), folder)  # counted from the files' footers
        found, fs = self._fs(f"{folder}/_kept=true/month=*")
        written = {s.getPath().getName().removeprefix("month="): str(s.getPath()) for s in fs.globStatus(found) or []}
        months = {m: p for m, p in now["months"].items() if m not in touched}
        if not now["months"]:
            arriving = self._rows(written)  # as stored
        left = None if leaving is None else self.spark.read.parquet(f"{folder}/_kept=false").drop("month")
        return self._version(now, {**months, **written}, arriving, left, touched)

    def _write(self, rows: DataFrame, count: int, months: int, folder: str) -> None:
        """Rows with ``_kept`` into their months, from as few tasks as keep the
        cluster busy: each of them writes a file for each month it meets."""
        wide = max(1, months) * FILE_ROWS
        tasks = max(1, count // wide, min(self.spark.sparkContext.defaultParallelism, count // TASK_ROWS))
        parts = rows.coalesce(tasks).withColumn("month", F.col("_month"))
        parts.write.mode("append").option("compression", "zstd").partitionBy("_kept", "month").parquet(folder)

    def _metrics(self, rows: DataFrame) -> DataFrame:
        """Gold rows of these complaints alone, one stored row each; keys are
        hashes of labels, so they are those of a full build.  The lookups are
        stored, so the planner knows their size before it moves the rows."""
        house = Warehouse(self.spark, lambda: rows, bronze=rows.drop("_key", "_month", "_source_priority"))
        for name in ("companies", "product_categories", "issue_categories", "submission_channels"):
            house.derived(name, lambda name=name: self._step(house.built(name), name))
        return house["complaint_metrics"]

    def _version(self, now: dict, months: dict, arriving: DataFrame | None, leaving: DataFrame | None, touched: list[str]) -> dict:
        """Publish ``months`` with the signed change of the grains."""
        change, counts = None, {}
        for name, rows, sign in (("arrived", arriving, 1), ("left", leaving, -1)):
            counts[name] = rows.count() if rows is not None else 0  # from the files' footers
            if counts[name]:
                part = serving.all_grains(self._metrics(rows), serving.task_count(counts[name]))
                part = part.withColumns({m: F.col(m) * sign for m in metric_columns(part.columns)})
                change = part if change is None else change.unionByName(part)
        folders = [*(now["grains"] or []), self._store_grains(change)]
        if len(folders) > GRAIN_FOLDERS:
            folders = [self._store_grains(self._summed(folders))]
        record = {"version": now["version"] + 1, "months": months, "grains": folders, "changes": {**counts, "months": touched}}
        self._publish(record)
        return record

    def _store_grains(self, rows: DataFrame) -> str:
        folder = f"{self.root}/grains/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").partitionBy(serving.GRAIN_COLUMN).parquet(folder)
        return folder
