"""Releases merged in order against a full rebuild."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from fixtures import ORDINARY, bronze_df
from ledgerline.plans import bronze, serving
from ledgerline.plans.releases import ReleaseStore
from ledgerline.plans.warehouse import Warehouse


def rows(spark, priority, *changes):
    """Raw rows ``(id, record number, changed fields)`` of one release."""
    made = [
        {**ORDINARY, **fields, "Complaint ID": key, "_source_archive": f"r{priority}.zip", "_source_csv": "r.csv",
         "_source_record_number": number, "_ingested_at": "2024-02-02"}
        for key, number, fields in changes
    ]
    return bronze_df(spark, made, priority)


def on(day, **fields):
    return {"Date received": day, **{k.replace("_", " "): v for k, v in fields.items()}}


@pytest.fixture(scope="module")
def releases(spark):
    return [
        rows(spark, 1, ("1", 1, on("2023-01-05")), ("2", 2, on("2023-01-09")), ("3", 3, on("02/01/2023")), ("4", 4, on("2023-03-31", Company="Solo")),
             (" 4 ", 5, on("2023-03-30", Company="Solo")), ("5", 6, on("2022-12-31"))),
        rows(spark, 3, ("2", 1, on("2023-01-09", State="WA")),  # revised in place
             ("3", 2, on("2023-04-02")),  # moves to another month
             ("4", 3, on("2023-03-30", Company="Northwind Motors")),  # its company loses its last row
             ("6", 4, on("2023-04-03"))),
        rows(spark, 2, ("2", 9, on("2023-01-10", State="CA")), ("7", 1, on("2023-02-11"))),  # an older release that comes late
    ]


def same(a, b):
    return sorted(map(repr, a.select(*sorted(a.columns)).collect())) == sorted(map(repr, b.select(*sorted(b.columns)).collect()))


def matches_rebuild(store, incoming):
    rebuilt = bronze.dedup_latest(incoming)
    assert same(store.bronze(), rebuilt)
    gold = Warehouse(store.spark, lambda: incoming)["complaint_metrics"]
    for name in serving.GRAINS:
        assert same(store.grain(name), serving.grain(gold, name)), name


def test_merges_equal_a_rebuild(spark, releases, tmp_path):
    store = ReleaseStore(spark, str(tmp_path / "store"))
    incoming, changes = None, []
    for release in releases:
        incoming = release if incoming is None else incoming.unionByName(release)
        changes.append(store.merge(release)["changes"])
        matches_rebuild(store, incoming)
    assert [(c["arrived"], c["left"]) for c in changes] == [(5, 0), (4, 3), (1, 0)]
    assert [c["months"] for c in changes] == [
        ["2022-12", "2023-01", "2023-02", "2023-03"], ["2023-01", "2023-02", "2023-03", "2023-04"], ["2023-02"]]
    first, last = store.manifest(1), store.manifest()
    assert last["months"]["2022-12"] == first["months"]["2022-12"]  # never written again
    assert store.merge(releases[1])["version"] == 3  # taken in already: nothing changes
    assert store.bronze(1).count() == 5  # older versions stay readable


def test_expired_months_leave_bronze_and_grains(spark, releases, tmp_path):
    store = ReleaseStore(spark, str(tmp_path / "store"))
    incoming = releases[0].unionByName(releases[1])
    store.merge(releases[0])
    store.merge(releases[1])
    assert store.expire(dt.date(2023, 2, 1))["changes"] == {"arrived": 0, "left": 3, "months": ["2022-12", "2023-01"]}
    # all rows of a complaint whose kept row is inside the window
    ids = [r["Complaint ID"] for r in bronze.retain_window(bronze.dedup_latest(incoming), dt.date(2023, 2, 1), dt.date(2030, 1, 1)).collect()]
    matches_rebuild(store, incoming.filter(F.trim("`Complaint ID`").isin([i.strip() for i in ids])))
    assert store.expire(dt.date(2023, 2, 1))["version"] == 3


def test_a_killed_merge_leaves_the_version_before(spark, releases, tmp_path, monkeypatch):
    store = ReleaseStore(spark, str(tmp_path / "store"))
    store.merge(releases[0])
    before = sorted(map(repr, store.bronze().collect()))

    def killed(record):
        raise RuntimeError("killed")

    monkeypatch.setattr(store, "_publish", killed)
    with pytest.raises(RuntimeError):
        store.merge(releases[1])
    again = ReleaseStore(spark, str(tmp_path / "store"))
    assert again.versions() == [1] and sorted(map(repr, again.bronze().collect())) == before
    again.merge(releases[1])
    matches_rebuild(again, releases[0].unionByName(releases[1]))


def test_two_writers(spark, releases, tmp_path):
    """The slower of two merges on the same version is refused."""
    store = ReleaseStore(spark, str(tmp_path / "store"))
    store.merge(releases[0])
    stale = store.manifest()
    store.merge(releases[1])
    with pytest.raises(ValueError, match="merge again"):
        store._publish({**stale, "version": stale["version"] + 1})
    assert os.listdir(tmp_path / "store" / "versions") and store.versions() == [1, 2]


def test_no_release(spark, tmp_path, releases):
    store = ReleaseStore(spark, str(tmp_path / "store"))
    with pytest.raises(ValueError, match="no release"):
        store.bronze()
    assert store.merge(releases[0].limit(0))["version"] == 0
    assert store.expire(dt.date(2030, 1, 1))["version"] == 0


def test_rows_are_shuffled_once_per_merge(spark, releases, tmp_path, monkeypatch):
    """A merge moves its wide rows once, and unchanged grains not at all."""
    plans = []
    store = ReleaseStore(spark, str(tmp_path / "store"))
    version = store._version

    def seen(now, months, arriving, leaving, touched):
        plans.append(arriving._jdf.queryExecution().executedPlan().toString())
        return version(now, months, arriving, leaving, touched)

    monkeypatch.setattr(store, "_version", seen)
    store.merge(releases[1])  # no key twice: not even the dedup shuffles
    first = store.manifest()["grains"]
    store.merge(releases[2])
    assert all("Exchange" not in p for p in plans)
    assert store.manifest()["grains"][:1] == first and len(store.manifest()["grains"]) == 2


def test_many_changes_are_summed_into_one_folder(spark, releases, tmp_path, monkeypatch):
    monkeypatch.setattr("ledgerline.plans.releases.GRAIN_FOLDERS", 1)
    store = ReleaseStore(spark, str(tmp_path / "store"))
    store.merge(releases[0])
    store.merge(releases[1])
    assert len(store.manifest()["grains"]) == 1
    matches_rebuild(store, releases[0].unionByName(releases[1]))


def left_behind(spark):
    """Shuffle files and stored steps of merges."""
    from ledgerline.session import shared_path

    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    tables = shared_path(spark, "ledgerline-tables").removeprefix("file:")
    steps = os.listdir(tables) if os.path.isdir(tables) else []
    names = [files.apply(k).getName() for k in range(files.size())]
    return {n for n in names if n.startswith("shuffle_")} | {t for t in steps if t.startswith("release-")}


def test_a_merge_leaves_nothing_but_its_version_on_disk(spark, releases, tmp_path):
    """Shuffles and stored steps go at once, not with the driver's garbage."""
    store = ReleaseStore(spark, str(tmp_path / "store"))
    store.merge(releases[0])
    before = left_behind(spark)
    store.merge(releases[1])
    store.expire(dt.date(2023, 2, 1))
    until = time.time() + 20  # files are removed behind the query
    while left_behind(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not left_behind(spark) - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_wide_rows_are_written_where_they_lie(spark, releases, tmp_path, monkeypatch):
    """No write of months has a shuffle; a month that loses more keys than may
    be broadcast is joined by shuffle, with the same rows."""
    plans = []
    write = ReleaseStore._write

    def seen(store, rows, *more):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        write(store, rows, *more)

    monkeypatch.setattr(ReleaseStore, "_write", seen)
    for limit in (1_000_000, 1):
        monkeypatch.setattr("ledgerline.plans.releases.LEAVING_KEYS", limit)
        store = ReleaseStore(spark, str(tmp_path / f"store{limit}"))
        store.merge(releases[0])
        store.merge(releases[1])
        matches_rebuild(store, releases[0].unionByName(releases[1]))
    # the first merge; arriving rows and all stored months; ...; arriving rows and each month that loses a row
    assert len(plans) == 3 + 5
    assert not any("Exchange hashpartitioning" in p for p in plans[:3])
