"""Versions, deltas, failed writes and retention of tables; logs that rotate."""

import pytest
from pyspark.sql import functions as F

from spanworks.sources.snapshots import JsonLines, Snapshots, StaleBase


def frame(spark, rows):
    return spark.createDataFrame([(p, h, len(h)) for p, h in rows.items()], "path string, hash string, size int")


def held(table, version=None):
    return {r.path: r.hash for r in table.read(version).collect()}


def test_two_deltas(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path), buckets=4)
    rows = {f"f{i}": "a" for i in range(50)}
    first = table.replace(frame(spark, rows))
    assert (first.version, first.rows, first.added) == (1, 50, 50) and held(table) == rows
    assert table.replace(frame(spark, rows)).version == 1, "the same rows make no version"
    second = table.apply(frame(spark, {"f1": "b", "f2": "a", "new": "c"}), frame(spark, {"f3": "", "absent": ""}), base=1)
    rows = {k: v for k, v in rows.items() if k != "f3"} | {"f1": "b", "new": "c"}
    assert (second.version, second.rows, second.added, second.modified, second.deleted) == (2, 50, 1, 1, 1) and held(table) == rows
    third = table.apply(frame(spark, {"x": "y"}), frame(spark, {}))
    assert len(set(third.buckets.values()) & set(second.buckets.values())) == 3, "a delta of one key rewrites one bucket"
    assert held(table) == rows | {"x": "y"} and held(table, 2) == rows and held(table, 1)["f3"] == "a"
    assert table.apply(frame(spark, {"x": "y"}), frame(spark, {"absent": ""})).version == 3, "a delta without a change makes no version"
    again = Snapshots(spark, f"{tmp_path}/other", buckets=4)
    again.replace(frame(spark, rows | {"x": "y"}))
    assert again.manifest().digest == third.digest
    with pytest.raises(StaleBase):
        table.apply(frame(spark, {"z": "z"}), frame(spark, {}), base=2)


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path), buckets=4)
    table.replace(frame(spark, {"a": "1", "b": "2"}))
    broken = frame(spark, {"a": "3"}).withColumn("size", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        table.apply(broken, frame(spark, {}))
    assert table.versions() == [1] and held(table) == {"a": "1", "b": "2"}
    assert table.apply(frame(spark, {"a": "3"}), frame(spark, {})).version == 2 and held(table) == {"a": "3", "b": "2"}


def test_a_version_is_published_once(spark, tmp_path):
    table, other = Snapshots(spark, str(tmp_path)), Snapshots(spark, str(tmp_path))
    table.replace(frame(spark, {"a": "1"}))
    stale = other.manifest()
    table.apply(frame(spark, {"a": "2"}), frame(spark, {}))
    other.manifest = lambda version=None: stale if version is None else Snapshots.manifest(other, version)
    with pytest.raises(StaleBase):
        other.apply(frame(spark, {"a": "3"}), frame(spark, {}))
    assert held(table) == {"a": "2"}


def test_retention(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path), buckets=2)
    for i in range(5):
        table.apply(frame(spark, {"a": str(i), f"b{i}": "x"}), frame(spark, {}))
    assert table.retain(2) == [1, 2, 3] and table.versions() == [4, 5]
    assert held(table)["a"] == "4" and held(table, 4)["a"] == "3" and len(held(table)) == 6
    before = len(table.files.names(f"{tmp_path}/data"))
    assert table.retain(0) == [4] and held(table)["a"] == "4" and len(table.files.names(f"{tmp_path}/data")) <= before


def test_emptied_and_empty(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path), buckets=2)
    with pytest.raises(FileNotFoundError):
        table.read()
    table.replace(frame(spark, {"a": "1"}))
    emptied = table.apply(frame(spark, {}), frame(spark, {"a": ""}))
    assert (emptied.rows, emptied.deleted, emptied.digest) == (0, 1, 0) and held(table) == {}


def test_lines_rotate(spark, tmp_path):
    log = JsonLines(spark, str(tmp_path), keep=2)
    for i in range(4):
        assert log.append(spark.createDataFrame([(i, f"é{i}\n")], "n int, text string")) == i + 1
    assert [(r.n, r.text, r.batch) for r in log.read("n int, text string").orderBy("n").collect()] == [(2, "é2\n", 3), (3, "é3\n", 4)]
