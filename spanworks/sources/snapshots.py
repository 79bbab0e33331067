"""Tables in versions, published by manifests, with deltas and retention; logs of JSON lines that rotate."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.state import changed_files, merged


class Files:
    """The file system of a folder, by Hadoop's interface: local disks and object stores alike. Driver only, a few calls
    for small files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(folder).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder))) if self.fs.exists(self.path(folder)) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Writes a file beside its place and moves it there; false if somebody else's is there already."""
        beside, place = self.path(f"{name}.{uuid.uuid4().hex}.tmp"), self.path(name)
        stream = self.fs.create(beside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        moved = not self.fs.exists(place) and self.fs.rename(beside, place)
        if not moved:
            self.fs.delete(beside, False)
        return moved

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class StaleBase(RuntimeError):
    """A delta was made against another version than the current one."""


@dataclass
class Version:
    """What a manifest says: of each bucket the folder with its rows, and what the version changed."""

    version: int
    rows: int
    digest: int
    buckets: dict[str, str]
    added: int = 0
    modified: int = 0
    deleted: int = 0
    schema: dict = field(default_factory=dict)


class Snapshots:
    """A table by a key, in versions. Rows are written by buckets of the key; a delta rewrites the buckets that it touches
    and takes the others over. A version is there once its manifest is, which is moved into place as a whole: readers see
    the last whole version, and a write that fails leaves it as it is.

    Keys are not null and not repeated. hash names the column that tells whether a row of a key has changed.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str = "path", hash: str = "hash", buckets: int = 16):
        self.spark, self.folder, self.key, self.hash, self.buckets, self.files = spark, folder.rstrip("/"), key, hash, buckets, Files(spark, folder)

    def versions(self) -> list[int]:
        return [int(m[1]) for n in self.files.names(f"{self.folder}/manifests") if (m := re.fullmatch(r"(\d+)\.json", n))]

    def manifest(self, version: int | None = None) -> Version | None:
        known = self.versions()
        if not known:
            return None
        return Version(**json.loads(self.files.read(f"{self.folder}/manifests/{version or known[-1]:09}.json")))

    def read(self, version: int | None = None, only: list[str] | None = None) -> DataFrame:
        """The rows of a version (None: the current one), or of some of its buckets."""
        found = self.manifest(version)
        if found is None:
            raise FileNotFoundError(f"no version in {self.folder}")
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(found.schema)
        folders = [path for bucket, path in found.buckets.items() if only is None or bucket in only]
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("string")

    def _write(self, rows: DataFrame, version: int) -> dict[str, str]:
        """Writes rows by bucket; the folders of the buckets that have rows."""
        name = f"data/{version:09}-{uuid.uuid4().hex[:8]}"
        rows.withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/{name}")
        return {n.removeprefix("_bucket="): f"{name}/{n}" for n in self.files.names(f"{self.folder}/{name}") if n.startswith("_bucket=")}

    def _publish(self, version: Version) -> Version:
        if not self.files.publish(f"{self.folder}/manifests/{version.version:09}.json", json.dumps(asdict(version))):
            raise StaleBase(f"version {version.version} is there already")
        return version

    def _digest(self, rows: DataFrame) -> tuple[int, int]:
        found = rows.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64(self.key, self.hash)), F.lit(0)).alias("x")).first()
        return found.n, found.x

    def replace(self, rows: DataFrame) -> Version:
        """Makes rows the table. If they are what it holds already, no version is written."""
        before = self.manifest()
        n, digest = self._digest(rows)
        if before is not None and (before.rows, before.digest) == (n, digest):
            return before
        number = (before.version if before else 0) + 1
        counts = self._changes(rows) if before else {"added": n}
        return self._publish(Version(number, n, digest, self._write(rows, number), schema=rows.schema.jsonValue(), **counts))

    def _changes(self, rows: DataFrame) -> dict[str, int]:
        named = lambda df: df.select(F.col(self.key).alias("path"), F.col(self.hash).alias("hash"))
        return {r.change: r["count"] for r in changed_files(named(self.read()), named(rows)).groupBy("change").count().collect()}

    def apply(self, fresh: DataFrame, deleted: DataFrame, base: int | None = None) -> Version:
        """A delta: fresh rows replace those of their key, keys of `deleted` go (fresh ones stay). base: the version it was
        made against; StaleBase if that is not the current one. Only what differs counts: without that, no version is
        written. Buckets without a change are not read."""
        before = self.manifest()
        if before is None:
            return self.replace(fresh)
        if base is not None and base != before.version:
            raise StaleBase(f"made against version {base}, current is {before.version}")
        touched = fresh.select(self._bucket().alias("b")).union(deleted.select(self._bucket().alias("b"))).distinct()
        names = sorted(r.b for r in touched.collect())  # as many as there are buckets at most
        old = self.read(only=names)
        gone = deleted.select(self.key).distinct().join(fresh.select(self.key), self.key, "left_anti")
        after = merged(old, fresh.select(old.columns), gone, self.key)
        named = lambda df: df.select(F.col(self.key).alias("path"), F.col(self.hash).alias("hash"))
        counts = {r.change: r["count"] for r in changed_files(named(old), named(after)).groupBy("change").count().collect()}
        if not counts:
            return before
        written = self._write(after, before.version + 1)
        buckets = {k: v for k, v in before.buckets.items() if k not in names} | written
        (n_old, x_old), (n_new, x_new) = self._digest(old), self._digest(self.spark.read.schema(old.schema).parquet(*[f"{self.folder}/{f}" for f in written.values()]) if written else old.limit(0))
        return self._publish(Version(before.version + 1, before.rows - n_old + n_new, before.digest ^ x_old ^ x_new, buckets, schema=before.schema, **counts))

    def retain(self, newest: int) -> list[int]:
        """Deletes all but the newest versions, then the rows that no version left names. The current one always stays."""
        known = self.versions()
        gone = known[: max(0, len(known) - max(1, newest))]
        for version in gone:
            self.files.delete(f"{self.folder}/manifests/{version:09}.json")
        used = {path.split("/_bucket=")[0] for v in self.versions() for path in self.manifest(v).buckets.values()}
        for name in self.files.names(f"{self.folder}/data"):
            if f"data/{name}" not in used:
                self.files.delete(f"{self.folder}/data/{name}")
        return gone


class JsonLines:
    """A log of batches of JSON lines. A batch is written beside and moved into place; of the batches the newest `keep` stay.
    Each keeps its order; lines of all are read with the number of their batch."""

    def __init__(self, spark: SparkSession, folder: str, keep: int = 10):
        self.spark, self.folder, self.keep, self.files = spark, folder.rstrip("/"), keep, Files(spark, folder)

    def batches(self) -> list[str]:
        return [n for n in self.files.names(self.folder) if re.fullmatch(r"batch=\d{9}", n)]

    def append(self, rows: DataFrame) -> int:
        number = int(self.batches()[-1].removeprefix("batch=")) + 1 if self.batches() else 1
        beside = f"{self.folder}/_writing-{uuid.uuid4().hex}"
        rows.write.json(beside)
        if not self.files.fs.rename(self.files.path(beside), self.files.path(f"{self.folder}/batch={number:09}")):
            raise StaleBase(f"batch {number} is there already")
        for name in self.batches()[: -self.keep]:
            self.files.delete(f"{self.folder}/{name}")
        return number

    def read(self, schema: str) -> DataFrame:
        return self.spark.read.schema(f"{schema}, batch int").json(self.folder)
