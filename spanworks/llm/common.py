"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, functions as F

#: White space as the word definitions of this subpackage have it.
WORD = r"[^\x20\x09-\x0D]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_az(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. Pure ASCII takes the fast built-in, which does the same there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def shared_folder(spark) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session gets a
    folder of its own; a cluster has none to fall back on, so that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


_written: dict[str, object] = {}


def staged(df: DataFrame) -> DataFrame:
    """Writes the rows once to the shared folder and returns a reader of them: cuts lineage, survives lost executors,
    and gives Spark true sizes, by which it decides on broadcasts. Deleted by `discard`, else when Python ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_discard_all)
    _written[path] = spark.sparkContext
    df.write.parquet(path)
    rows = spark.read.schema(df.schema).parquet(path)
    rows._staged_at = path
    return rows


def discard(*rows: DataFrame) -> None:
    """Deletes what `staged` wrote for rows that nothing reads any more."""
    for df in rows:
        _delete(df._staged_at)


def _delete(path: str) -> None:
    context = _written.pop(path, None)
    if context is not None and context._jsc is not None:
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def _discard_all() -> None:
    for path in list(_written):
        _delete(path)


def text_mark(text="text") -> Column:
    """Tells rows that repeat a doc_id with different texts apart; null and empty texts differ."""
    return F.xxhash64(F.col(text), F.col(text).isNull())


def columns_of(docs: DataFrame) -> list[Column]:
    """The columns of docs as they are, whatever their names."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns of a row, whatever their names and types; what Spark can't hash goes by its JSON."""
    plain = lambda kind: not any(x in kind.simpleString() for x in ("map<", "variant"))
    return F.xxhash64(*[c if plain(f.dataType) else F.to_json(F.struct(c.alias("x"))) for c, f in zip(columns_of(docs), docs.schema)])


def join_sized(left: DataFrame, right: DataFrame, on, how: str = "inner", most_rows: int = 10_000) -> DataFrame:
    """Joins; broadcasts the right side only if it is counted to hold at most `most_rows` rows. The right side should be
    staged, as it is counted first. Beyond the bound Spark shuffles both sides and AQE splits skewed keys."""
    return left.join(F.broadcast(right) if right.limit(most_rows + 1).count() <= most_rows else right, on, how)


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
