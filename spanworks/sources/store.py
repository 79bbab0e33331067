"""Tables that are written on the way: staged rows, and versioned tables that are published by a manifest."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session gets a
    folder of its own; a cluster has none to fall back on, so that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


_staged: dict[str, SparkSession] = {}


def staged(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The rows, written once to the shared folder: what several branches of a plan read is made once, survives lost
    executors and has a true size. Deleted when Python ends. by: columns of few values by which the files are told apart, so
    that who asks for one value reads no others."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/rows-{uuid.uuid4().hex}"
    if not _staged:
        atexit.register(_clear)
    _staged[path] = spark
    rows.write.partitionBy(*by or []).parquet(path)
    return spark.read.schema(rows.schema).parquet(path).select(*rows.columns)


def _clear() -> None:
    for path, spark in _staged.items():
        if spark.sparkContext._jsc is not None:
            delete(spark, path)
