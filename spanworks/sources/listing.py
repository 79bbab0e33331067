"""Files below a folder, without the folders that are pruned."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import classify
from ..operators.scope import HEAVY
from .snapshots import Files

MOST_DEPTH = 64


def kept_folders(spark: SparkSession, root: str, pruned: list[str] | None = None, globs: list[str] | tuple = (), most_depth: int = MOST_DEPTH) -> tuple[list[str], list[str]]:
    """The folders below a root that are looked into, itself included, and those left out, relative to it: of a pruned name,
    ignored by a glob, sensitive, a link, or too deep. Level by level; a folder left out is never opened. Only folders go
    through the driver; their files are listed by Spark."""
    files, names = Files(spark, root), set(HEAVY if pruned is None else pruned)
    ignored = re.compile("|".join(f"(?:{classify.glob_pattern(g)})" for g in globs)) if globs else None
    sensitive = re.compile("|".join(f"(?:{p})" for p in classify.SENSITIVE), re.I)
    kept, left, level = [""], [], [""]
    for depth in range(1, most_depth + 1):
        below = []
        for folder in level:
            for entry in files.fs.listStatus(files.path(f"{root}/{folder}" if folder else root)):
                if entry.isDirectory() or entry.isSymlink():
                    name = entry.getPath().getName()
                    path = f"{folder}/{name}" if folder else name
                    out = entry.isSymlink() or name in names or depth >= most_depth or sensitive.search(path) or ignored and ignored.search(path)
                    (left if out else below).append(path)
        kept += below
        level = below
        if not level:
            break
    return sorted(kept), sorted(left)


def listed(spark: SparkSession, root: str, **how) -> DataFrame:
    """(path, size, modified, hash, text) of the files in the kept folders; how: as for kept_folders. Spark lists the folders
    in parallel and reads contents only where they are asked for. Files with a sensitive name are left out."""
    root = root.rstrip("/")
    kept, _ = kept_folders(spark, root, **how)
    rows = spark.read.format("binaryFile").load([f"{root}/{f}" if f else root for f in kept])
    base = re.sub("^file:/+", "/", Files(spark, root).path(root).toUri().getPath())
    path = F.regexp_replace(F.substring_index("path", f"{base}/", -1), "^/+", "")
    rows = rows.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha1("content").alias("hash"), F.decode(F.col("content"), "UTF-8").alias("text"))
    return rows.where(~classify.sensitive(F.col("path")))


def snapshot_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, hash, role, language) of an inventory written as JSON ({"files": [{"path", "contentHash"}]}). Entries without a
    path, or with one that leaves the root, are left out."""
    found = spark.read.schema("files array<struct<path:string,contentHash:string>>").option("multiLine", True).json(path).select(F.inline("files"))
    clean = F.regexp_replace(F.translate("path", "\\", "/"), r"^(?:\./)+", "")
    inside = ~clean.rlike(r"(^|/)\.\.(/|$)") & ~clean.startswith("/") & (clean != "")
    return found.where("path is not null").where(inside).select(clean.alias("path"), F.coalesce("contentHash", F.lit("")).alias("hash"), classify.role(clean).alias("role"), classify.language(clean).alias("language"))
