"""What a refresh has to look at: changed paths, an inventory made of a snapshot and a few paths, files to index deeply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths
from . import state

#: The most paths of changes, and files that changed folders stand for.
MOST_CHANGED, MOST_EXPANDED = 500, 1000
# Folders that are never looked into.
HEAVY = ["node_modules", ".git", ".spanindex", "__pycache__", ".venv", "venv", ".tox", "dist", "build", ".next"]


def heavy(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(n) for n in HEAVY]))


def expanded(changed: DataFrame, files: DataFrame, most: int = MOST_EXPANDED) -> DataFrame:
    """(path, omitted): the text files (path) that changed paths stand for: themselves, and those right in a changed folder; not
    in heavy folders. The first `most` by path; omitted says how many more there are, on every row. A top-k, not a sort of all."""
    known = files.select("path").distinct().where(paths.text_path(F.col("path")) & ~heavy(F.col("path")))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    wanted = changed.select(F.col("path").alias("_path")).distinct()
    found = known.join(wanted, F.col("path") == F.col("_path"), "left_semi").union(known.join(wanted, folder == F.col("_path"), "left_semi")).distinct()
    total = found.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("omitted"))
    return found.orderBy("path").limit(most).join(F.broadcast(total))  # one row


def snapshot_inventory(previous: DataFrame, refreshed: DataFrame, deleted: DataFrame) -> DataFrame:
    """An inventory by path made of an earlier one, the rows of some paths read anew, and paths that are gone."""
    return state.merged(previous, refreshed, deleted, "path")


def requested(inventory: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of the inventory that wanted paths name, themselves or as folders above; and the wanted paths that name none.
    A path meets the prefixes of files as equal keys, so folders need no nested loop."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    names = wanted.select(F.regexp_replace(F.regexp_replace("path", r"^\./", ""), "/+$", "").alias("_name"), F.col("path").alias("_as")).distinct()
    each = inventory.select("path", F.explode(above).alias("_name")).join(names, "_name")
    return inventory.join(each.select("path").distinct(), "path", "left_semi"), names.join(each.select("_name").distinct(), "_name", "left_anti").select(F.col("_as").alias("path"))


def deep_files(inventory: DataFrame, target: str, wanted: DataFrame | None = None, hotset: DataFrame | None = None, changed: DataFrame | None = None, previous: str = "none") -> DataFrame:
    """The inventory (path, oversized) with `deep` (read into spans) and `warning`, for a refresh of a target.

    files: none is. changed: those that changed, if the last coverage was full; else the hot ones. paths and hotset: hot ones,
    to which wanted paths are pinned. Else all. Files of a hot set (path, pinned) that are cold by their path are left out
    unless pinned, and oversized ones are never read; both are warned of, with wanted paths that are not there."""
    rows = inventory.withColumn("_cold", paths.cold(F.col("path")))
    none = inventory.sparkSession.createDataFrame([], "path string, pinned boolean")
    hot = (none if hotset is None else hotset.select("path", "pinned"))
    missing = none.select("path")
    if target == "paths" and wanted is not None:
        there, missing = requested(inventory, wanted)
        hot = hot.union(there.select("path", F.lit(True)))
    hot = hot.groupBy("path").agg(F.max("pinned").alias("_pinned"))
    over = "changed" if target == "changed" and previous == "full" else "hotset"
    if target == "files":
        judged = rows.withColumns({"_in": F.lit(False), "_skip": F.lit(False)})
    elif over == "changed":
        judged = rows.join((none if changed is None else changed).select("path", F.lit(True).alias("_in")).distinct(), "path", "left").withColumns({"_in": F.coalesce("_in", F.lit(False)), "_skip": F.lit(False)})
    elif target in ("paths", "hotset", "changed"):
        judged = rows.join(hot, "path", "left").withColumns({"_in": F.col("_pinned").isNotNull(), "_skip": F.col("_cold") & ~F.coalesce("_pinned", F.lit(False))})
    else:
        judged = rows.withColumns({"_in": F.lit(True), "_skip": F.lit(False)})
    warning = F.when(F.col("_in") & F.col("_skip"), "cold file left in the inventory; name it to have it read").when(F.col("_in") & F.col("oversized"), f"oversized {over} file kept as a file only")
    out = judged.select("path", (F.col("_in") & ~F.col("_skip") & ~F.col("oversized")).alias("deep"), warning.alias("warning"))
    return out.union(missing.select("path", F.lit(False), F.lit("wanted path is not in the inventory")))


def coverage(scoped: DataFrame) -> DataFrame:
    """One row of what `deep_files` chose: files, hot, cold, and deep: none, scoped or full."""
    return scoped.where("warning is null or warning not like 'wanted%'").agg(F.count("*").alias("files"), F.count_if("deep").alias("hot")).select(
        "files", "hot", (F.col("files") - F.col("hot")).alias("cold"), F.when(F.col("hot") == 0, "none").when(F.col("hot") < F.col("files"), "scoped").otherwise("full").alias("deep"))
