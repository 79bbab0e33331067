"""Navigation anchors: reading them, what commands make of them, and their status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import classify

# States in their order, sources that are kept, and what an anchor is without more being said.
STATES = ["active", "dormant", "archived", "tombstoned"]
SOURCES = ["agent_curated", "checkpoint", "imported"]
DEFAULTS = {"kind": "file", "role": "source_file", "reason": "navigation target"}
PROMOTED_SCORE, PROMOTED_CONFIDENCE = 100.0, 1.0
_RAW = """struct<id:string,path:string,label:string,kind:string,role:string,startLine:double,endLine:double,headingPath:array<string>,state:string,pinned:boolean,source:string,reason:string,
  score:double,confidence:double,createdSeq:double,lastSeenSeq:double,ignoredInjectionCount:double,usefulHitCount:double>"""


def anchor_path(path: Column) -> Column:
    """A path inside the project, without `./` and doubled slashes; null for one that is empty, absolute or leaves it."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.translate(F.trim(path), "\\", "/"), r"^(?:\./)+", ""), "/+", "/"), "/$", "")
    return F.when((clean != "") & ~clean.startswith("/") & ~clean.rlike(r"(?:^|/)\.\.(?:/|$)|^[A-Za-z]:"), clean)


def anchor_id(path: Column, start: Column, label: Column) -> Column:
    return F.concat(F.lit("anchor:"), F.substring(F.sha1(F.concat_ws("\n", path, F.coalesce(start.cast("string"), F.lit("")), label)), 1, 16))


def read_anchors(manifests: DataFrame, text: str, seq: int = 0) -> DataFrame:
    """The anchors of manifests (JSON objects with `anchors`), each field of the right type or its default; those without a
    path inside the project are left out. A field of a wrong type counts as missing, a text that is no JSON has none."""
    raw = manifests.select(F.inline(F.from_json(F.col(text), f"struct<anchors:array<{_RAW}>>")["anchors"]))
    said = lambda c, default: F.coalesce(F.nullif(F.col(c), F.lit("")), default)
    number = lambda c, default: F.coalesce(F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)), F.lit(float(default)))
    rows = raw.withColumn("path", anchor_path(F.col("path"))).where("path is not null").withColumn("label", said("label", F.col("path")))
    line = lambda c: F.col(c).cast("long")
    return rows.select(
        said("id", anchor_id(F.col("path"), line("startLine"), F.col("label"))).alias("id"), "path", "label", *[said(c, F.lit(v)).alias(c) for c, v in DEFAULTS.items()],
        line("startLine").alias("start_line"), line("endLine").alias("end_line"), F.coalesce(F.array_compact("headingPath"), F.array().cast("array<string>")).alias("heading_path"),
        F.when(F.col("state").isin(STATES), F.col("state")).otherwise("active").alias("state"), F.coalesce("pinned", F.lit(False)).alias("pinned"),
        F.when(F.col("source").isin(SOURCES), F.col("source")).otherwise("automatic").alias("source"), number("score", 0).alias("score"), number("confidence", 0).alias("confidence"),
        number("createdSeq", seq).alias("created_seq"), number("lastSeenSeq", seq).alias("last_seen"), number("ignoredInjectionCount", 0).alias("ignored"), number("usefulHitCount", 0).alias("useful"))


def commanded(anchors: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Anchors (path, state, pinned, score, confidence, last_seen) after commands (seq, action, path, state, pinned), in order of
    seq, and warnings (seq, path, warning).

    promote makes an anchor active, new if need be, with the top score, and pins it if so said; demote gives it a state
    (dormant if none is said); retire makes it tombstoned for good, so that later commands do nothing. Demoting and
    retiring what is not there is warned of, as is a path outside the project. Only the first retirement, the last command
    before it and the first promotion matter, so a grouped aggregate tells all: no task folds a path's commands."""
    rows = commands.withColumn("_path", anchor_path(F.col("path")))
    outside = rows.where("_path is null").select("seq", "path", F.lit("path is not inside the project").alias("warning"))
    rows = rows.where("_path is not null").select("seq", "action", F.col("_path").alias("path"), "state", F.coalesce("pinned", F.lit(False)).alias("pinned"))
    there = anchors.groupBy("path").agg(F.lit(-1).cast("long").alias("_from"))
    first = rows.groupBy("path").agg(F.min(F.when(F.col("action") == "promote", F.col("seq"))).alias("_promoted")).join(there, "path", "left")
    begins = F.coalesce("_from", "_promoted")
    placed = rows.join(first.select("path", begins.alias("_begins")), "path")
    early = F.col("_begins").isNull() | (F.col("seq") < F.col("_begins"))
    missing = placed.where(early).select("seq", "path", F.lit("no such anchor").alias("warning"))
    ends = placed.where(~early).groupBy("path").agg(F.min(F.when(F.col("action") == "retire", F.col("seq"))).alias("_retired"))
    live = placed.where(~early).join(ends, "path").where(F.col("_retired").isNull() | (F.col("seq") <= F.col("_retired")))
    to = F.when(F.col("action") == "promote", "active").when(F.col("action") == "retire", "tombstoned").otherwise(F.coalesce("state", F.lit("dormant")))
    done = live.groupBy("path").agg(
        F.max_by(to, "seq").alias("_state"), F.max(F.col("pinned") & (F.col("action") == "promote")).alias("_pin"), F.max(F.col("action") == "promote").alias("_top"), F.max("seq").alias("_seq"))
    both = anchors.select("path", "state", "pinned", "score", "confidence", "last_seen").join(done, "path", "full_outer")
    open_ = F.coalesce(F.col("state") != "tombstoned", F.lit(True)) & F.col("_state").isNotNull()
    top = lambda c, most: F.when(open_ & F.coalesce("_top", F.lit(False)), F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(most))).otherwise(F.coalesce(c, F.lit(0.0)))
    after = both.select(
        "path", F.when(open_, F.col("_state")).otherwise(F.col("state")).alias("state"), (F.coalesce("pinned", F.lit(False)) | (open_ & F.coalesce("_pin", F.lit(False)))).alias("pinned"),
        top("score", PROMOTED_SCORE).alias("score"), top("confidence", PROMOTED_CONFIDENCE).alias("confidence"), F.when(open_, F.col("_seq").cast("double")).otherwise(F.col("last_seen")).alias("last_seen"))
    return after, outside.union(missing)


def status(anchors: DataFrame, preview: int = 10) -> DataFrame:
    """(state, n, shown, omitted): how many anchors are in each state, the paths of the best of them (rank_score, path), and
    how many are not shown. Ranks are cut before they are shuffled."""
    nth = F.row_number().over(Window.partitionBy("state").orderBy(F.desc("rank_score"), "path"))
    best = anchors.withColumn("_n", nth).where(F.col("_n") <= preview).groupBy("state").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "path"))), lambda x: x["path"]).alias("shown"))
    counts = anchors.groupBy(F.col("state").alias("_of")).agg(F.count("*").alias("n"))
    return counts.join(best, F.col("_of") == F.col("state")).select("state", "n", "shown", F.greatest(F.col("n") - preview, F.lit(0)).alias("omitted"))


def invalid(anchors: DataFrame, files: DataFrame) -> DataFrame:
    """(path, warning) of anchors whose path is sensitive or no file (column path) has any more."""
    gone = anchors.select("path").distinct().join(files.select("path"), "path", "left_anti")
    secret = anchors.select("path").distinct().where(classify.sensitive(F.col("path")))
    return gone.select("path", F.lit("no such file").alias("warning")).union(secret.select("path", F.lit("sensitive path").alias("warning")))
