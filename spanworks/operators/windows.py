"""Where spans of several lines are found again: windows of lines joined with fingerprints of spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Lines at a span's start and end that make its fingerprint; what equal ends, and equal single lines, count; what is a match.
LINES, END, LINE, LEAST = 8, 4, 1, 4


def _hash(lines: Column) -> Column:
    return F.sha1(F.array_join(lines, "\n"))


def fingerprints(spans: DataFrame) -> DataFrame:
    """(span_id, path, start_line, n, width, prefix, suffix, first, last) of spans (span_id, path, start_line, lines): hashes of
    the first and last LINES lines (all, if fewer) and of the first and last one. Spans without lines have none."""
    rows = spans.where(F.size("lines") > 0).withColumn("n", F.size("lines")).withColumn("width", F.least("n", F.lit(LINES)))
    part = lambda start: _hash(F.slice("lines", start, F.col("width")))
    line = lambda i: F.sha1(F.element_at("lines", i))
    return rows.select("span_id", "path", "start_line", "n", "width", part(F.lit(1)).alias("prefix"), part(F.col("n") - F.col("width") + 1).alias("suffix"), line(1).alias("first"), line(-1).alias("last"))


def line_windows(lines: DataFrame, widths: list[int]) -> DataFrame:
    """(path, line_no, width, hash) of every window of some widths over lines (path, line_no, line). One sort by file makes
    all widths; a file is one group, and no window holds more than LINES lines."""
    ahead = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.currentRow, LINES - 1)
    rows = lines.select("path", "line_no", F.collect_list(F.coalesce("line", F.lit(""))).over(ahead).alias("_next"))
    each = F.array(*[F.struct(F.lit(w).alias("width"), F.when(F.size("_next") >= w, _hash(F.slice("_next", 1, w))).alias("hash")) for w in widths])
    return rows.select("path", "line_no", F.inline(each)).where("hash is not null")


def found_again(wanted: DataFrame, lines: DataFrame) -> DataFrame:
    """(span_id, found_line, score) of fingerprints in the lines of their files as they are now.

    A window that equals a span's first or last lines counts END, an equal first or last line LINE each; places with at least
    LEAST are matches. Of places where both ends fit the first is taken, else the best score, then the place nearest to
    the old one, then the first. Spans without a match, or longer than their file, have no row. Fingerprints meet windows
    by hash, so work grows with lines and matches, not with lines times spans."""
    windows = line_windows(lines, list(range(1, LINES + 1)))
    length = lines.groupBy("path").agg(F.count("*").alias("_lines"))
    ends = wanted.select("*", F.explode(F.array(F.struct(F.lit(True).alias("front"), F.col("prefix").alias("hash")), F.struct(F.lit(False).alias("front"), F.col("suffix").alias("hash")))).alias("end"))
    hits = ends.select("span_id", "path", "start_line", "n", "width", "first", "last", "end.front", "end.hash").join(windows, ["path", "width", "hash"])
    start = F.when(F.col("front"), F.col("line_no")).otherwise(F.col("line_no") + F.col("width") - F.col("n"))
    hits = hits.withColumn("found_line", start).join(length, "path").where("found_line >= 1 and found_line + n - 1 <= _lines")
    places = hits.groupBy("span_id", "path", "start_line", "n", "first", "last", "found_line").agg(F.max("front").alias("front"), F.max(~F.col("front")).alias("back"))
    # An equal end holds its equal line; the line at the other end is looked up.
    single = windows.where("width = 1").select("path", F.col("line_no").alias("_at"), F.col("hash").alias("_line"))
    other = F.when(F.col("front"), F.col("found_line") + F.col("n") - 1).otherwise(F.col("found_line"))
    places = places.withColumn("_at", other).join(single, ["path", "_at"], "left")
    lined = F.col("_line") == F.when(F.col("front"), F.col("last")).otherwise(F.col("first"))
    score = F.when(F.col("front") & F.col("back"), 2 * END + 2 * LINE).otherwise(END + LINE + F.when(lined, LINE).otherwise(0))
    order = [F.desc(F.col("score") >= 2 * END), F.desc("score"), F.when(F.col("score") >= 2 * END, 0).otherwise(F.abs(F.col("found_line") - F.col("start_line"))), "found_line"]
    best = places.withColumn("score", score).withColumn("_n", F.row_number().over(Window.partitionBy("span_id").orderBy(*order))).where("_n = 1")
    return best.select("span_id", F.col("found_line").cast("long").alias("found_line"), F.col("score").cast("long").alias("score"))
