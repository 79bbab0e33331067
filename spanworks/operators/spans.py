"""Ordinals, ranges and first-wins choices over spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def block_ordinals(rows: DataFrame, path: str, order: str) -> DataFrame:
    """Adds `ordinal`, from 0 within the path."""
    return rows.withColumn("ordinal", (F.row_number().over(Window.partitionBy(path).orderBy(order)) - 1).cast("long"))


def section_ranges(rows: DataFrame, path: str, line: str, opens: Column) -> DataFrame:
    """(path, start_line, end_line) of sections: from a row that opens one to the row before the next."""
    heads = rows.where(opens)
    last = rows.groupBy(path).agg(F.max(line).alias("_last"))
    following = F.lead(line).over(Window.partitionBy(path).orderBy(line))
    ranged = heads.withColumn("_next", following).join(last, path)
    return ranged.select(path, F.col(line).alias("start_line"), F.coalesce(F.col("_next") - 1, "_last").alias("end_line"))


def heading_of(rows: DataFrame, path: str, line: str, opens: Column, label: Column) -> DataFrame:
    """Adds `heading`: the label of the nearest opening row above or at each row."""
    above = Window.partitionBy(path).orderBy(line).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("heading", F.last(F.when(opens, label), ignorenulls=True).over(above))


def nested_sections(rows: DataFrame, path: str, line: str, depth: str) -> DataFrame:
    """(path, start_line, depth, end_line): headings up to the next of their depth or less. Per depth one window, no
    join of headings with each other."""
    out = rows
    upward = Window.partitionBy(path).orderBy(F.desc(line)).rowsBetween(Window.unboundedPreceding, -1)  # linear; a frame to the last row is not
    next_of = [F.min(F.when(F.col(depth) <= d, F.col(line))).over(upward) for d in range(1, 7)]
    chosen = F.coalesce(*[F.when(F.col(depth) == d, n) for d, n in enumerate(next_of, 1)])
    return out.withColumn("_next", chosen).select(path, F.col(line).alias("start_line"), depth, (F.col("_next") - 1).alias("end_line"))


def first_wins(rows: DataFrame, key: list[str], *order) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def overload_names(rows: DataFrame, name: str, *order) -> DataFrame:
    """Adds `overload`, the ordinal within the name, and `full_name`, with `#overloadN` from the second on."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(*order)).cast("long")
    return rows.withColumn("overload", n).withColumn("full_name", F.when(F.col("overload") == 1, F.col(name)).otherwise(F.concat(name, F.lit("#overload"), F.col("overload").cast("string"))))


def duplicate_slugs(rows: DataFrame, path: str, base: str, *order) -> DataFrame:
    """Adds `anchor`: the slug, with `-n` from the second of a path on."""
    n = F.row_number().over(Window.partitionBy(path, base).orderBy(*order)) - 1
    return rows.withColumn("_n", n).withColumn("anchor", F.when(F.col("_n") == 0, F.col(base)).otherwise(F.concat(base, F.lit("-"), F.col("_n").cast("string")))).drop("_n")


def greedy_budget(targets: Column, budget: Column) -> Column:
    """Of an array of structs with `cost` in priority order: those kept if the running cost stays within the budget,
    going on after one that does not fit; the first is always kept."""
    empty = F.filter(targets, lambda t: F.lit(False))
    start = F.struct(F.lit(0).cast("long").alias("used"), empty.alias("kept"))
    step = lambda acc, t: F.when((F.size(acc["kept"]) == 0) | (acc["used"] + t["cost"] <= budget), F.struct((acc["used"] + t["cost"]).alias("used"), F.concat(acc["kept"], F.array(t)).alias("kept"))).otherwise(acc)
    return F.aggregate(targets, start, step, lambda acc: acc["kept"])


def segments(start: Column, end: Column, most: int) -> Column:
    """An array of (start_line, end_line): the lines from `start` to `end` by `most`; empty if there are none."""
    first = F.when(start <= end, F.sequence(start.cast("long"), end.cast("long"), F.lit(most).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(first, lambda s: F.struct(s.alias("start_line"), F.least(end, s + most - 1).cast("long").alias("end_line")))


def nearest_segment(segments: Column, focus: Column) -> Column:
    """The segment whose middle is nearest to the line `focus`, of equally near ones the first; null if there are none."""
    ranked = F.transform(segments, lambda s: F.struct(F.abs((s.start_line + s.end_line) / 2 - focus).alias("far"), s.start_line.alias("start_line"), s.end_line.alias("end_line")))
    best = F.array_min(ranked)
    return F.struct(best.start_line.alias("start_line"), best.end_line.alias("end_line"))
