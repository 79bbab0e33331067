"""Which of nested intervals encloses a point most closely."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def innermost(points: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """points (key, pos, ...) with owner: the id of the innermost interval (key, id, start, stop, both ends inside) around
    each; null if none is.

    The intervals of a key are nested or apart. Opens, points and closes are swept in order: the running sum of opens less
    closes is a point's depth, and the interval that opened last at that depth is the one around it. Two window passes,
    whatever the overlap; no pairs of points and intervals are made. Of equal intervals the one of the largest id is the
    innermost. Points with a null key or place have no owner."""
    at = lambda rows, pos, step, order, **more: rows.select(F.col(key).alias("_key"), pos.cast("long").alias("_pos"), F.lit(step).alias("_step"), F.lit(order).alias("_order"), *[v.alias(k) for k, v in more.items()])
    none, no_row = F.lit(None).cast(intervals.schema["id"].dataType), F.lit(None).cast("struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in points.schema) + ">")
    size = F.col("stop") - F.col("start")
    opens = at(intervals, F.col("start"), 1, 0, _size=-size, _id=F.col("id"), _row=no_row)
    closes = at(intervals, F.col("stop"), -1, 2, _size=size, _id=none, _row=no_row)
    marks = at(points, F.col("pos"), 0, 1, _size=F.lit(0).cast("long"), _id=none, _row=F.struct(*[F.col(f"`{c}`") for c in points.columns]))
    # Of what opens at one place the longest opens first.
    line = Window.partitionBy("_key").orderBy("_pos", "_order", "_size", "_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = opens.unionByName(marks).unionByName(closes).withColumn("_depth", F.sum("_step").over(line))
    last = F.last(F.col("_id"), ignorenulls=True).over(Window.partitionBy("_key", "_depth").orderBy("_pos", "_order", "_size", "_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    owned = swept.where("_step >= 0").withColumn("_owner", F.when((F.col("_depth") > 0) & F.col("_key").isNotNull() & F.col("_pos").isNotNull(), last))
    return owned.where("_step = 0").select("_row.*", F.col("_owner").alias("owner"))


def nested(marks: DataFrame, key: str) -> DataFrame:
    """(key, id, start, stop) of opens and closes (key, pos, name, opens): a close ends the last open of its name that is
    not closed yet. Without a close an open has no interval, and a close without an open none."""
    line = Window.partitionBy(key, "name").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    depth = F.sum(F.when(F.col("opens"), 1).otherwise(-1)).over(line)
    level = marks.withColumn("_depth", depth + F.when(F.col("opens"), 0).otherwise(1))
    after = F.lead(F.struct("pos", "opens")).over(Window.partitionBy(key, "name", "_depth").orderBy("pos"))
    ended = level.withColumn("_next", after).where(F.col("opens") & ~F.col("_next.opens"))
    return ended.select(key, F.col("pos").alias("id"), F.col("pos").alias("start"), F.col("_next.pos").alias("stop"), "name")


def callers(callsites: DataFrame, symbols: DataFrame, aliases: DataFrame) -> DataFrame:
    """(path, line, label, target_id, caller_id, resolved_by, confidence) of callsites (path, line, label).

    The target is what an import alias (path, label, target_id) of the file names, else a symbol (span_id, path, kind, label,
    start_line, end_line) of that label in the file, else the first of that label anywhere (by span_id). The caller is the
    innermost symbol around the line. Calls without a target or caller, and of a symbol by itself at its own line, go."""
    own = symbols.groupBy("path", "label").agg(F.min("span_id").alias("_own"))
    anywhere = symbols.groupBy("label").agg(F.min("span_id").alias("_any"))
    alias = aliases.groupBy("path", "label").agg(F.min("target_id").alias("_alias"))
    named = callsites.join(alias, ["path", "label"], "left").join(own, ["path", "label"], "left").join(anywhere, "label", "left")
    named = named.withColumn("target_id", F.coalesce("_alias", "_own", "_any")).where("target_id is not null")
    around = symbols.where("kind <> 'code.module'").select("path", F.col("span_id").alias("id"), F.col("start_line").alias("start"), F.col("end_line").alias("stop"))
    rows = innermost(named.withColumn("pos", F.col("line")), around, "path").where("owner is not null")
    by = F.when(F.col("_alias").isNotNull(), "import_alias").otherwise("label")
    return rows.select("path", "line", "label", "target_id", F.col("owner").alias("caller_id"), by.alias("resolved_by"), F.when(F.col("_alias").isNotNull(), 0.96).otherwise(0.9).alias("confidence"))
