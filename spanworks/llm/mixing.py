"""Mixing sources to target weights by a time-varying curriculum, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, columns_of, join_sized, staged

WEIGHTS, SHARE, MOST_COPIES = (5.0, 2.0, 1.0), 1.5, 2
#: How steeply a source's weight rises over training, by its place in code point order, repeating.
SLOPES = (-0.5, 0.0, 0.5)
#: Hex digits of the order key that make a range: sources are dealt into 16 ** 4 ranges, so that no task holds a whole one.
RANGE_DIGITS = 4
#: Of these, the digits that make a block of ranges: sums are taken of blocks, then of the ranges in each.
BLOCK_DIGITS = 2


def sizes(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Per row: the columns of `keep` (doc_id and source), size (words of the text), order (a fixed pseudo-random key of
    doc_id and text) and range (its first RANGE_DIGITS digits), the last three prefixed by __sw_."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    order = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))))
    rows = docs.withColumns({"__sw_size": words, "__sw_order": order}).withColumn("__sw_range", F.substring("__sw_order", 1, RANGE_DIGITS))
    return rows.select(*[F.col(f"`{c}`") for c in keep or ["doc_id", "source"]], "__sw_size", "__sw_order", "__sw_range")


def targets(sized: DataFrame) -> DataFrame:
    """Per source: source, source_size, target, slope.

    Sources by code point, null last, weigh WEIGHTS, repeating, and share SHARE of all sizes; none gets more than
    MOST_COPIES of its own size, and what is beyond goes to the others by weight. With the sources ordered by cap over
    weight, those before some place are capped and the others share the rest; the place is where that is consistent.
    """
    by_name, by_cap = Window.orderBy(F.col("source").isNull(), "source"), Window.orderBy("ratio", "rank")
    at = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("rank") % len(values) + 1).cast("int"))
    own = sized.groupBy("source").agg(F.sum("__sw_size").alias("source_size")).withColumn("rank", F.row_number().over(by_name) - 1)
    own = own.withColumn("weight", at(WEIGHTS)).withColumn("slope", at(SLOPES)).withColumn("cap", F.lit(float(MOST_COPIES)) * F.col("source_size"))
    own = own.withColumn("ratio", F.col("cap") / F.col("weight"))
    whole, before, rest = Window.partitionBy(), by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    free = (F.lit(SHARE) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    level = own.withColumn("free", free).withColumn("level", F.min(F.when(F.col("free") <= F.col("ratio"), F.struct("ratio", "rank", "free"))).over(whole).free)
    return level.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"), "slope")


def time_of(share: Column, slope: Column) -> Column:
    """The time, 0 to 1, by which a source has had `share` of its tokens. Its weight is 1 + slope * (2t - 1), of which
    the integral t + slope * (t * t - t) is the demand met by t; this is its inverse."""
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share)
    return F.when(slope == 0, share).otherwise((root - (1 - slope)) / (2 * slope))


def _placed(rows: DataFrame, sized: DataFrame, goal: DataFrame) -> DataFrame:
    """rows (as sizes() makes them) with __sw_goal (source_size, target, slope), __sw_first and __sw_second (words taken in
    the first and second pass) and their positions in training, null if none."""
    # A key without nulls: joins and windows by it and the range share one shuffle of the rows.
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-")).alias("__sw_key")
    block = F.substring("__sw_range", 1, BLOCK_DIGITS).alias("block")
    sums = sized.groupBy(key, block, "__sw_range").agg(F.sum("__sw_size").alias("n"))
    before = lambda n, *by: F.coalesce(F.sum(n).over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = sums.groupBy("__sw_key", "block").agg(F.sum("n").alias("m")).select("__sw_key", "block", before("m", "__sw_key", "block").alias("base"))
    ahead = F.col("base") + before("n", "__sw_key", "block", "__sw_range")
    offsets = sums.join(blocks, ["__sw_key", "block"]).select("__sw_key", "__sw_range", ahead.alias("__sw_ahead"))
    placed = rows.select("*", key).join(offsets, ["__sw_key", "__sw_range"])
    line = Window.partitionBy("__sw_key", "__sw_range").orderBy("__sw_order", "__sw_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("__sw_start", F.col("__sw_ahead") + F.sum("__sw_size").over(line) - F.col("__sw_size")).drop("__sw_ahead")
    goal = goal.select(key, F.struct("source_size", "target", "slope").alias("__sw_goal"))
    placed = join_sized(placed, goal, "__sw_key")
    words, again = F.round("__sw_goal.target").cast("long"), F.col("__sw_start") + F.col("__sw_goal.source_size")
    part = lambda start: F.least(F.greatest(words - start, F.lit(0)), F.col("__sw_size"))
    time = lambda start, n: F.when(n > 0, time_of(start / F.col("__sw_goal.target"), F.col("__sw_goal.slope")) + 0.0)
    placed = placed.withColumns({"__sw_first": part(F.col("__sw_start")), "__sw_second": part(again)})
    return placed.withColumns({"__sw_position": time(F.col("__sw_start"), F.col("__sw_first")), "__sw_next": time(again, F.col("__sw_second"))})


def mix(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text, source): doc_id, source, size, source_size, target, taken, position, next_position.

    A source's documents line up by a hash of doc_id and text, pass after pass, until the words in line reach its target
    (rounded); the last one is cut there, so a source's `taken` add up to its target. No document is taken over twice.
    A copy's position is the training time at which the source's demand reaches its first word; the rows come sorted by
    the first copy's position (range-partitioned), documents not taken last.
    Null and empty texts have size 0: taken 0, no position. A null source is a source of its own, last in order. Rows
    that repeat a doc_id, and rows without one, are rows of their own; rows equal in doc_id and text are taken one after
    the other and interchangeable. An empty table gives no rows. Other columns are not read. The text is read once; the
    line is summed by ranges first, so that the largest window holds 1/65536 of a source.
    """
    sized = staged(sizes(docs))
    placed = _placed(sized, sized, staged(targets(sized)))
    timed = placed.select(
        "doc_id", "source", F.col("__sw_size").alias("size"), "__sw_goal.source_size", "__sw_goal.target", (F.col("__sw_first") + F.col("__sw_second")).alias("taken"),
        F.col("__sw_position").alias("position"), F.col("__sw_next").alias("next_position"), "__sw_order")
    return timed.orderBy(F.col("position").asc_nulls_last(), "__sw_order").drop("__sw_order")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs as the mix has them: a row for each copy of which at least half is taken, whole, in training order.

    Every row is placed by itself: rows that repeat a doc_id, and rows without one, have copies of their own. Rows with
    null or empty texts hold no words and go. A null source is a source of its own. Other columns pass through. An empty
    table gives no rows."""
    sized = staged(sizes(docs))
    placed = _placed(sizes(docs, docs.columns), sized, staged(targets(sized)))
    each = F.array(F.struct(F.col("__sw_first").alias("words"), F.col("__sw_position").alias("position")), F.struct(F.col("__sw_second").alias("words"), F.col("__sw_next").alias("position")))
    kept = F.transform(F.filter(each, lambda x: (x.words > 0) & (2 * x.words >= F.col("__sw_size"))), lambda x: x.position)
    columns = columns_of(docs)
    copies = placed.select(*columns, "__sw_order", F.explode(kept).alias("__sw_position"))
    return copies.orderBy("__sw_position", "__sw_order").select(*columns)
