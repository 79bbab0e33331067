"""Spelling variants: words one edit apart, found by an even-partition pigeonhole join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import discard, join_sized, lower_az, staged

#: The letters of a run; code points and occurrences that a word has at least.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Of so many runs, one loses a code point.
ONE_IN = 97
#: A form occurs so many times as often as its word.
RATIO = 2
#: Entries of a segment beyond which it is told apart by the rest of its words too.
BUCKET = 64


def words(docs: DataFrame) -> DataFrame:
    """(word, n) of the texts' words that are long and frequent enough. Runs too short to become one are not taken."""
    runs = F.regexp_extract_all(lower_az(F.coalesce("text", F.lit(""))), F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(runs).alias("run"))
    each = each.withColumn("h", F.crc32(F.concat("d", F.lit(":"), "run"))).withColumn("at", (F.col("h") % F.char_length("run")).cast("int"))
    cut = F.concat(F.substring("run", F.lit(1), F.col("at")), F.substring("run", F.col("at") + 2, F.char_length("run")))
    each = each.select(F.when(F.col("h") % ONE_IN == 0, cut).otherwise(F.col("run")).alias("word"))
    return each.groupBy("word").agg(F.count("*").alias("n")).where((F.char_length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT))


def _cut(word: Column, length: Column) -> tuple[Column, Column]:
    """Code points of the first and of the second half of a word of some length; the second takes the odd one."""
    half = F.floor(length / 2).cast("int")
    return half, (length - half).cast("int")


def _segments(word: str, length: Column, inserted: bool) -> Column:
    """Array of (length, side, segment, rest): the segments that a word of `length` code points shares with this word if
    they are one edit apart, each with what is left of this word. inserted: this word is one longer."""
    w, n = F.col(word), F.char_length(word)
    half, other = _cut(w, length)
    left, right = F.substring(w, F.lit(1), half), F.substring(w, n - other + 1, other)
    entry = lambda side, segment, rest: F.struct(length.cast("int").alias("length"), F.lit(side).alias("side"), segment.alias("segment"), rest.alias("rest"), F.lit(inserted).alias("inserted"))
    return F.array(entry(0, left, F.substring(w, half + 1, n)), entry(1, right, F.substring(w, F.lit(1), n - other)))


def _without_one(text: Column) -> Column:
    """The text without each of its code points, by place: the k-th lacks the k-th."""
    places = F.sequence(F.lit(1), F.char_length(text))
    return F.when(F.char_length(text) > 0, F.transform(places, lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.char_length(text))))).otherwise(F.array().cast("array<string>"))


def links(counted: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, a_n, b, b_n) once for every two words of counted (word, n) that differ by one inserted, deleted or replaced code
    point; a is the shorter one, or the smaller of two as long.

    A word of length l is indexed under its two halves, by l and side. One edit leaves a half as it is, so every near word
    of length l or l + 1 holds it, in its place or, the right half of a longer word, one place on: those it probes.
    Where more than `bucket` words share a half, their other halves differ by one edit, so they are told apart by the
    other half without one code point, by place: then only near words meet, at most an alphabet of them for a key.
    """
    same, longer = F.char_length("word"), F.char_length("word") - 1
    at = ["length", "side", "segment"]
    entries = lambda of: counted.select("word", "n", F.inline(of))
    crowded = staged(entries(_segments("word", same, False)).groupBy(at).count().where(F.col("count") > bucket).drop("count"))
    marked = lambda rows: join_sized(rows, crowded.withColumn("crowded", F.lit(True)), at, "left")
    index = marked(entries(_segments("word", same, False)))
    probe = marked(entries(F.concat(_segments("word", same, False), _segments("word", longer, True))))
    index = index.select(*at, F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("rest").alias("a_rest"), "crowded")
    probe = probe.select(*at, F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("rest").alias("b_rest"), "inserted", "crowded")
    plain = index.where("crowded is null").join(probe.where("crowded is null"), at).where(F.col("inserted") | (F.col("a") < F.col("b")))
    plain = plain.where(F.levenshtein("a", "b", 1) == 1)
    a_keys = F.concat(F.transform(_without_one(F.col("a_rest")), lambda x, i: F.struct(i.alias("place"), x.alias("left"))), F.array(F.struct(F.lit(-1).alias("place"), F.col("a_rest").alias("left"))))
    gone = _without_one(F.col("b_rest"))
    b_keys = F.when(F.col("inserted"), F.transform(F.array_distinct(gone), lambda x: F.struct(F.lit(-1).alias("place"), x.alias("left")))).otherwise(F.transform(gone, lambda x, i: F.struct(i.alias("place"), x.alias("left"))))
    finer = [*at, "place", "left"]
    tight = index.where("crowded").select(*at, "a", "a_n", "a_rest", F.inline(a_keys)).join(probe.where("crowded").select(*at, "b", "b_n", "b_rest", "inserted", F.inline(b_keys)), finer)
    tight = tight.where(F.col("inserted") | (F.col("a") < F.col("b")))
    # A pair that shares both halves, in places, is taken by its left one.
    half, _ = _cut(F.col("a"), F.char_length("a"))
    twice = (F.col("side") == 1) & (F.substring("a", F.lit(1), half) == F.substring("b", F.lit(1), half))
    return plain.where(~twice).select("a", "a_n", "b", "b_n").union(tight.where(~twice).select("a", "a_n", "b", "b_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words of forms (word, form): where forms lead to in the end. Every step doubles the way, so
    there are as many as the logarithm of the longest chain. A word's form occurs more often, so no chain runs in a ring."""
    now = staged(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        after = staged(now.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        moved = after.where("moved").limit(1).count()
        discard(now)
        now = after
        if not moved:
            return now.drop("moved")
        now = now.drop("moved")
        now._staged_at = after._staged_at


def variants(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Per distinct word of docs (doc_id, text): word, form, root, n, n_near, form_n.

    Words are runs of Latin letters, A-Z lower-cased, of which one in ONE_IN (by CRC-32 of doc_id and run) lost a code
    point; those of LEAST_LENGTH code points and LEAST_COUNT occurrences count. A word's form is its most frequent near word
    (ties: the smaller), if it occurs RATIO times as often; its root is where forms lead to.
    Null and empty texts have no words; a null doc_id counts as an empty one. Rows that repeat a doc_id all count. An empty
    table gives no rows. Other columns are not read. Only counts by word are shuffled, then words under their halves; a
    frequent word or a common half is no hot key, as words are distinct by then and crowded halves are told apart.
    """
    counted = staged(words(docs))
    near = links(counted, bucket)
    both = near.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).union(near.select("b", "a", "a_n"))
    found = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("best"))
    found = staged(counted.join(found, "word", "left"))
    fits = -F.col("best.rank") >= RATIO * F.col("n")
    judged = found.select("word", F.when(fits, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, -F.col("best.rank")).alias("form_n"))
    led = roots(judged.where("form is not null"))
    return judged.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
