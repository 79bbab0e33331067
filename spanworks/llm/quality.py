"""Quality rules by distribution divergence, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import WORD, join_sized, staged

#: Common words whose shares, with that of all other words, make the word histogram.
COMMON_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "was", "on", "be", "are", "this",
    "der", "die", "und", "das", "von", "mit", "nicht", "ein", "den", "sich",
    "le", "la", "les", "des", "et", "un", "une", "que", "qui", "dans", "pour",
    "el", "los", "las", "por", "con", "para", "se", "no", "de", "en", "es",
]

#: Character classes; what is in none of them counts as one more.
CHAR_CLASSES = ["[a-z]+", "[A-Z]+", "[0-9]+", r"[\x20\x09-\x0D]+", "[.,;:!?'\"()-]+", r"[#*$%&|<>@=_/\\\\{}\[\]~^+]+"]

SYMBOL, REPEAT_WINDOW, MIN_WORDS = "[#*$%&|<>]", 3, 50


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _repeat_words(words: str, bits: str, order: str) -> Column:
    """Words in windows that occur more than once. `order` holds (hash << bits | start), sorted: equal windows adjoin."""
    mask = F.expr(f"(1L << {bits}) - 1")
    start = lambda x: x.bitwiseAND(mask).cast("int")
    same_words = lambda a, b: F.slice(words, start(a) + 1, REPEAT_WINDOW) == F.slice(words, start(b) + 1, REPEAT_WINDOW)
    n = F.size(order)
    pairs = F.zip_with(F.slice(order, 1, n - 1), F.slice(order, 2, n - 1), lambda a, b: F.when(
        (_top(a, bits) == _top(b, bits)) & same_words(a, b), F.array(start(a), start(b))))
    starts = F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))
    folded = F.aggregate(
        starts, F.struct(F.lit(0).alias("n"), F.lit(-REPEAT_WINDOW).alias("last")),
        lambda acc, s: F.struct((acc.n + F.least(F.lit(REPEAT_WINDOW), s - acc.last)).alias("n"), s.alias("last")), lambda acc: acc.n)
    return F.when(n > 1, folded).otherwise(0)


def _top(x: Column, bits: str) -> Column:
    return F.call_function("shiftright", x, F.col(bits))


def features(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, lang, the base figures, and the histograms `chars` and `common` as arrays of counts."""
    text = F.coalesce("text", F.lit(""))
    cut = docs.select("doc_id", "lang", text.alias("text"), _words(text).alias("words"))
    cut = cut.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))).withColumn("n", F.size("words"))
    cut = cut.withColumn("bits", F.when(F.col("n") > 1, F.ceil(F.log2(F.col("n") + 1))).otherwise(1).cast("int"))
    rolled = F.transform(F.slice("hashes", 1, F.greatest(F.col("n") - (REPEAT_WINDOW - 1), F.lit(0))), lambda h, i: F.xxhash64(h, F.get("hashes", i + 1), F.get("hashes", i + 2)))
    cut = cut.withColumn("windows", rolled)
    coded = F.transform("windows", lambda h, i: F.call_function("shiftleft", h, F.col("bits")).bitwiseOR(i.cast("long")))
    cut = cut.withColumn("order", F.sort_array(coded))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    cut = cut.withColumn("lines", lines).withColumn("joined", F.array_join("words", ""))
    cut = cut.withColumn("frequent", F.filter(F.transform("words", lambda w: F.lower(w)), lambda w: w.isin(COMMON_WORDS)))
    n_chars = F.char_length("text").cast("long")
    counts = [(n_chars - F.char_length(F.regexp_replace("text", c, ""))).cast("double") for c in CHAR_CLASSES]
    common = [(F.size("frequent") - F.size(F.array_remove("frequent", x))).cast("double") for x in COMMON_WORDS]
    return (
        cut.select(
            "doc_id", "lang", F.col("n").cast("long").alias("n_words"), F.char_length("joined").cast("long").alias("word_chars"),
            F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            _repeat_words("words", "bits", "order").cast("long").alias("n_repeat_words"),
            n_chars.cast("double").alias("n_chars"), F.array(*counts).alias("chars"), F.array(*common).alias("common"))
        .withColumn("chars", F.concat("chars", F.array(F.col("n_chars") - sum(F.col("chars")[i] for i in range(len(CHAR_CLASSES))))))
        .withColumn("common", F.concat("common", F.array(F.col("n_words") - sum(F.col("common")[i] for i in range(len(COMMON_WORDS))))))
        .drop("n_chars")
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def references(featured: DataFrame) -> DataFrame:
    """(lang, ref_chars, ref_common): summed histograms by language, of the rows that the base rules let through."""
    sums = lambda name, n: F.array(*[F.sum(F.col(name)[i]) for i in range(n)]).alias(f"ref_{name}")
    return featured.where(~base_failed()).groupBy("lang").agg(sums("chars", len(CHAR_CLASSES) + 1), sums("common", len(COMMON_WORDS) + 1))


def with_distance(rows: DataFrame, p: str, q: str, name: str) -> DataFrame:
    """Adds the Jensen-Shannon distance (base 2, 0 to 1) of two arrays of counts; null if either sums to 0."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    rows = rows.withColumn("_p", F.nullif(total(p), F.lit(0.0))).withColumn("_q", F.nullif(total(q), F.lit(0.0)))
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    shares = F.zip_with(F.transform(p, lambda v: v / F.col("_p")), F.transform(q, lambda v: v / F.col("_q")), lambda a, b: F.struct(a.alias("a"), b.alias("b"), ((a + b) / 2).alias("m")))
    parts = F.transform(shares, lambda s: (term(s.a, s.m) + term(s.b, s.m)) / 2)
    known = F.col("_p").isNotNull() & F.col("_q").isNotNull()
    return rows.withColumn(name, F.when(known, F.sqrt(F.greatest(total(parts), F.lit(0.0))))).drop("_p", "_q")


def quality(docs: DataFrame, chars_bound=(0.15, 0.6), common_bound=(0.22, 0.9), both: float = 1.65, reference_words: int = 5000) -> DataFrame:
    """Per row of docs (doc_id, text, lang): the base figures, base_failed, char_distance, word_distance, kept.

    The histograms of character classes and common words are compared by Jensen-Shannon distance with those of the row's
    language over the other rows of the whole table that the base rules let through; with those of all such rows, if lang
    is null or its rows have fewer than `reference_words` words without this one. Short texts scatter more, so a bound is
    a + b / sqrt(words). A row is kept if the base rules let it through, neither distance is above its bound, and the two
    over their bounds add up to `both` at most. Where a histogram or all of its reference is empty, that distance is null
    and counts as 0. Null and empty texts have no words and so fail the base rules. Rows that repeat a doc_id each get a
    row. An empty table gives no rows. Other columns are not read.
    """
    made = staged(features(docs))
    refs = staged(references(made))
    sizes = {"ref_chars": len(CHAR_CLASSES) + 1, "ref_common": len(COMMON_WORDS) + 1}
    pooled = refs.agg(*[F.array(*[F.coalesce(F.sum(F.col(c)[i]), F.lit(0.0)) for i in range(n)]).alias(c) for c, n in sizes.items()]).first()
    rows = join_sized(made, refs.withColumnRenamed("lang", "of"), F.col("lang") == F.col("of"), "left").drop("of")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    others = lambda ref, own: F.when(base_failed(), ref).otherwise(F.zip_with(ref, own, lambda r, o: r - o))
    alone = F.col("ref_common").isNull() | (total(others(F.col("ref_common"), "common")) < reference_words)
    pick = lambda c, own: others(F.when(alone, F.array(*[F.lit(float(v)) for v in pooled[c]])).otherwise(F.col(c)), own)
    rows = rows.withColumns({"q_chars": pick("ref_chars", "chars"), "q_common": pick("ref_common", "common")})
    judged = with_distance(with_distance(rows, "chars", "q_chars", "char_distance"), "common", "q_common", "word_distance")
    over = lambda distance, bound: F.coalesce(distance, F.lit(0.0)) / (bound[0] + bound[1] / F.sqrt(F.greatest("n_words", F.lit(1))))
    chars, common = over("char_distance", chars_bound), over("word_distance", common_bound)
    kept = ~base_failed() & (chars <= 1.0) & (common <= 1.0) & (chars + common <= both)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), kept.alias("kept"), "char_distance", "word_distance")
