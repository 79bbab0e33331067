"""License scans by diagonal voting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import lower_az

LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Fixed values: (label, words, least share of the words that a place must show). Those of share 1 are stated phrases.
BASE_PHRASES = [
    ("gpl", "gnu general public license", 1.0),
    ("apache", "apache license", 1.0),
    ("cc-by", "cc by", 1.0),
    ("mit", "mit license", 1.0),
]
NOTICES = [
    ("agpl", "gnu affero general public license", 1.0),
    ("apache", "licensed under the apache license version 2 0", 0.8),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided", 0.7),
    ("bsl", "boost software license version 1 0", 0.8),
    ("cc-by-nc", "cc by nc", 1.0),
    ("cc-by-nd", "cc by nd", 1.0),
    ("cc-by-sa", "cc by sa", 1.0),
    ("cc0", "cc0 1 0 universal", 1.0),
    ("epl", "eclipse public license", 1.0),
    ("gpl", "this work is licensed under the gnu general public license version 3", 0.8),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", 0.7),
    ("lgpl", "gnu lesser general public license", 1.0),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", 0.7),
    ("mit", "released under the mit license", 0.8),
    ("mpl", "mozilla public license", 1.0),
    ("proprietary", "all rights reserved", 1.0),
    ("unlicense", "this is free and unencumbered software released into the public domain", 0.7),
]


def template_positions(spark, templates: list[tuple[str, str, float]], k: int) -> DataFrame:
    """(gram, template, place): the k-grams of the templates, as many rows as the templates given have words."""
    rows = []
    for i, (_, text, _) in enumerate(templates):
        words = text.split()
        if len(words) < k:
            raise ValueError(f"a template needs {k} words at least: {text!r}")
        rows += [(" ".join(words[j : j + k]), i, j) for j in range(len(words) - k + 1)]
    return spark.createDataFrame(rows, "gram string, template int, place int")


def scan(docs: DataFrame, templates: list[tuple[str, str, float]] | None = None, k: int = 2, slack: int = 2) -> DataFrame:
    """Places where documents show license templates.

    Every rolling k-gram of every text is joined by its hash to the template positions (and compared as text, so no
    collision counts); the hits vote for a diagonal, the document position less the template position. Diagonals of a
    template within `slack` words of each other that follow on in the text merge into one span, so that a span survives
    a word left out or put in. A span is verified by the share of the template's k-grams that it shows; a template whose
    whole must be shown counts on single diagonals only, so that its words stand consecutively.

    Returns one row per row of docs (doc_id, text): doc_id, n_words, spans, an array of
    (template, label, first_word, last_word, coverage), sorted. Null and empty texts have 0 words and no span. Rows that
    repeat a doc_id stay apart. A null doc_id stays null. An empty table gives no rows. Other columns are not read.
    Templates are parameters, so their positions may be broadcast: as many rows as their words. Only hits are shuffled,
    after a combine by diagonal; a text's own row travels with them as a hit of the empty gram.
    """
    templates = BASE_PHRASES + NOTICES if templates is None else templates
    spark = docs.sparkSession
    words = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.regexp_extract_all(lower_az(F.coalesce("text", F.lit(""))), F.lit(LICENSE_WORD), F.lit(0)).alias("words"))
    n = F.greatest(F.size("words") - (k - 1), F.lit(0))
    grams = F.slice("words", 1, n)
    for d in range(1, k):
        grams = F.zip_with(grams, F.slice("words", 1 + d, n), lambda a, b: F.concat(a, F.lit(" "), b))
    rolled = words.select("row", "doc_id", F.size("words").alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), grams)).alias("at", "gram"))
    rolled = rolled.withColumn("hash", F.xxhash64("gram"))
    places = template_positions(spark, templates, k).union(spark.createDataFrame([("", -1, 0)], "gram string, template int, place int"))
    places = places.select(F.xxhash64("gram").alias("hash"), F.col("gram").alias("text_gram"), "template", "place")
    hits = rolled.join(F.broadcast(places), "hash").where("gram = text_gram")
    diagonals = hits.groupBy("row", "doc_id", "n_words", "template", (F.col("at") - 1 - F.col("place")).alias("diagonal")).agg(
        F.min("at").alias("start"), F.max("at").alias("end"), F.collect_set("place").alias("places"))
    by_place = Window.partitionBy("row", "template").orderBy("start", "diagonal")
    step = (F.abs(F.col("diagonal") - F.lag("diagonal").over(by_place)) > slack) | (F.col("start") > F.lag("end").over(by_place) + k + slack)
    apart = F.col("places_of") == F.size("places")  # a whole template stands by itself
    size = {i: len(text.split()) - k + 1 for i, (_, text, _) in enumerate(templates)}
    of = lambda values, kind: F.element_at(F.create_map(*[F.lit(x).cast(kind) if j % 2 else F.lit(x) for kv in values.items() for j, x in enumerate(kv)]), F.col("template"))
    known = {i: label for i, (label, _, _) in enumerate(templates)}
    share = {i: x for i, (_, _, x) in enumerate(templates)}
    diagonals = diagonals.withColumn("places_of", F.coalesce(of(size, "int"), F.lit(1)))
    merged = (
        diagonals.where((F.col("template") < 0) | (of(share, "double") < 1) | apart)
        .withColumn("opens", F.coalesce(step, F.lit(True)) | apart | F.coalesce(F.lag(apart).over(by_place), F.lit(False)))
        .withColumn("span", F.sum(F.col("opens").cast("int")).over(by_place))
        .groupBy("row", "doc_id", "n_words", "template", "span", "places_of")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("shown"))
        .withColumn("coverage", F.col("shown") / F.col("places_of"))
    )
    span = F.struct("template", of(known, "string").alias("label"), (F.col("start") - 1).cast("long").alias("first_word"), (F.col("end") + k - 2).cast("long").alias("last_word"), "coverage")
    holds = (F.col("template") >= 0) & (F.col("coverage") >= of(share, "double"))
    return merged.groupBy("row", "doc_id").agg(F.max("n_words").cast("long").alias("n_words"), F.array_sort(F.collect_list(F.when(holds, span))).alias("spans")).drop("row")


def license_report(docs: DataFrame) -> DataFrame:
    """Per row of docs: n_words; n_base, first_word, last_word and base_labels of the base phrases; labels with those of
    the notices; score, the best coverage of a verified span (0: none)."""
    n = len(BASE_PHRASES)
    found = scan(docs).withColumn("base", F.filter("spans", lambda s: s.template < n))
    joined = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s.label))), ",")
    starts = F.transform("base", lambda s: s.first_word)
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined("base").alias("base_labels"), joined("spans").alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda s: s.coverage)), F.lit(0.0)).alias("score"))
