"""Where spans of an earlier snapshot are found again."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import classify

#: Steps by equal keys, in order; all are within one path.
EXACT = (("text_hash", ("path", "text_hash")), ("anchor_kind", ("path", "anchor", "kind")), ("heading_block_kind", ("path", "heading", "ordinal", "kind")))
FUZZY, NEAREST = 0.72, 0.5


def _words(rows: DataFrame, tag: str) -> DataFrame:
    listed = rows.withColumn("_w", classify.words(F.col("text")))
    return listed.select(*[F.col(c).alias(f"{tag}_{c}") for c in ("span_id", "path", "kind", "heading", "nearby")], F.size("_w").alias(f"{tag}_size"), F.explode("_w").alias(f"{tag}_word"))


def relocated(previous: DataFrame, candidates: DataFrame) -> DataFrame:
    """(span_id, step, outcome, found_id) for each previous span, among the candidates of its path.

    Both have span_id, path, kind, anchor, heading, ordinal, nearby (a hash of the nearest heading), text_hash and text. The
    first step with a match decides: equal text; equal anchor and kind; equal heading, ordinal and kind; equal heading and
    kind with a Dice similarity of at least FUZZY; equal nearby and kind with the best similarity, if at least NEAREST. One
    match: `relocated`, and found_id; several: `ambiguous`; no step with a match: step null, `not_found`. Nulls match nothing.

    Exact steps look up counts of candidates by key, never pairs. Only what they leave open is compared by words, as an
    equi-join on path, kind and word whose hits are counted by pair.
    """
    rows = previous
    for step, keys in EXACT:
        found = candidates.groupBy(*keys).agg(F.count("*").alias(f"_n_{step}"), F.min("span_id").alias(f"_id_{step}"))
        rows = rows.join(found, list(keys), "left")
    told = F.coalesce(*[f"_n_{step}" for step, _ in EXACT])
    left = rows.where(told.isNull())
    near = candidates.join(left.select("path").distinct(), "path", "left_semi")
    ours, theirs = _words(left, "p"), _words(near, "c")
    same_heading, same_nearby = (F.coalesce(F.col(f"p_{c}") == F.col(f"c_{c}"), F.lit(False)) for c in ("heading", "nearby"))
    on = (F.col("p_path") == F.col("c_path")) & (F.col("p_kind") == F.col("c_kind")) & (F.col("p_word") == F.col("c_word")) & (same_heading | same_nearby)
    shared = ours.join(theirs, on).groupBy("p_span_id", "c_span_id", "p_size", "c_size", same_heading.alias("heading"), same_nearby.alias("nearby")).agg(F.count("*").alias("n"))
    dice = shared.withColumn("dice", F.lit(2.0) * F.col("n") / (F.col("p_size") + F.col("c_size")))
    fuzzy, nearest = F.col("heading") & (F.col("dice") >= FUZZY), F.col("nearby") & (F.col("dice") >= NEAREST)
    marked = dice.where(fuzzy | nearest).select(F.col("p_span_id").alias("span_id"), F.col("c_span_id").alias("id"), "dice", fuzzy.alias("fuzzy"), nearest.alias("nearest"))
    by_score = marked.groupBy("span_id", "dice").agg(*[g for m in ("fuzzy", "nearest") for g in (F.count_if(m).alias(f"n_{m}"), F.min(F.when(F.col(m), F.col("id"))).alias(f"id_{m}"))])
    best = F.max(F.when(F.col("n_nearest") > 0, F.struct("dice", "n_nearest", "id_nearest")))
    similar = by_score.groupBy("span_id").agg(F.sum("n_fuzzy").alias("n"), F.min("id_fuzzy").alias("id"), best.alias("best"))
    similar = similar.select(
        "span_id", F.when(F.col("n") > 0, F.col("n")).alias("_n_heading_fuzzy_text"), F.col("id").alias("_id_heading_fuzzy_text"),
        F.col("best.n_nearest").alias("_n_nearest_heading_similarity"), F.col("best.id_nearest").alias("_id_nearest_heading_similarity"))
    steps = [*(step for step, _ in EXACT), "heading_fuzzy_text", "nearest_heading_similarity"]
    each = [F.when(F.col(f"_n_{s}").isNotNull(), F.struct(F.lit(s).alias("step"), F.col(f"_n_{s}").alias("n"), F.col(f"_id_{s}").alias("id"))) for s in steps]
    first = rows.join(similar, "span_id", "left").select("span_id", F.coalesce(*each).alias("x"))
    outcome = F.when(F.col("x").isNull(), "not_found").when(F.col("x.n") == 1, "relocated").otherwise("ambiguous")
    return first.select("span_id", F.col("x.step").alias("step"), outcome.alias("outcome"), F.when(F.col("x.n") == 1, F.col("x.id")).alias("found_id"))
