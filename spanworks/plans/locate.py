"""The whole way of a batch of requests, from their terms over routes, boundaries and scores to targets and a coverage plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import requests, scoring
from ..operators import locate
from ..sources import corpus, tables
from ..sources.corpus import SEARCHED, SPANS_SQL
from ..sources.store import staged
from .registry import query

_FIELDS = ["exact", "config", "symbol", "doc", "feature", "old", "new"]
_SHOWN = f"concat_ws(chr(10), {', '.join(SEARCHED)})"
_SHOWN_S = f"concat_ws(chr(10), {', '.join('s.' + c for c in SEARCHED)})"
_TOKENS = lambda c: rf"array_to_string(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+'), ' ')"
_WORDS = " || chr(10) || ".join(f"' ' || {_TOKENS(c)} || ' '" for c in SEARCHED)
_ANY = lambda terms, text: f"len(list_filter({terms}, lambda t: contains({text}, t))) > 0"
_HITS = lambda terms, text: f"len(list_filter({terms}, lambda t: contains({text}, lower(t))))"
_LOWER = lambda *lists: f"list_transform(flatten([{', '.join(lists)}]), lambda t: lower(t))"
_NAMED = r"(contains(t, '/') OR regexp_matches(t, '\.[A-Za-z0-9]+$'))"
_SMALL = lambda x: rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', '', 'g')"
_STRENGTH = f"""CASE WHEN lower(path) = lower(t) OR ends_with(lower(path), '/' || lower(t)) THEN 42 WHEN lower(regexp_extract(path, '[^/]*$')) = lower(t) THEN 24 WHEN contains(lower(path), lower(t)) THEN 10
  WHEN length({_SMALL("t")}) >= 4 AND stem = {_SMALL("t")} THEN 34 WHEN length({_SMALL("t")}) >= 6 AND (contains(stem, {_SMALL("t")}) OR contains({_SMALL("t")}, stem)) THEN 18 ELSE 0 END"""
_EXACT_PATH = "len(list_filter(path_terms, lambda t: lower(path) = lower(t) OR ends_with(lower(path), '/' || lower(t)))) > 0"
_WEIGHT = "CASE r " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in scoring.ROUTE_WEIGHTS.items()) + " ELSE 1 END"
_PARTS = ["exact_term", "symbol_match", "heading_match", "config_key", "path_role", "link_confidence", "feature_relevance", "canonicality", "coverage_diversity", "kind_precision", "route_fusion", "freshness", "boundary_risk", "deprecation", "redaction"]

LOCATED = rf"""{SPANS_SQL}, {requests.terms_sql("benchmark", "item_id")},
asked AS (SELECT *, path AS path_terms, flatten([path, symbol, config, old, exact, feature]) AS every FROM requests),
listed AS (SELECT *, list_filter(every, lambda w, i: list_position(every, w) = i AND length(trim(w)) >= 2)[1:{locate.MOST_TERMS}] AS words FROM asked),
lists AS (SELECT *, flatten([path, list_filter(words, lambda w: contains(w, '.') OR contains(w, '/') OR contains(w, '_'))]) AS in_paths FROM listed),
word_terms AS (SELECT item_id, lower(unnest(words)) AS low, unnest(range(len(words))) AS ordinal FROM lists),
path_terms AS (SELECT item_id, lower(unnest(list_filter(in_paths, lambda w, i: list_position(in_paths, w) = i))) AS low, unnest(range(len(list_distinct(in_paths)))) AS ordinal FROM lists),
hay AS MATERIALIZED (SELECT span_id, path, start_line, lower({_SHOWN}) AS low_text, {_WORDS} AS words_text FROM spans),
lows AS (SELECT DISTINCT low, {_TOKENS("low")} AS phrase FROM word_terms),
phrases AS (SELECT low, span_id, row_number() OVER (PARTITION BY low ORDER BY path, start_line, span_id) AS rank FROM lows JOIN hay ON phrase <> '' AND contains(words_text, ' ' || phrase || ' ') QUALIFY rank <= 100),
parts_found AS (SELECT low, span_id, row_number() OVER (PARTITION BY low ORDER BY path, start_line, span_id) AS rank FROM lows JOIN hay ON contains(low_text, low) QUALIFY rank <= 100),
path_found AS (SELECT low, span_id, row_number() OVER (PARTITION BY low ORDER BY CASE WHEN lower(path) = low THEN 0 WHEN ends_with(lower(path), '/' || low) THEN 1 ELSE 2 END, length(path), path, start_line, span_id) AS rank
  FROM (SELECT DISTINCT low FROM path_terms) JOIN spans ON contains(lower(path), low) QUALIFY rank <= CASE WHEN contains(low, '/') OR regexp_matches(low, '\.[A-Za-z0-9]+$') THEN 700 ELSE 100 END),
routed AS (SELECT item_id, span_id, 2 AS step, ordinal, 0 AS part, rank, 'path_role_expansion' AS route FROM path_terms JOIN path_found USING (low)
  UNION ALL SELECT item_id, span_id, 4, ordinal, 0, rank, 'fts_lexical' FROM word_terms JOIN phrases USING (low) UNION ALL SELECT item_id, span_id, 4, ordinal, 1, rank, 'fts_lexical' FROM word_terms JOIN parts_found USING (low)),
caps AS (SELECT item_id, CASE WHEN len(list_filter(path_terms, lambda t: {_NAMED})) > 0 THEN 800 ELSE 400 END AS cap FROM asked),
firsts AS (SELECT item_id, span_id, row_number() OVER (PARTITION BY item_id ORDER BY min([step, ordinal, part, rank]), span_id) AS place FROM routed GROUP BY item_id, span_id),
taken AS (SELECT f.* FROM firsts f JOIN caps USING (item_id) WHERE place <= cap),
edges AS (SELECT heading_id AS source_id, span_id AS target_id FROM spans WHERE heading_id <> span_id),
near AS (SELECT item_id, source_id, target_id, row_number() OVER (PARTITION BY item_id ORDER BY source_id, target_id) AS rank FROM (
  SELECT DISTINCT item_id, source_id, target_id FROM taken JOIN edges ON span_id = source_id OR span_id = target_id WHERE place <= {locate.MOST_SEEDS}) QUALIFY rank <= 1000),
reached AS (SELECT item_id, source_id AS span_id, rank, 0 AS part FROM near UNION ALL SELECT item_id, target_id, rank, 1 FROM near),
both_found AS (SELECT item_id, span_id, [0, place, 0] AS spot FROM taken UNION ALL SELECT item_id, span_id, [5, rank, part] FROM reached),
places AS (SELECT item_id, span_id, row_number() OVER (PARTITION BY item_id ORDER BY min(spot), span_id) AS place FROM both_found GROUP BY item_id, span_id),
chosen AS (SELECT p.* FROM places p JOIN caps USING (item_id) WHERE place <= cap),
found AS (SELECT item_id, span_id, min(step) AS step, route FROM (SELECT item_id, span_id, step, route FROM routed SEMI JOIN taken USING (item_id, span_id) UNION ALL SELECT item_id, span_id, 5, 'cross_reference_edge' FROM reached) GROUP BY item_id, span_id, route),
candidates AS (SELECT s.*, a.* EXCLUDE (path, words, every, in_paths), lower({_SHOWN_S}) AS low_all, {_SHOWN_S} AS all_text, {_SMALL(r"regexp_replace(regexp_extract(s.path, '[^/]*$'), '\.[^.]+$', '')")} AS stem,
    s.span_id IN (SELECT source_id FROM edges) OR s.span_id IN (SELECT target_id FROM edges) AS linked FROM chosen c JOIN spans s USING (span_id) JOIN lists a USING (item_id)),
owned AS (SELECT item_id, span_id, unnest([CASE WHEN {_ANY(_LOWER("exact"), "low_all")} THEN 'fts_lexical' END, CASE WHEN {_ANY(_LOWER("doc", "symbol", "feature"), "low_all")} THEN 'markdown_heading_anchor_inline_code' END,
    CASE WHEN {_ANY("old", "all_text")} THEN 'old_term_sweep' END]) AS route, unnest([11, 12, 13]) AS step FROM candidates),
routes AS (SELECT item_id, span_id, list(route ORDER BY step) AS routes FROM (SELECT item_id, span_id, route, min(step) AS step FROM (SELECT item_id, span_id, route, step FROM found UNION ALL SELECT item_id, span_id, route, step FROM owned WHERE route IS NOT NULL) GROUP BY ALL) GROUP BY item_id, span_id),
weighed AS (SELECT *, least({_HITS("exact", "low_all")}, 5) + least({_HITS("symbol", "lower(concat_ws(chr(10), label, text, symbol_path))")}, 5) + least({_HITS("config", "lower(concat_ws(chr(10), label, text, metadata))")}, 5) AS evidence,
    lower(concat_ws(chr(10), path, label, kind, role, heading, text)) AS low, concat_ws(chr(10), path, label, heading, text) AS shown, list_distinct(flatten([exact, symbol, feature])) AS told FROM candidates JOIN routes USING (item_id, span_id)),
points AS (SELECT *, {_HITS("list_filter(list_transform(told, lambda t: lower(t)), lambda t: length(t) >= 4 AND t NOT IN ('find', 'document', 'paragraph', 'defines', 'that', 'this', 'with', 'requested', 'direct') AND NOT contains(t, '.') AND NOT ends_with(t, '_'))", "lower(text)")} AS told_hits,
    list_has_any(doc, ['table', 'row', 'rows']) AS wants_table, contains(lower(raw), 'paragraph') AS wants_paragraph FROM weighed),
scored AS (SELECT *, least(20, 5 * {_HITS("exact", "low")}) AS exact_term, CASE WHEN {_ANY("symbol", "shown")} THEN 15 ELSE 0 END AS symbol_match,
    CASE WHEN {_ANY(_LOWER("doc", "feature"), "lower(concat_ws(' ', label, heading))")} THEN 10 ELSE 0 END AS heading_match, CASE WHEN {_ANY("config", "shown")} THEN 8 ELSE 0 END AS config_key,
    least(56, greatest(CASE WHEN length(stem) >= 4 AND contains({_SMALL("raw")}, stem) THEN 36 ELSE 0 END, coalesce(list_max(list_transform(path_terms, lambda t: {_STRENGTH})), 0))) AS path_role,
    CASE WHEN linked THEN 10 ELSE 0 END AS link_confidence, CASE WHEN {_ANY(_LOWER("feature"), "low")} THEN 6 ELSE 0 END + CASE WHEN regexp_matches(lower(raw), '\bdocumentation\b') THEN 11 ELSE 0 END AS feature_relevance,
    0 AS canonicality, 4 AS coverage_diversity, CASE WHEN wants_table AND kind = 'doc.table_row' THEN 26 + least(36, 4 * told_hits) WHEN kind = 'doc.paragraph' AND (wants_paragraph OR {_EXACT_PATH}) THEN 14 + least(60, 6 * told_hits)
      WHEN wants_paragraph AND kind = 'doc.heading' THEN -8 ELSE 0 END AS kind_precision,
    least(24, floor(list_sum(list_transform(routes, lambda r, i: {_WEIGHT} * 100.0::DOUBLE / (60 + i))) + 0.5)) AS route_fusion, 5 AS freshness, 0 AS boundary_risk, CASE WHEN deprecated THEN -16 ELSE 0 END AS deprecation, CASE WHEN redacted THEN -4 ELSE 0 END AS redaction FROM points),
located AS (SELECT *, ({" + ".join(_PARTS)})::BIGINT AS score, len(list_filter(path_terms, lambda t: {_NAMED})) > 0 AS names_path,
    evidence = 0 AND NOT linked AS bare FROM scored),
firsts_of_paths AS (SELECT *, row_number() OVER (PARTITION BY item_id, path ORDER BY score DESC, kind_precision DESC, start_line, span_id) AS nth FROM located),
targets AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, kind_precision DESC, path, start_line, span_id) AS rank FROM firsts_of_paths WHERE nth = 1 OR names_path QUALIFY rank <= 20)"""


def _requests(spark, sf_dir):
    return requests.with_terms(tables.table(spark, sf_dir, "benchmark").select("item_id", "text")).drop("text")


def located(spark, sf_dir):
    """The candidates of each benchmark passage taken as a request, ranked."""
    every, asked = staged(corpus.placed_spans(spark, sf_dir)), staged(_requests(spark, sf_dir))
    return locate.ranked(locate.candidates(every, corpus.contains_edges(every), asked, "item_id"), "item_id")


@query(f"""WITH {LOCATED} SELECT item_id, rank::BIGINT AS rank, span_id, path, kind, score, array_to_string(routes, ',') AS routes, evidence::BIGINT AS evidence, CASE WHEN bare THEN 1 ELSE 0 END::BIGINT AS warnings,
  round(CASE WHEN score <= 0 THEN 0 ELSE score::DOUBLE / (score + 20) END, 6) AS confidence,
  CASE WHEN list_contains(routes, 'old_term_sweep') THEN CASE WHEN score >= 70 THEN 'must_edit' ELSE 'maybe_edit' END WHEN score >= 85 AND evidence >= 1 THEN 'must_edit' WHEN score >= 70 THEN 'maybe_edit' ELSE 'inspect_only' END AS decision FROM targets""")
def locate_batch(spark, sf_dir):
    """The twenty best targets of each request, by all routes over the spans of all documents and pages."""
    best = locate.targets(located(spark, sf_dir), "item_id")
    return best.select(
        "item_id", F.col("rank").cast("long").alias("rank"), "span_id", "path", "kind", "score", F.array_join("routes", ",").alias("routes"), F.col("evidence").cast("long").alias("evidence"),
        F.size("boundary.warnings").cast("long").alias("warnings"), "confidence", "decision")


@query(f"""WITH {LOCATED}, present AS (SELECT item_id, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles, list_sort(list(DISTINCT path)) AS docs FROM targets GROUP BY item_id),
swept AS (SELECT item_id, flatten([old, new, symbol, config]) AS every FROM requests)
SELECT item_id, array_to_string(list_filter(every, lambda w, i: list_position(every, w) = i), ',') AS sweeps, coalesce(roles, '') AS roles, coalesce(array_to_string(docs[1:50], ','), '') AS docs, coalesce(greatest(len(docs) - 50, 0), 0)::BIGINT AS docs_omitted FROM swept LEFT JOIN present USING (item_id)""")
def coverage_plan(spark, sf_dir):
    """What is to be looked at once more for each request: sweeps, roles, linked documents."""
    asked = _requests(spark, sf_dir)
    plan = locate.coverage_plan(locate.targets(located(spark, sf_dir), "item_id"), asked, "item_id")
    joined = [F.array_join(c, ",").alias(c) for c in ("sweeps", "roles", "docs")]
    return plan.select("item_id", *joined, F.col("docs_omitted").cast("long").alias("docs_omitted"))
