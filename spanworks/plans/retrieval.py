"""Queries that find, score and choose targets."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import requests, scoring
from ..operators import index, spans
from ..sources import tables
from ..sources.store import staged
from .registry import FILES, query

#: The request of the registered queries.
REQUEST = "change onesen to erblest across inenan eranenes"
TERMS = ["onesen", "erblest", "inenan", "eranenes"]
_LIST = ", ".join(f"'{t}'" for t in TERMS)
_SECRET = r"(?i)(api[_-]?key|token|secret|password)\s*[:=]"

_HITS = f"len(list_filter([{_LIST}], lambda t: contains(lower(text), t)))::INT"
_SCORED = f"""{FILES}, flags AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
hit AS (SELECT f.*, {_HITS} AS hits FROM files f), scored AS (
  SELECT h.path, h.source, h.lang, h.doc_id, h.hits, 'doc:' || sha1(h.path || h.text) AS span_id,
    (least(20, 5 * h.hits) + CASE WHEN coalesce(l.quality, 0) = 1 THEN 6 ELSE 0 END + 5 + 7 - CASE WHEN coalesce(l.toxic, 0) = 1 THEN 16 ELSE 0 END
      - CASE WHEN regexp_matches(h.text, '{_SECRET}') THEN 4 ELSE 0 END)::BIGINT AS score
  FROM hit h LEFT JOIN flags l USING (doc_id) WHERE h.hits > 0)"""
_CONFIDENCE = "round(CASE WHEN greatest(score, 0) = 0 THEN 0 ELSE greatest(score, 0)::DOUBLE / (greatest(score, 0) + 20) END, 6)"
_DECISION = "CASE WHEN score >= 85 THEN 'must_edit' WHEN score >= 70 THEN 'maybe_edit' ELSE 'inspect_only' END"


def scored(spark, sf_dir, terms: list[str] | None = None):
    """(path, source, lang, doc_id, hits, span_id, score) of the documents that contain a term."""
    docs = tables.files(spark, sf_dir)
    flags = tables.table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    found = docs.withColumn("hits", scoring.hits(terms or TERMS, F.col("text"))).where("hits > 0").join(flags, "doc_id", "left")
    flag = lambda c, n: F.when(c, n).otherwise(0)
    fusion = scoring.route_fusion(F.array(F.lit("fts_lexical")))
    score = (
        scoring.exact_term(F.col("hits")) + flag(F.col("quality") == 1, 6) + 5 + fusion
        - flag(F.col("toxic") == 1, 16) - flag(F.col("text").rlike(_SECRET), 4))
    return found.select("path", "source", "lang", "doc_id", "hits", F.concat(F.lit("doc:"), F.sha1(F.concat("path", "text"))).alias("span_id"), score.cast("long").alias("score"))


def locate(spark, sf_dir, request: str, limit: int = 20):
    """The best target of each source for a change request: path, span_id, score, confidence, decision."""
    best = spans.first_wins(scored(spark, sf_dir, requests.normalize(spark, request)["exact"]), ["source"], F.desc("score"), "path")
    shown = best.select("path", "span_id", "score", F.round(scoring.confidence(F.col("score")), 6).alias("confidence"), scoring.decision(F.col("score")).alias("decision"))
    return shown.orderBy(F.desc("score"), "path").limit(limit)


@query(f"""WITH {_SCORED}, best AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, path) AS n FROM scored)
SELECT path, span_id, score, {_CONFIDENCE} AS confidence, {_DECISION} AS decision FROM best WHERE n = 1 ORDER BY score DESC, path LIMIT 20""")
def locate_topk_decision(spark, sf_dir):
    return locate(spark, sf_dir, REQUEST)


@query(f"WITH {_SCORED} SELECT path, hits, score FROM scored")
def score_breakdown(spark, sf_dir):
    return scored(spark, sf_dir).select("path", "hits", "score")


@query(f"WITH {_SCORED}, best AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, path) AS n FROM scored) SELECT source, path, score FROM best WHERE n = 1")
def diversify_by_path(spark, sf_dir):
    return spans.first_wins(scored(spark, sf_dir), ["source"], F.desc("score"), "path").select("source", "path", "score")


@query(f"""WITH {_SCORED}, best AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, path) AS n FROM scored)
SELECT lang, string_agg(path, ',' ORDER BY n) FILTER (n <= 5) AS paths, greatest(count(*) - 5, 0)::BIGINT AS omitted FROM best GROUP BY lang""")
def coverage_plan_caps(spark, sf_dir):
    """Five targets of each language and how many more there are; ranks go no further than the fifth."""
    rows = scored(spark, sf_dir)
    best = rows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), "path"))).where("n <= 5")
    shown = best.groupBy("lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "path"))), lambda x: x["path"]), ",").alias("paths"))
    counts = rows.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("total"))
    return counts.join(shown, F.col("of").eqNullSafe(F.col("lang"))).select(F.col("of").alias("lang"), "paths", F.greatest(F.col("total") - 5, F.lit(0)).alias("omitted"))


def budgeted(rows, budget: int, *order):
    """The rows of (lang, cost) that a greedy budget in some order can keep: of each cost the first
    floor(budget / cost) + 1. Once a row of a cost does not fit, no later one of it does; the one more is for the first row,
    which is kept anyhow. Spark cuts such ranks before it shuffles, so no task sees a whole language."""
    nth = F.row_number().over(Window.partitionBy("lang", "cost").orderBy(*order))
    return rows.withColumn("_nth", nth).where(F.col("_nth") <= F.floor(F.lit(budget) / F.col("cost")) + 1).drop("_nth")


@query(f"""WITH RECURSIVE {_SCORED}, ranked AS (SELECT lang, path, (30 + 8 * hits)::BIGINT AS cost, row_number() OVER (PARTITION BY lang ORDER BY score DESC, path) AS n FROM scored),
walk AS (SELECT lang, path, n, cost AS used, true AS kept FROM ranked WHERE n = 1
  UNION ALL SELECT r.lang, r.path, r.n, CASE WHEN w.used + r.cost <= 120 THEN w.used + r.cost ELSE w.used END, w.used + r.cost <= 120 FROM walk w JOIN ranked r ON r.lang = w.lang AND r.n = w.n + 1)
SELECT lang, path, n::BIGINT AS n FROM walk WHERE kept""")
def token_budget_greedy(spark, sf_dir):
    """A budget for each language, and the rank of what it keeps among all targets of the language; the fold is over the first
    targets of each cost of one language. Few are kept, so a rank is one more than the targets counted before it: no task
    sorts a whole language."""
    rows = staged(scored(spark, sf_dir).select("lang", "path", "score", (30 + 8 * F.col("hits")).cast("long").alias("cost")))
    each = budgeted(rows, 120, F.desc("score"), "path").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "path", "cost"))).alias("targets"))
    kept = each.select("lang", F.inline(spans.greedy_budget(F.col("targets"), F.lit(120)))).select("lang", "path", "order")
    kept = staged(kept.withColumn("_same", F.row_number().over(Window.partitionBy("lang", "order", "path").orderBy("path"))))
    other = rows.select(F.col("lang").alias("_lang"), F.col("path").alias("_path"), (-F.col("score")).alias("_order"))
    before = (F.col("_order") < F.col("order")) | ((F.col("_order") == F.col("order")) & (F.col("_path") < F.col("path")))
    counted = other.join(F.broadcast(kept), F.col("_lang").eqNullSafe(F.col("lang"))).groupBy("lang", "path", "order", "_same")
    return counted.agg(F.count_if(before).alias("_before")).select("lang", "path", (F.col("_before") + F.col("_same")).alias("n"))


@query("SELECT page_id, url, CASE WHEN ends_with(url, '/en/') THEN 0 WHEN contains(url, '/en/1') THEN 1 ELSE 2 END AS match_rank FROM pages WHERE contains(url, '/en/') ORDER BY match_rank, length(url), url, page_id LIMIT 100")
def path_route(spark, sf_dir):
    rank = F.when(F.col("url").endswith("/en/"), 0).when(F.col("url").contains("/en/1"), 1).otherwise(2)
    found = tables.table(spark, sf_dir, "pages").where(F.col("url").contains("/en/")).select("page_id", "url", rank.alias("match_rank"))
    return found.orderBy("match_rank", F.char_length("url"), "url", "page_id").limit(100)


@query(f"WITH t AS (SELECT unnest([{_LIST}]) AS term) SELECT term, doc_id FROM documents JOIN t ON contains(lower(text), term)")
def lexical_like_route(spark, sf_dir):
    terms = F.array(*[F.lit(t) for t in TERMS])
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("low"))
    return docs.select("doc_id", F.explode(F.filter(terms, lambda t: F.col("low").contains(t))).alias("term")).select("term", "doc_id")


@query(r"SELECT item_id, doc_id FROM benchmark b JOIN documents d ON regexp_matches(b.text, '\S') AND contains(d.text, b.text)")
def fts_phrase_route(spark, sf_dir):
    """Documents that contain a passage, by a positional index of their words."""
    docs, items = tables.table(spark, sf_dir, "documents").select("doc_id", "text"), tables.table(spark, sf_dir, "benchmark")
    return index.passages(docs, "doc_id", "text", items, "item_id", "text").select("item_id", "doc_id")


_ROUTES = f"""routes AS (SELECT doc_id, 1 AS step, 'fts_lexical' AS route FROM documents WHERE len(list_filter([{_LIST}], lambda t: contains(lower(text), t))) > 0
  UNION ALL SELECT doc_id, 2, 'path_role_expansion' FROM documents WHERE source = 'src3' UNION ALL SELECT doc_id, 3, 'old_term_sweep' FROM documents WHERE contains(text, 'onesen'))"""


def _routes(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents")
    step = lambda rows, n, name: rows.select("doc_id", F.lit(n).alias("step"), F.lit(name).alias("route"))
    return (
        step(docs.where(scoring.hits(TERMS, F.col("text")) > 0), 1, "fts_lexical")
        .union(step(docs.where("source = 'src3'"), 2, "path_role_expansion"))
        .union(step(docs.where(F.col("text").contains("onesen")), 3, "old_term_sweep")))


@query(f"WITH {_ROUTES} SELECT doc_id, min(step) AS step FROM routes GROUP BY doc_id ORDER BY step, doc_id LIMIT 800")
def route_union_capped(spark, sf_dir):
    return _routes(spark, sf_dir).groupBy("doc_id").agg(F.min("step").alias("step")).orderBy("step", "doc_id").limit(800)


@query(f"""WITH {_ROUTES}, o AS (SELECT doc_id, route, row_number() OVER (PARTITION BY doc_id ORDER BY step) AS rank, CASE route WHEN 'fts_lexical' THEN 4 WHEN 'old_term_sweep' THEN 3 ELSE 2 END AS weight FROM routes)
SELECT doc_id, string_agg(route, ',' ORDER BY rank) AS routes, least(24, floor(sum(weight * 100.0::DOUBLE / (60 + rank)) + 0.5))::INT AS fusion FROM o GROUP BY doc_id""")
def weighted_rrf(spark, sf_dir):
    each = _routes(spark, sf_dir).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "route"))), lambda x: x["route"]).alias("names"))
    return each.select("doc_id", F.array_join("names", ",").alias("routes"), scoring.route_fusion(F.col("names")).alias("fusion"))


@query("""SELECT count(*)::BIGINT AS exact, CASE WHEN count(*) = 1 THEN 'exact_path' WHEN count(*) > 1 THEN 'exact_multisurface' ELSE 'ranked' END AS route,
  CASE WHEN count(*) = 1 THEN 0.94 WHEN count(*) > 1 THEN 0.90 ELSE 0.0 END::DOUBLE AS confidence FROM pages WHERE contains(url, 'ththre.example.com')""")
def exact_route_plan(spark, sf_dir):
    n = F.count("*")
    return tables.table(spark, sf_dir, "pages").where(F.col("url").contains("ththre.example.com")).agg(
        n.alias("exact"), F.when(n == 1, "exact_path").when(n > 1, "exact_multisurface").otherwise("ranked").alias("route"),
        F.when(n == 1, 0.94).when(n > 1, 0.90).otherwise(0.0).alias("confidence"))


@query(f"""WITH {_SCORED}, p AS (SELECT *, row_number() OVER (ORDER BY score DESC, path) AS n FROM scored)
SELECT string_agg(path, ',' ORDER BY n) FILTER (n <= 8) AS shown, greatest(count(*) - 8, 0)::BIGINT AS omitted FROM p""")
def profile_shaping(spark, sf_dir):
    """A short profile: the eight best, and how many more there are."""
    rows = scored(spark, sf_dir)
    best = rows.orderBy(F.desc("score"), "path").limit(8).select(F.struct((-F.col("score")).alias("o"), "path").alias("top"), F.lit(0).cast("long").alias("n"))
    total = rows.agg(F.count("*").alias("n")).select(F.lit(None).cast(best.schema["top"].dataType).alias("top"), "n")
    both = best.union(total).agg(F.array_sort(F.collect_list("top")).alias("top"), F.sum("n").alias("n"))
    return both.select(F.array_join(F.transform("top", lambda x: x["path"]), ",").alias("shown"), F.greatest(F.col("n") - 8, F.lit(0)).alias("omitted"))


@query("SELECT coalesce(decision, 'none') AS decision, n FROM (SELECT CASE WHEN s >= 85 THEN 'must_edit' WHEN s >= 70 THEN 'maybe_edit' ELSE 'inspect_only' END AS decision, count(*)::BIGINT AS n FROM (SELECT o_totalprice / 4000 AS s FROM orders) GROUP BY 1)")
def decision_histogram(spark, sf_dir):
    orders = tables.table(spark, sf_dir, "orders").select((F.col("o_totalprice") / 4000).alias("s"))
    return orders.groupBy(scoring.decision(F.col("s")).alias("decision")).agg(F.count("*").alias("n"))


@query(f"WITH {requests.terms_sql('benchmark', 'item_id')} SELECT item_id, {', '.join(f"array_to_string({f}, ',') AS {f}" for f in requests.FIELDS)} FROM requests")
def normalized_requests(spark, sf_dir):
    """The terms of each benchmark passage taken as a request."""
    found = requests.with_terms(tables.table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("item_id", *[F.array_join(f, ",").alias(f) for f in requests.FIELDS])


@query("""WITH f AS (SELECT text, min(doc_id) AS found_at, count(*) AS n FROM documents GROUP BY text)
SELECT d.doc_id, f.found_at, f.n > 2 AS ambiguous FROM documents d JOIN f ON d.text = f.text WHERE d.doc_id <> f.found_at""")
def exact_text_relocation(spark, sf_dir):
    """Where the exact text of a document is found: at the first document that has it; ambiguous if there are more."""
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    first = docs.where("hash is not null").groupBy("hash").agg(F.min("doc_id").alias("found_at"), (F.count("*") > 2).alias("ambiguous"))
    return docs.join(first, "hash").where("doc_id <> found_at").select("doc_id", "found_at", "ambiguous")
