"""Queries over what files hold and what a refresh reads, and the answers of the tools for a batch of requests."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import dispatch, index, locate, scope, spans

from ..sources import corpus, tables
from ..sources.store import staged
from .locate import LOCATED, _requests
from .registry import query

_FILES = corpus.SPANS_SQL.split("corpus_cut AS")[0].rstrip().rstrip(",")
_HEADING = r"'^#{1,6}\s'"
_BLOCKS = rf"""{_FILES}, l AS (SELECT path, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS line, unnest(range(1, len(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) + 1))::BIGINT AS n FROM corpus WHERE octet_length(encode(text)) <= {dispatch.MOST_BYTES}),
f AS (SELECT *, regexp_matches(line, '^\s*(```|~~~)') AS fence, sum(regexp_matches(line, '^\s*(```|~~~)')::INT) OVER (PARTITION BY path ORDER BY n ROWS UNBOUNDED PRECEDING) AS opened FROM l),
k AS (SELECT *, CASE WHEN fence OR opened % 2 = 1 THEN 'doc.code_fence' WHEN regexp_matches(line, '^\s*$') THEN NULL WHEN regexp_matches(line, {_HEADING}) THEN 'doc.heading' WHEN regexp_matches(line, '^\s*>') THEN 'doc.quote'
  WHEN regexp_matches(line, '^\s*\|.*\|\s*$') THEN 'doc.table' WHEN regexp_matches(line, '^\s*(?:[-*+]|\d+[.)])\s') THEN 'doc.list' ELSE 'doc.paragraph' END AS kind FROM f),
s AS (SELECT *, CASE WHEN kind IS NOT NULL AND (kind = 'doc.heading' OR fence AND opened % 2 = 1 OR lag(kind) OVER w IS NULL OR lag(kind) OVER w <> kind) THEN 1 ELSE 0 END AS starts FROM k WINDOW w AS (PARTITION BY path ORDER BY n)),
r AS (SELECT *, sum(starts) OVER (PARTITION BY path ORDER BY n ROWS UNBOUNDED PRECEDING) AS run FROM s),
blocks AS (SELECT path, kind, regexp_replace(trim(arg_min(line, n)), '^#{{1,6}}\s+', '') AS label, min(n) AS start_line, max(n) AS end_line FROM r WHERE kind IS NOT NULL GROUP BY path, run, kind),
h AS (SELECT path, n, length(regexp_extract(line, '^(#{{1,6}})', 1)) AS depth, trim(regexp_replace(line, '^#{{1,6}}\s+|\s+#+\s*$', '', 'g')) AS label FROM k WHERE opened % 2 = 0 AND regexp_matches(line, {_HEADING})),
last AS (SELECT path, max(n) FILTER (trim(line) <> '') AS last FROM k GROUP BY path),
sections AS (SELECT h.path, h.label, h.n AS start_line, coalesce((SELECT min(b.n) - 1 FROM h b WHERE b.path = h.path AND b.n > h.n AND b.depth <= h.depth), last) AS end_line,
  (SELECT string_agg(a.label, '/' ORDER BY a.n) FROM h a WHERE a.path = h.path AND (a.n = h.n OR a.n < h.n AND a.depth < h.depth AND NOT EXISTS (SELECT 1 FROM h b WHERE b.path = h.path AND b.n > a.n AND b.n < h.n AND b.depth <= a.depth))) AS detail FROM h JOIN last USING (path))"""


@query(rf"""WITH {_BLOCKS} SELECT path, 'file' AS kind, regexp_extract(path, '[^/]*$') AS label, 1::BIGINT AS start_line, greatest(len(string_split(regexp_replace(text, '\r?\n$', ''), chr(10))), 1)::BIGINT AS end_line, NULL::VARCHAR AS detail, CASE WHEN octet_length(encode(text)) > {dispatch.MOST_BYTES} THEN 'oversized' END AS error FROM corpus
UNION ALL SELECT path, kind, label, start_line, end_line, NULL, NULL FROM blocks UNION ALL SELECT path, 'doc.section', label, start_line, end_line, detail, NULL FROM sections
UNION ALL SELECT 'events/' || event_id || '.json', unnest(['file', 'config.file', 'config.entry']), unnest([event_id || '.json', event_id || '.json', 'k']), 1, 1, unnest([NULL, '', '/k']), NULL FROM events WHERE json_valid(props)
UNION ALL SELECT 'events/' || event_id || '.json', 'file', event_id || '.json', 1, 1, NULL, NULL FROM events WHERE NOT json_valid(props)""")
def dispatched_spans(spark, sf_dir):
    """The spans of all documents and pages as Markdown, and of all events' properties as JSON files, by one dispatcher."""
    events = tables.table(spark, sf_dir, "events").select(F.concat(F.lit("events/"), F.col("event_id").cast("string"), F.lit(".json")).alias("path"), F.col("props").alias("text"))
    found = dispatch.dispatched(corpus.files(spark, sf_dir).union(events))
    return found.where("kind <> 'parse.error'").select("path", "kind", "label", "start_line", "end_line", "detail", "error")


_OVERSIZED = 5000
_SCOPE = f"""{_FILES}, i AS (SELECT path, octet_length(encode(text)) > {_OVERSIZED} AS oversized FROM corpus), hot AS (SELECT concat_ws('/', d.source, d.lang, d.doc_id::VARCHAR) || '.md' AS path, max(toxic = 1) AS pinned FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1 GROUP BY 1)"""


def _scope(spark, sf_dir):
    """Documents and pages as an inventory; those labelled good are hot."""
    inventory = corpus.files(spark, sf_dir).select("path", (F.octet_length("text") > _OVERSIZED).alias("oversized"))
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")), F.lit(".md")).alias("path"))
    hot = tables.table(spark, sf_dir, "labels").where("quality = 1").join(docs, "doc_id").groupBy("path").agg(F.max(F.col("toxic") == 1).alias("pinned"))
    wanted = spark.createDataFrame([("web",), ("no/such/path",)], "path string")
    return scope.deep_files(inventory, "paths", wanted, hot)


@query(f"""WITH {_SCOPE}, j AS (SELECT i.*, hot.path IS NOT NULL OR starts_with(i.path, 'web/') AS inside FROM i LEFT JOIN hot USING (path))
SELECT path, inside AND NOT oversized AS deep, CASE WHEN inside AND oversized THEN 'oversized hotset file kept as a file only' END AS warning FROM j UNION ALL SELECT 'no/such/path', false, 'wanted path is not in the inventory'""")
def scoped_refresh(spark, sf_dir):
    """Which files a refresh of one folder reads into spans beside the hot ones, and what it warns of."""
    return _scope(spark, sf_dir)


@query(f"""WITH {_SCOPE}, j AS (SELECT i.*, hot.path IS NOT NULL OR starts_with(i.path, 'web/') AS inside FROM i LEFT JOIN hot USING (path)), c AS (SELECT count(*)::BIGINT AS files, count(*) FILTER (inside AND NOT oversized)::BIGINT AS hot FROM j)
SELECT files, hot, files - hot AS cold, CASE WHEN hot = 0 THEN 'none' WHEN hot < files THEN 'scoped' ELSE 'full' END AS deep FROM c""")
def refresh_coverage(spark, sf_dir):
    return scope.coverage(_scope(spark, sf_dir))


BUDGET = 400


@query(f"""WITH RECURSIVE {LOCATED}, costs AS (SELECT item_id, rank, span_id, path, start_line, ceil(length(text) / 4.0)::BIGINT AS cost FROM targets),
walk AS (SELECT item_id, rank, cost AS used, true AS kept FROM costs WHERE rank = 1
  UNION ALL SELECT w.item_id, c.rank, CASE WHEN w.used + c.cost <= {BUDGET} THEN w.used + c.cost ELSE w.used END, w.used + c.cost <= {BUDGET} FROM walk w JOIN costs c ON c.item_id = w.item_id AND c.rank = w.rank + 1)
SELECT c.item_id, c.rank::BIGINT AS rank, c.span_id, c.cost, w.used::BIGINT AS used FROM walk w JOIN costs c USING (item_id, rank) WHERE kept""")
def context_batch(spark, sf_dir):
    """The context for each request: its targets in order, as far as a budget of tokens goes, going on after one that does not
    fit. A request has twenty targets at most, so the fold is over a short array."""
    every, asked = staged(corpus.placed_spans(spark, sf_dir)), staged(_requests(spark, sf_dir))
    rows = locate.ranked(locate.candidates(every, corpus.contains_edges(every), asked, "item_id"), "item_id")
    best = locate.targets(rows, "item_id").select("item_id", F.col("rank").cast("long").alias("rank"), "span_id", F.ceil(F.char_length("text") / 4).cast("long").alias("cost"))
    folded = best.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", "span_id", "cost"))).alias("targets"))
    kept = folded.select("item_id", F.inline(spans.greedy_budget(F.col("targets"), F.lit(BUDGET))))
    return kept.withColumn("used", F.sum("cost").over(Window.partitionBy("item_id").orderBy("rank")))


_PHRASE = lambda c: rf"' ' || array_to_string(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+'), ' ') || ' '"


@query(f"""WITH {LOCATED}, heads AS (SELECT span_id, path, label, {_PHRASE("label")} AS phrase FROM spans WHERE kind = 'doc.heading'), words AS MATERIALIZED (SELECT span_id, path, {_PHRASE("text")} AS words FROM spans WHERE kind <> 'doc.heading'),
mentions AS (SELECT DISTINCT w.path AS source, h.path AS target FROM heads h JOIN words w ON contains(w.words, h.phrase) WHERE trim(h.phrase) <> '' AND w.path <> h.path),
chosen_paths AS (SELECT DISTINCT item_id, path FROM targets WHERE rank <= 5), around AS (SELECT item_id, path, 0 AS hops FROM chosen_paths UNION ALL SELECT item_id, source, 1 FROM chosen_paths JOIN mentions ON target = path UNION ALL SELECT item_id, target, 1 FROM chosen_paths JOIN mentions ON source = path),
nearest AS (SELECT item_id, path, min(hops) AS hops FROM around GROUP BY item_id, path)
SELECT item_id, count(*)::BIGINT AS files, count(*) FILTER (hops = 0)::BIGINT AS seeds, CASE WHEN count(*) >= 20 THEN 'high' WHEN count(*) >= 6 THEN 'medium' ELSE 'low' END AS risk, array_to_string(list(path ORDER BY hops, path)[1:10], ',') AS verify FROM nearest GROUP BY item_id""")
def change_plan(spark, sf_dir):
    """What a change for each request touches: its five best targets, the files that mention their headings or that they mention, the
    risk, and the first ten files to verify."""
    every, asked = staged(corpus.placed_spans(spark, sf_dir)), staged(_requests(spark, sf_dir))
    rows = locate.ranked(locate.candidates(every, corpus.contains_edges(every), asked, "item_id"), "item_id")
    seeds = staged(locate.targets(rows, "item_id").where("rank <= 5").select("item_id", "path").distinct())
    # Only what touches a seed is asked for: who mentions its headings, and which headings its own spans mention.
    heads = every.where("kind = 'doc.heading'").select(F.col("span_id").alias("head"), F.col("path").alias("target"), index.tokens(F.col("label")).alias("words"))
    texts, chosen = every.where("kind <> 'doc.heading'").select("span_id", F.col("path").alias("source"), "text"), seeds.select("path").distinct()

    def links(heads, texts):
        held = index.phrase_rows(texts, ["source"], index.tokens(F.col("text")), heads, ["target"], F.col("words"))
        return staged(held.where("source <> target").distinct())

    near = seeds.select("item_id", "path", F.lit(0).alias("hops"))
    of_seeds = lambda rows, c: rows.join(chosen, F.col(c) == F.col("path"), "left_semi")
    for a, b, found in (("target", "source", links(of_seeds(heads, "target"), texts)), ("source", "target", links(heads, staged(of_seeds(texts, "source"))))):
        near = near.union(seeds.join(found, F.col("path") == F.col(a)).select("item_id", F.col(b), F.lit(1)))
    files = near.groupBy("item_id", "path").agg(F.min("hops").alias("hops"))
    first = F.row_number().over(Window.partitionBy("item_id").orderBy("hops", "path"))
    shown = files.withColumn("n", first).where("n <= 10").groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "path"))), lambda x: x["path"]), ",").alias("verify"))
    n = F.count("*")
    counts = files.groupBy(F.col("item_id").alias("of")).agg(n.alias("files"), F.count_if(F.col("hops") == 0).alias("seeds"), F.when(n >= 20, "high").when(n >= 6, "medium").otherwise("low").alias("risk"))
    return counts.join(shown, F.col("of") == F.col("item_id")).select("item_id", "files", "seeds", "risk", "verify")
