"""Queries that verify changes and keep state."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import classify
from ..operators import links, relocate, state, verify
from ..sources import tables
from ..streaming import lifecycle
from .registry import FILES, LINES, query

_TERMS = ["idiot", "password", "License", "| "]
_TERM_LIST = ", ".join(f"'{t}'" for t in _TERMS)


@query(f"WITH {FILES}, {LINES}, t AS (SELECT unnest([{_TERM_LIST}]) AS term) SELECT path, line_no, term FROM lines JOIN t ON contains(line, term)")
def old_term_sweep(spark, sf_dir):
    rows = tables.lines(tables.files(spark, sf_dir).select("path", "text"))
    return verify.old_term_sweep(rows, _TERMS).select("path", "line_no", "term")


@query(f"WITH {FILES} SELECT path, CASE WHEN source = 'src0' THEN 'fail' ELSE 'needs_attention' END AS severity FROM files WHERE contains(text, 'License')")
def unsynced_docs_policy(spark, sf_dir):
    docs = tables.files(spark, sf_dir).where(F.col("text").contains("License"))
    return docs.select("path", verify.doc_severity(F.col("source") == "src0", "changed_paths_plus_advisory_docs").alias("severity"))


@query("""WITH l AS (SELECT page_id, unnest(range(1, len(h) + 1))::BIGINT AS ordinal, unnest(h) AS href FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages)),
p AS (SELECT DISTINCT regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages) SELECT page_id, ordinal, href FROM l WHERE href NOT IN (SELECT path FROM p)""")
def broken_links(spark, sf_dir):
    paths = tables.table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1).alias("path"))
    return verify.missing_targets(tables.page_links(spark, sf_dir), "href", paths, "path").select("page_id", "ordinal", "href")


@query("SELECT page_id, array_to_string(list_filter(string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '' AND s <> '.'), '/') AS resolved FROM pages")
def resolved_links(spark, sf_dir):
    pages = tables.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1).alias("path"))
    return pages.select("page_id", links.resolved(F.col("path"), F.col("path")).alias("resolved"))


@query(f"WITH {FILES} SELECT path FROM files WHERE source = 'src1' AND NOT contains(text, 'erblest') AND NOT contains(text, 'inenan')")
def code_doc_mismatch(spark, sf_dir):
    has = F.col("text").contains("erblest") | F.col("text").contains("inenan")
    return tables.files(spark, sf_dir).where((F.col("source") == "src1") & ~has).select("path")


@query(f"WITH {FILES} SELECT path FROM files WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def unindexed_files(spark, sf_dir):
    return tables.files(spark, sf_dir).join(tables.table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("path")


@query(f"WITH {FILES} SELECT path, (doc_id IN (SELECT doc_id FROM labels)) AS indexed FROM files")
def doc_indexed_flag(spark, sf_dir):
    known = tables.table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("_known")).distinct()
    return tables.files(spark, sf_dir).join(known, "doc_id", "left").select("path", F.coalesce("_known", F.lit(False)).alias("indexed"))


@query("""WITH c AS (SELECT count(*)::BIGINT AS files, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels))::BIGINT AS indexed FROM documents)
SELECT files, indexed, files - indexed AS cold, CASE WHEN indexed = 0 THEN 'none' WHEN indexed < files THEN 'scoped' ELSE 'full' END AS state FROM c""")
def coverage_state(spark, sf_dir):
    flagged = doc_indexed_flag(spark, sf_dir).agg(F.count("*").alias("files"), F.count_if("indexed").alias("indexed"))
    kind = F.when(F.col("indexed") == 0, "none").when(F.col("indexed") < F.col("files"), "scoped").otherwise("full")
    return flagged.select("files", "indexed", (F.col("files") - F.col("indexed")).alias("cold"), kind.alias("state"))


@query(f"""WITH {FILES}, s AS (SELECT path, 'sweep' AS source, 'fail' AS severity FROM files WHERE contains(text, 'idiot')
  UNION ALL SELECT path, 'docs', CASE WHEN source = 'src0' THEN 'fail' ELSE 'needs_attention' END FROM files WHERE contains(text, 'License') UNION ALL SELECT path, 'docs', 'info' FROM files WHERE source = 'src2')
SELECT path, source, CASE min(CASE severity WHEN 'fail' THEN 0 WHEN 'needs_attention' THEN 1 ELSE 2 END) WHEN 0 THEN 'fail' WHEN 1 THEN 'needs_attention' ELSE 'info' END AS severity FROM s GROUP BY path, source""")
def required_verification_merge(spark, sf_dir):
    files = tables.files(spark, sf_dir)
    of = lambda rows, source, severity: rows.select("path", F.lit(source).alias("source"), severity.alias("severity"))
    swept = of(files.where(F.col("text").contains("idiot")), "sweep", F.lit("fail"))
    docs = unsynced_docs_policy(spark, sf_dir).select("path", F.lit("docs").alias("source"), "severity")
    return verify.required_verification(swept, docs, of(files.where("source = 'src2'"), "docs", F.lit("info")))


@query(f"""WITH {FILES} SELECT source, count(*) FILTER (contains(text, 'idiot'))::BIGINT AS hard, count(*) FILTER (contains(text, 'License'))::BIGINT AS soft,
  CASE WHEN count(*) FILTER (contains(text, 'idiot')) > 0 THEN 'fail' WHEN count(*) FILTER (contains(text, 'License')) > 0 THEN 'needs_attention' ELSE 'pass' END AS status FROM files GROUP BY source""")
def verify_status(spark, sf_dir):
    hard, soft = F.count_if(F.col("text").contains("idiot")), F.count_if(F.col("text").contains("License"))
    return tables.files(spark, sf_dir).groupBy("source").agg(hard.alias("hard"), soft.alias("soft"), verify.status(hard, soft).alias("status"))


_DELTA = """b AS (SELECT doc_id, concat_ws('/', source, lang, doc_id::VARCHAR) AS path, sha1(text) AS hash FROM documents), before AS (SELECT path, hash FROM b WHERE doc_id % 11 <> 0),
after AS (SELECT path, CASE WHEN doc_id % 7 = 0 THEN sha1(hash) ELSE hash END AS hash FROM b WHERE doc_id % 13 <> 0)"""


def _snapshots(spark, sf_dir):
    """Two snapshots of all files, of which some were added, deleted and changed: rows differ, none is left out to save work."""
    files = tables.files(spark, sf_dir).select("doc_id", "path", "hash")
    after = files.where("doc_id % 13 <> 0").withColumn("hash", F.when(F.col("doc_id") % 7 == 0, F.sha1("hash")).otherwise(F.col("hash")))
    return files.where("doc_id % 11 <> 0").select("path", "hash"), after.select("path", "hash")


@query(f"WITH {_DELTA} SELECT * FROM (SELECT coalesce(x.path, y.path) AS path, CASE WHEN x.path IS NULL THEN 'added' WHEN y.path IS NULL THEN 'deleted' WHEN x.hash <> y.hash THEN 'modified' END AS change FROM before x FULL JOIN after y ON x.path = y.path) WHERE change IS NOT NULL")
def changed_files_diff(spark, sf_dir):
    return state.changed_files(*_snapshots(spark, sf_dir))


@query(f"WITH {_DELTA} SELECT path, hash FROM after")
def delta_merge(spark, sf_dir):
    before, after = _snapshots(spark, sf_dir)
    change = state.changed_files(before, after)
    fresh = after.join(change.where("change <> 'deleted'"), "path", "left_semi")
    return state.merged(before, fresh, change.where("change = 'deleted'"), "path")


@query(f"WITH {_DELTA}, u AS (SELECT *, 0 AS o FROM after UNION ALL SELECT *, 1 FROM before) SELECT path, min_by(hash, o) AS hash FROM u GROUP BY path")
def snapshot_precedence(spark, sf_dir):
    before, after = _snapshots(spark, sf_dir)
    both = after.withColumn("o", F.lit(0)).union(before.withColumn("o", F.lit(1)))
    return state.precedence(both, "path", [F.col("o")]).select("path", "hash")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*)::BIGINT AS n, max(event_id) AS last FROM events GROUP BY 1 ORDER BY day DESC LIMIT 50")
def revision_log_retention(spark, sf_dir):
    days = tables.table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
    return state.retained(days, 50, F.desc("day"))


@query("SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*)::BIGINT AS accesses, bool_or(event_type = 'purchase') AS pinned FROM events GROUP BY user_id")
def hotset_upsert(spark, sf_dir):
    return state.hotset(tables.table(spark, sf_dir, "events"), "user_id")


_FOLDED = """e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts IS NULL, ts, event_id) AS rn FROM events),
g AS (SELECT user_id, count(*)::BIGINT AS seen, count(*) FILTER (event_type = 'click')::BIGINT AS useful, count(*) FILTER (event_type = 'error') AS errors, bool_or(event_type = 'purchase') AS pinned,
  max(rn) FILTER (event_type = 'click') AS u, max(rn) FILTER (event_type = 'error') AS i, max(rn) FILTER (event_type IN ('signup', 'purchase')) AS a FROM e GROUP BY user_id),
folded AS (SELECT user_id, CASE WHEN useful = 0 AND errors >= 2 AND (a IS NULL OR i > a) THEN 'dormant' ELSE 'active' END AS state, pinned, useful,
  CASE WHEN useful = 0 THEN errors ELSE (SELECT count(*) FROM e WHERE e.user_id IS NOT DISTINCT FROM g.user_id AND event_type = 'error' AND rn > u) END::BIGINT AS ignored, seen FROM g)"""


@query(f"WITH {_FOLDED} SELECT * FROM folded")
def anchor_lifecycle_fold(spark, sf_dir):
    return state.anchor_lifecycle(tables.table(spark, sf_dir, "events"))


@query(f"""WITH {_FOLDED}, l AS (SELECT user_id, max(event_id) AS last FROM events GROUP BY user_id)
SELECT f.*, (1000 + CASE WHEN pinned THEN 500 ELSE 0 END + useful + 10 * useful - 5 * ignored + last / 1000.0::DOUBLE)::DOUBLE AS rank_score FROM folded f JOIN l USING (user_id) WHERE state = 'active' ORDER BY rank_score DESC, user_id LIMIT 64""")
def anchor_rank_caps(spark, sf_dir):
    """The 64 active anchors of the highest rank: what was useful is their score, their newest event when they were seen."""
    last = tables.table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("last"))
    anchors = state.anchor_rank(anchor_lifecycle_fold(spark, sf_dir).join(last, "user_id"), F.col("useful"), F.col("last")).drop("last")
    return anchors.withColumn("rank_score", F.col("rank_score").cast("double")).where("state = 'active'").orderBy(F.desc("rank_score"), "user_id").limit(64)


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def telemetry_windows(spark, sf_dir):
    return lifecycle.windowed_counts(tables.table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS "end", count(*)::BIGINT AS n FROM s GROUP BY user_id, g""")
def telemetry_sessions(spark, sf_dir):
    return lifecycle.sessions(tables.table(spark, sf_dir, "events"))


@query("""WITH w AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda x: x <> '')) AS s FROM benchmark)
SELECT a.item_id AS left_id, b.item_id AS right_id, round(2.0 * len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s)), 6)::DOUBLE AS dice FROM w a JOIN w b ON b.item_id = a.item_id + 1""")
def dice_similarity_pairs(spark, sf_dir):
    """Each passage beside the next."""
    items = tables.table(spark, sf_dir, "benchmark")
    other = items.select((F.col("item_id") - 1).alias("left_id"), F.col("item_id").alias("right_id"), F.col("text").alias("other"))
    both = items.join(other, items.item_id == other.left_id)
    return both.select("left_id", "right_id", F.round(classify.dice(F.col("text"), F.col("other")), 6).alias("dice"))


@query(f"""WITH {FILES}, {LINES}, l AS (SELECT doc_id, line_no, sha1(rtrim(line, ' ')) AS h FROM lines), f AS (SELECT h, min(doc_id) AS first_doc, count(*)::BIGINT AS n FROM l GROUP BY h)
SELECT doc_id, line_no, first_doc FROM l JOIN f USING (h) WHERE n > 1 AND doc_id <> first_doc""")
def line_fingerprint_match(spark, sf_dir):
    """Lines beside the first document that has the same."""
    rows = tables.lines(tables.files(spark, sf_dir).select("doc_id", "text")).select("doc_id", "line_no", F.sha1(F.rtrim("line")).alias("h"))
    first = rows.groupBy("h").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).where("n > 1")
    return rows.join(first, "h").where("doc_id <> first_doc").select("doc_id", "line_no", "first_doc")


@query("""WITH t AS (SELECT conv_id, turn, (conv_id + turn) % 6 AS r, role, coalesce(text, '') AS text FROM conversations WHERE turn IS NOT NULL),
both_ AS (SELECT *, conv_id || ':' || turn AS id, string_split_regex(lower(text), '[^a-z0-9_]+') AS w0, CASE r WHEN 0 THEN text WHEN 4 THEN left(text, (length(text) * 3) // 5) ELSE text || ' edited' END AS text1 FROM t),
old AS (SELECT conv_id AS path, id, role AS kind, turn // 4 AS heading, turn AS ordinal, turn AS anchor, sha1(text) AS h, list_distinct(list_filter(w0, lambda x: x <> '')) AS w FROM both_),
new AS (SELECT conv_id AS path, id, role AS kind, CASE WHEN r = 4 THEN -1 ELSE turn // 4 END AS heading, turn // 4 AS nearby, CASE WHEN r >= 3 THEN turn + 100 ELSE turn END AS ordinal,
  CASE WHEN r <= 1 THEN turn END AS anchor, sha1(text1) AS h, list_distinct(list_filter(string_split_regex(lower(text1), '[^a-z0-9_]+'), lambda x: x <> '')) AS w FROM both_ WHERE r < 5),
p AS (SELECT o.id, n.id AS found, o.h = n.h AS s1, coalesce(o.anchor = n.anchor AND o.kind = n.kind, false) AS s2, o.heading = n.heading AND o.ordinal = n.ordinal AND o.kind = n.kind AS s3,
  o.heading = n.heading AND o.kind = n.kind AS same, o.heading = n.nearby AND o.kind = n.kind AS near_, coalesce(2.0::DOUBLE * len(list_intersect(o.w, n.w)) / nullif(len(o.w) + len(n.w), 0), 0) AS dice FROM old o JOIN new n USING (path)),
b AS (SELECT *, max(CASE WHEN near_ AND dice >= 0.5 THEN dice END) OVER (PARTITION BY id) AS top FROM p),
f AS (SELECT id, unnest([{'k': 1, 'hit': s1}, {'k': 2, 'hit': s2}, {'k': 3, 'hit': s3}, {'k': 4, 'hit': same AND dice >= 0.72}, {'k': 5, 'hit': near_ AND coalesce(dice = top, false)}]) AS x, found FROM b),
c AS (SELECT id, x.k AS k, count(*) AS n, min(found) AS found FROM f WHERE x.hit GROUP BY ALL), g AS (SELECT id, arg_min({'k': k, 'n': n, 'found': found}, k) AS y FROM c GROUP BY id)
SELECT o.id AS span_id, ['text_hash', 'anchor_kind', 'heading_block_kind', 'heading_fuzzy_text', 'nearest_heading_similarity'][y.k] AS step,
  CASE WHEN y IS NULL THEN 'not_found' WHEN y.n = 1 THEN 'relocated' ELSE 'ambiguous' END AS outcome, CASE WHEN y.n = 1 THEN y.found END AS found_id FROM old o LEFT JOIN g ON g.id = o.id""")
def relocate_cascade(spark, sf_dir):
    """Turns as spans of their conversation, and where each is found in a later snapshot: by (conv_id + turn) % 6 a turn stays,
    is edited, loses its anchor too, its place, its heading, or goes."""
    turns = tables.table(spark, sf_dir, "conversations").where("turn is not null").withColumn("text", F.coalesce("text", F.lit("")))
    of, r = F.floor(F.col("turn") / 4), (F.col("conv_id") + F.col("turn")) % 6
    old = turns.select(
        F.concat_ws(":", "conv_id", "turn").alias("span_id"), F.col("conv_id").alias("path"), F.col("role").alias("kind"), of.alias("heading"), of.alias("nearby"),
        F.col("turn").alias("ordinal"), F.col("turn").alias("anchor"), "text", r.alias("r"))
    cut = F.substring("text", F.lit(1), F.floor(F.char_length("text") * 3 / 5).cast("int"))
    new = old.where("r < 5").withColumns({
        "heading": F.when(F.col("r") == 4, -1).otherwise(F.col("heading")), "ordinal": F.when(F.col("r") >= 3, F.col("ordinal") + 100).otherwise(F.col("ordinal")),
        "anchor": F.when(F.col("r") <= 1, F.col("anchor")), "text": F.when(F.col("r") == 0, F.col("text")).when(F.col("r") == 4, cut).otherwise(F.concat("text", F.lit(" edited")))})
    hashed = lambda rows: rows.withColumn("text_hash", F.sha1("text"))
    return relocate.relocated(hashed(old), hashed(new))


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= 600")
def char_budget_rendering(spark, sf_dir):
    used = F.sum(F.char_length("text") + 1).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return tables.table(spark, sf_dir, "conversations").select("conv_id", "turn", used.alias("used")).where("used <= 600").select("conv_id", "turn")


@query("SELECT strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day, count(*)::BIGINT AS events, count(DISTINCT user_id)::BIGINT AS anchors, count(*) FILTER (event_type = 'error')::BIGINT AS errors FROM events")
def status_counts(spark, sf_dir):
    return tables.table(spark, sf_dir, "events").agg(
        F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day"), F.count("*").alias("events"),
        F.count_distinct("user_id").alias("anchors"), F.count_if(F.col("event_type") == "error").alias("errors"))
