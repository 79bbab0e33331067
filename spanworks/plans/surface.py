"""Queries over the paths, names and kinds of spans."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import classify, paths
from ..operators import scope
from ..sources.spans import SPANS, spans
from ..sources.tables import table
from .registry import query


@query(f"""WITH {SPANS} SELECT span_id, CASE role WHEN 'source_file' THEN 'source' WHEN 'test_file' THEN 'test' WHEN 'fixture_file' THEN 'test' WHEN 'example_doc' THEN 'example' WHEN 'canonical_api_doc' THEN 'doc' WHEN 'tutorial_doc' THEN 'doc' ELSE 'other' END AS role_group FROM spans""")
def role_groups(spark, sf_dir):
    return spans(spark, sf_dir).select("span_id", paths.role_group(F.col("role")).alias("role_group"))


_ENDS = "[" + ", ".join(f"'{x}'" for e in paths.IMPORT_ENDS for x in (e, f"/index{e}")) + "]"


@query(rf"""WITH {SPANS}, b AS (SELECT span_id, regexp_replace(CASE WHEN doc_id % 3 = 0 THEN regexp_replace(path, '\.[^./]+$', '') WHEN doc_id % 3 = 1 THEN '/' || regexp_replace(path, '[^/]*$', '') || 'index' ELSE path END, '^/+', '') AS p FROM spans),
v AS (SELECT span_id, regexp_replace(p, '/index$', '') AS p FROM b)
SELECT span_id, unnest(CASE WHEN regexp_matches(p, '\.[A-Za-z0-9]+$') THEN [p] ELSE list_concat([p], list_transform({_ENDS}, lambda e: p || e)) END) AS variant FROM v""")
def import_variants(spark, sf_dir):
    """What the path of each span may mean as an import: with and without an ending, as a folder's index."""
    n = F.col("doc_id") % 3
    source = F.when(n == 0, F.regexp_replace("path", r"\.[^./]+$", "")).when(n == 1, F.concat(F.lit("/"), F.regexp_replace("path", "[^/]*$", ""), F.lit("index"))).otherwise(F.col("path"))
    return spans(spark, sf_dir).select("span_id", F.explode(paths.import_variants(source)).alias("variant"))


@query(rf"""WITH {SPANS} SELECT span_id, array_to_string(list_filter(string_split_regex(lower(path || ':' || kind), '[^\p{{L}}0-9]+'), lambda t: length(t) >= 3), ',') AS tokens FROM spans""")
def structured_tokens(spark, sf_dir):
    return spans(spark, sf_dir).select("span_id", F.array_join(paths.structured_tokens(F.concat_ws(":", "path", "kind")), ",").alias("tokens"))


_CUT = lambda s: f"regexp_replace({s}, '^({'|'.join(paths.SOURCE_PREFIXES)})(.+.)$', '\\2')"


@query(rf"""WITH {SPANS}, s AS (SELECT span_id, lower(regexp_replace(regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\.[^.]*$', '\1'), '({"|".join(e.replace(".", r"\.") for e in paths.STEM_ENDS)})$', '')) AS a FROM spans),
b AS (SELECT span_id, list_distinct([a, {_CUT("a")}, {_CUT(_CUT("a"))}]) AS bases FROM s),
w AS (SELECT span_id, bases, list_transform(bases, lambda x: list_filter(string_split_regex(x, '[_\-.]+'), lambda y: y <> '')) AS words FROM b)
SELECT span_id, array_to_string(list_sort(list_distinct(list_concat(bases, flatten(list_transform(words, lambda x: list_transform(range(2, len(x)), lambda i: array_to_string(x[i:], '_'))))))), ',') AS aliases FROM w""")
def stem_aliases(spark, sf_dir):
    """The names by which a source file's test may call it."""
    return spans(spark, sf_dir).select("span_id", F.array_join(paths.stem_aliases(F.col("path"), paths.SOURCE_PREFIXES), ",").alias("aliases"))


@query(rf"""WITH {SPANS} SELECT span_id, role = 'generated_file' AS generated, role <> 'generated_file' AND regexp_extract(path, '\.[^.]*$') IN ('.ts', '.md', '.py', '.json', '.rst') AS text_path, role NOT IN ('generated_file', 'vendor_file') AND NOT regexp_matches(path, '_backup-') AS business FROM spans""")
def path_predicates(spark, sf_dir):
    """Whether a path is generated, read as text when it changes, and business."""
    p = F.col("path")
    return spans(spark, sf_dir).select("span_id", paths.generated(p).alias("generated"), paths.text_path(p).alias("text_path"), (classify.layer(p) == "business").alias("business"))


_SHIFT = "CASE doc_id % 5 WHEN 0 THEN 'planning/' WHEN 1 THEN 'a/runs/' WHEN 2 THEN 'x/models/' WHEN 3 THEN 'suggestions/' ELSE '' END || path || CASE WHEN doc_id % 4 = 0 THEN '.log' ELSE '' END"


@query(rf"""WITH {SPANS}, p AS (SELECT span_id, {_SHIFT} AS p FROM spans) SELECT span_id, regexp_matches(p, '(^|/)runs/|(^|/)(checkpoints?|models?|cache|\.cache)/|(^|/)(planning|archive|archives)/|\.(jsonl|csv|log)$', 'i') AS cold,
  NOT regexp_matches(p, '(^|/)(planning|archive|archives|recommendations?|suggestions?|directions?)/', 'i') AS editable FROM p""")
def cold_paths(spark, sf_dir):
    """Paths that are left cold, and those that may be edited."""
    n = F.col("doc_id")
    front = F.when(n % 5 == 0, "planning/").when(n % 5 == 1, "a/runs/").when(n % 5 == 2, "x/models/").when(n % 5 == 3, "suggestions/").otherwise("")
    p = F.concat(front, "path", F.when(n % 4 == 0, ".log").otherwise(""))
    return spans(spark, sf_dir).select("span_id", paths.cold(p).alias("cold"), paths.editable(p).alias("editable"))


@query(rf"""WITH {SPANS} SELECT span_id, path || ':' || label AS full_name, regexp_replace(path, '\.[^./]+$', '') AS module, label AS symbol, deprecated OR contains(text, '@deprecated') AS deprecated FROM spans WHERE starts_with(kind, 'code.') AND kind <> 'code.module' AND label <> ''""")
def symbols(spark, sf_dir):
    """The symbols of code spans: full name, module, own name, whether deprecated."""
    full = paths.full_name(F.col("path"), F.col("label"), F.lit(None).cast("string"))
    found = spans(spark, sf_dir).where(F.col("kind").startswith("code.") & (F.col("kind") != "code.module") & (F.col("label") != ""))
    return found.select("span_id", full.alias("full_name"), paths.symbol_module(F.col("path")).alias("module"), F.element_at(paths.symbol_path(full), -1).alias("symbol"), (F.col("deprecated") | F.coalesce(F.col("text").contains("@deprecated"), F.lit(False))).alias("deprecated"))


@query(f"""WITH {SPANS}, s AS (SELECT span_id, path, label FROM spans WHERE starts_with(kind, 'code.') AND label <> ''), a AS (SELECT span_id, unnest([upper(label), label || '2']) AS alias FROM s)
SELECT s.span_id, alias FROM s LEFT JOIN a USING (span_id) WHERE label = 'The' OR contains(lower(alias), 'the') OR contains(lower(path), 'client')""")
def symbol_alias_route(spark, sf_dir):
    """Symbols joined with their aliases where the name, an alias or the path has the term."""
    found = spans(spark, sf_dir).where(F.col("kind").startswith("code.") & (F.col("label") != "")).select("span_id", "path", "label")
    aliases = found.select("span_id", F.explode(F.array(F.upper("label"), F.concat("label", F.lit("2")))).alias("alias"))
    both = found.join(aliases, "span_id", "left")
    return both.where((F.col("label") == "The") | F.lower("alias").contains("the") | F.lower("path").contains("client")).select("span_id", "alias")


@query(f"""WITH {SPANS}, f AS (SELECT path, count(*)::BIGINT AS spans, max(stale) AS stale FROM spans GROUP BY path) SELECT s.span_id, f.spans, f.stale FROM spans s LEFT JOIN f USING (path)""")
def spans_with_files(spark, sf_dir):
    """Spans beside the figures of their files."""
    every = spans(spark, sf_dir)
    files = every.groupBy("path").agg(F.count("*").alias("spans"), F.max("stale").alias("stale"))
    return every.select("span_id", "path").join(files, "path", "left").select("span_id", "spans", "stale")


@query(f"""WITH {SPANS} SELECT span_id, CASE WHEN starts_with(kind, 'code.') THEN 'code' WHEN starts_with(kind, 'doc.') THEN 'docs' WHEN starts_with(kind, 'config.') THEN 'config' WHEN starts_with(kind, 'test.') THEN 'tests' ELSE 'secondary' END AS context FROM spans""")
def context_groups(spark, sf_dir):
    """The part of a context that a span belongs to."""
    kind = F.col("kind")
    part = F.when(kind.startswith("code."), "code").when(kind.startswith("doc."), "docs").when(kind.startswith("config."), "config").when(kind.startswith("test."), "tests").otherwise("secondary")
    return spans(spark, sf_dir).select("span_id", part.alias("context"))


@query(f"""WITH {SPANS}, n AS (SELECT split_part(path, '/', 1) AS root, count(*)::BIGINT AS spans, count(DISTINCT path)::BIGINT AS files, count(*) FILTER (regexp_matches(path, 'backup'))::BIGINT AS backups FROM spans GROUP BY 1)
SELECT root, spans, files, backups, CASE WHEN backups > 0 THEN 'backup' WHEN root IN ('vendor', 'dist') THEN 'artifact' END AS warning FROM n""")
def boundary_warnings(spark, sf_dir):
    """Top folders with what is in them and what to beware of."""
    every = spans(spark, sf_dir).groupBy(F.split("path", "/")[0].alias("root")).agg(F.count("*").alias("spans"), F.count_distinct("path").alias("files"), F.count_if(F.col("path").contains("backup")).alias("backups"))
    return every.withColumn("warning", F.when(F.col("backups") > 0, "backup").when(F.col("root").isin("vendor", "dist"), "artifact"))


@query(f"""WITH {SPANS}, d AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS dir FROM spans WHERE doc_id % 29 = 0), n AS (SELECT DISTINCT path FROM spans WHERE role <> 'generated_file'),
r AS (SELECT path, row_number() OVER (ORDER BY path) AS n, count(*) OVER () AS total FROM n WHERE regexp_replace(path, '/[^/]*$', '') IN (SELECT dir FROM d))
SELECT path, greatest(total - {scope.MOST_EXPANDED}, 0)::BIGINT AS omitted FROM r WHERE n <= {scope.MOST_EXPANDED}""")
def changed_path_expansion(spark, sf_dir):
    """Changed folders as the text files in them, so many at most, and how many more there are."""
    every = spans(spark, sf_dir)
    changed = every.where("doc_id % 29 = 0").select(F.regexp_replace("path", "/[^/]*$", "").alias("path"))
    return scope.expanded(changed, every.select("path"))


@query(f"""WITH {SPANS}, old AS (SELECT span_id, sha1(text) AS h FROM spans), now AS (SELECT span_id, CASE WHEN doc_id % 7 = 0 THEN sha1(text || '!') WHEN doc_id % 11 = 0 THEN NULL ELSE sha1(text) END AS h FROM spans)
SELECT span_id, CASE WHEN n.h IS NULL THEN 'missing' WHEN n.h <> o.h THEN 'stale' ELSE 'fresh' END AS state FROM old o JOIN now n USING (span_id)""")
def coverage_staleness(spark, sf_dir):
    """Whether what was indexed is still there and the same."""
    every = spans(spark, sf_dir)
    old = every.select("span_id", F.sha1(F.col("text")).alias("h"))
    now = every.select("span_id", F.when(F.col("doc_id") % 7 == 0, F.sha1(F.concat("text", F.lit("!")))).when(F.col("doc_id") % 11 != 0, F.sha1(F.col("text"))).alias("now"))
    state = F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("h"), "stale").otherwise("fresh")
    return old.join(now, "span_id").select("span_id", state.alias("state"))


@query(f"""WITH {SPANS}, r AS (SELECT span_id, path, role, linked, row_number() OVER (PARTITION BY path ORDER BY linked DESC, start_line, span_id) AS n FROM spans)
SELECT span_id, CASE WHEN linked < 0.45 THEN 'low_confidence' WHEN n > 2 THEN 'over_limit' ELSE 'read' END AS reason FROM r""")
def read_targets(spark, sf_dir):
    """Which spans of a path are read, and why the others are not."""
    n = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("linked"), "start_line", "span_id"))
    ranked = spans(spark, sf_dir).select("span_id", "linked", n.alias("n"))
    return ranked.select("span_id", F.when(F.col("linked") < 0.45, "low_confidence").when(F.col("n") > 2, "over_limit").otherwise("read").alias("reason"))


@query("""WITH t AS (SELECT user_id, event_type, count(*)::BIGINT AS n, bool_and(value IS NOT NULL) AS ok, max(ts) AS last FROM events GROUP BY ALL)
SELECT user_id, bool_and(ok) AS ok, CASE min(CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END) WHEN 0 THEN 'error' WHEN 1 THEN 'partial' ELSE 'ready' END AS state, max(last) AS revision, sum(n)::BIGINT AS total FROM t GROUP BY user_id""")
def envelope_combine(spark, sf_dir):
    """Answers of several tools as one: all well, the worst state, the last revision, sums."""
    rank = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    found = table(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_and(F.col("value").isNotNull()).alias("ok"), F.min(rank).alias("worst"), F.max("ts").alias("revision"), F.count("*").alias("total"))
    return found.select("user_id", "ok", F.when(F.col("worst") == 0, "error").when(F.col("worst") == 1, "partial").otherwise("ready").alias("state"), "revision", "total")


@query(f"""WITH {SPANS} SELECT span_id, sha1(text) AS text_hash, 'doc:' || sha1(path || ':' || kind || ':' || label) AS locator, sha1(heading) AS heading_hash, coalesce(nullif(label, ''), path) AS summary, len(string_split(text, chr(10)))::BIGINT AS lines FROM spans""")
def span_records(spark, sf_dir):
    """What is stored of a span: hashes of its text and headings, its locator, a summary, its length."""
    locator = F.concat(F.lit("doc:"), F.sha1(F.concat_ws(":", "path", "kind", "label")))
    return spans(spark, sf_dir).select(
        "span_id", F.sha1(F.col("text")).alias("text_hash"), locator.alias("locator"), F.sha1(F.col("heading")).alias("heading_hash"), F.coalesce(F.nullif("label", F.lit("")), "path").alias("summary"), F.size(F.split("text", "\n", -1)).cast("long").alias("lines"))


@query(f"""WITH {SPANS} SELECT split_part(kind, '.', 1) AS surface, count(*)::BIGINT AS spans, count(DISTINCT path)::BIGINT AS files, count(*) FILTER (stale)::BIGINT AS stale, count(*) FILTER (deprecated)::BIGINT AS deprecated FROM spans GROUP BY 1""")
def surface_counters(spark, sf_dir):
    """Counts of what is indexed, by surface."""
    surface = F.split("kind", r"\.")[0].alias("surface")
    return spans(spark, sf_dir).groupBy(surface).agg(F.count("*").alias("spans"), F.count_distinct("path").alias("files"), F.count_if("stale").alias("stale"), F.count_if("deprecated").alias("deprecated"))
