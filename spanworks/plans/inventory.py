"""Queries over files and the spans in them."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import classify
from ..operators import extract, spans, state, structure
from ..sources import tables
from .registry import FILES, LINES, query


@query(f"WITH {FILES} SELECT doc_id, path, size, hash FROM files")
def inventory_files(spark, sf_dir):
    return tables.files(spark, sf_dir).select("doc_id", "path", "size", "hash")


@query(f"WITH {FILES} SELECT source, count(*)::BIGINT AS files, count(*) FILTER (size > 8192)::BIGINT AS oversized, sum(size)::BIGINT AS bytes, count(DISTINCT hash)::BIGINT AS texts FROM files GROUP BY source")
def inventory_strategy_counts(spark, sf_dir):
    files = tables.files(spark, sf_dir)
    return files.groupBy("source").agg(
        F.count("*").alias("files"), F.count_if(F.col("size") > 8192).alias("oversized"), F.sum("size").alias("bytes"), F.count_distinct("hash").alias("texts"))


#: A path for each page, from its url: adds an extension and some folders, so that the rules have something to tell.
_PAGE_PATH = """pages_ AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'src/' WHEN 1 THEN 'docs/api/' WHEN 2 THEN 'tests/' WHEN 3 THEN 'vendor/' WHEN 4 THEN 'dist/' WHEN 5 THEN 'logs/' WHEN 6 THEN 'old-backup/' ELSE 'examples/' END
  || regexp_replace(regexp_extract(url, '://([^?#]*)', 1), '/$', '') || CASE page_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.json' WHEN 3 THEN '_test.go' ELSE '' END AS path FROM pages)"""


def _page_paths(spark, sf_dir):
    folders = ["src/", "docs/api/", "tests/", "vendor/", "dist/", "logs/", "old-backup/", "examples/"]
    ends = [".py", ".md", ".json", "_test.go", ""]
    at = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("page_id") % len(values) + 1).cast("int"))
    middle = F.regexp_replace(F.regexp_extract("url", "://([^?#]*)", 1), "/$", "")
    return tables.table(spark, sf_dir, "pages").select("page_id", F.concat(at(folders), middle, at(ends)).alias("path"))


@query(f"""WITH {_PAGE_PATH}, parts AS (SELECT page_id, path, string_split(lower(path), '/') AS p FROM pages_)
SELECT page_id, path, CASE WHEN list_has_any(p, ['vendor']) THEN 'vendor' WHEN list_has_any(p, ['dist', 'build', 'coverage', '__pycache__']) OR regexp_matches(lower(path), '\\.(pyc|pyo|min\\.js|map)$') THEN 'generated'
  WHEN list_has_any(p, ['logs', 'runs', 'output', 'artifacts']) THEN 'artifact' WHEN len(list_filter(p, lambda s: regexp_matches(s, '(^|[-_.])backup([-_.]|$)'))) > 0 THEN 'backup' ELSE 'business' END AS layer FROM parts""")
def classify_path_layer(spark, sf_dir):
    return _page_paths(spark, sf_dir).withColumn("layer", classify.layer(F.col("path")))


@query(f"""WITH {_PAGE_PATH}, named AS (SELECT page_id, path, regexp_extract(path, '[^/]*$') AS name, string_split(path, '/') AS parts FROM pages_), ext AS (SELECT *, regexp_extract(name, '^.+(\\.[^.]*)$', 1) AS e FROM named)
SELECT page_id, CASE e WHEN '.py' THEN 'python' WHEN '.md' THEN 'markdown' WHEN '.json' THEN 'json' WHEN '.go' THEN 'go' WHEN '.c' THEN 'c' ELSE 'unknown' END AS language,
  CASE WHEN starts_with(path, 'dist/') THEN 'generated_file' WHEN starts_with(path, 'docs/api/') THEN 'canonical_api_doc' WHEN starts_with(path, 'vendor/') THEN 'vendor_file' WHEN starts_with(path, 'examples/') THEN 'example_doc'
    WHEN e IN ('.py', '.go') AND (list_has_any(parts, ['test', 'tests', '__tests__']) OR regexp_matches(name, '(?i)^test[_-]') OR regexp_matches(name, '(?i)[._-](test|spec)\\.[^.]+$')) THEN 'test_file'
    WHEN starts_with(path, 'src/') THEN 'source_file' WHEN e IN ('.py', '.go') THEN 'source_file' WHEN starts_with(path, 'tests/') THEN 'test_file' WHEN e = '.json' THEN 'config_file' WHEN e = '.md' THEN 'design_doc' ELSE 'unknown' END AS role FROM ext""")
def classify_role_language(spark, sf_dir):
    paths = _page_paths(spark, sf_dir)
    return paths.select("page_id", classify.language(F.col("path")).alias("language"), classify.role(F.col("path")).alias("role"))


@query(f"WITH {_PAGE_PATH} SELECT page_id, path FROM pages_ WHERE NOT regexp_matches(path, '^vendor/.*$') AND NOT regexp_matches(path, '^(?:.*/)?[^/]*\\.json(?:/.*)?$')")
def glob_ignore_filter(spark, sf_dir):
    return _page_paths(spark, sf_dir).where(~classify.ignored(F.col("path"), ["vendor/**", "*.json"]))


@query(f"WITH {_PAGE_PATH} SELECT page_id, CASE WHEN regexp_matches(path, '(?i)\\.(pem|key|p12|pfx)$') THEN 'sensitive' WHEN starts_with(path, 'logs/') THEN 'ignored' WHEN NOT regexp_matches(path, '\\.[a-z]+$') THEN 'extension' END AS reason FROM pages_")
def scan_filter_reasons(spark, sf_dir):
    path = F.col("path")
    reason = F.when(classify.sensitive(path), "sensitive").when(classify.ignored(path, ["logs/**"]), "ignored").when(~path.rlike(r"\.[a-z]+$"), "extension")
    return _page_paths(spark, sf_dir).select("page_id", reason.alias("reason"))


_RED = [("api_key", r"""(?i)["']?api[_-]?key["']?\s*[:=]\s*["']?([A-Za-z0-9_\-]{16,})["']?"""), ("token", r"""(?i)["']?(?:token|bearer|authorization)["']?\s*[:=]\s*["']?([A-Za-z0-9_\-.]{32,})["']?"""), ("secret", r"""(?i)["']?secret["']?\s*[:=]\s*["']?([A-Za-z0-9_\-.]{16,})["']?"""), ("password", r"""(?i)["']?(?:password|passwd|pwd)["']?\s*[:=]\s*(?:"[^"\r\n]{8,256}"|'[^'\r\n]{8,256}'|[^"'\s]{8,128})"""), ("aws_access_key", "AKIA[0-9A-Z]{16}"), ("jwt", r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+"), ("email", r"[a-zA-Z0-9._%+\-]{1,128}@[a-zA-Z0-9.\-]{1,253}\.[a-zA-Z]{2,63}")]


def _redaction_sql() -> str:
    quoted = lambda p: p.replace("'", "''")
    text, steps = "text", []
    for i, (kind, pattern) in enumerate(_RED):
        steps.append(f"r{i + 1} AS (SELECT doc_id, regexp_replace(t, '{quoted(pattern)}', '[REDACTED:{kind}]', 'g') AS t, kinds || CASE WHEN regexp_matches(t, '{quoted(pattern)}') THEN ['{kind}'] ELSE [] END AS kinds FROM r{i})")
    return f"WITH r0 AS (SELECT doc_id, {text} AS t, []::VARCHAR[] AS kinds FROM documents), " + ", ".join(steps) + f" SELECT doc_id, sha1(t) AS redacted_hash, array_to_string(kinds, ',') AS kinds FROM r{len(_RED)} WHERE len(kinds) > 0"


@query(_redaction_sql())
def redact_secrets(spark, sf_dir):
    text, kinds = classify.redacted(F.col("text"))
    found = tables.table(spark, sf_dir, "documents").where(classify.any_redacted(F.col("text"))).select("doc_id", text.alias("t"), kinds.alias("k"))
    return found.select("doc_id", F.sha1("t").alias("redacted_hash"), F.array_join("k", ",").alias("kinds"))


@query("SELECT doc_id, length(left(text, 1024))::BIGINT AS kept, sha1(left(text, 1024)) AS hash, (length(text) > 1024) AS cut FROM documents")
def truncate_indexed_text(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents")
    kept = F.substring("text", 1, 1024)
    return docs.select("doc_id", F.char_length(kept).cast("long").alias("kept"), F.sha1(kept).alias("hash"), (F.char_length("text") > 1024).alias("cut"))


@query()
def truncate_bytes(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents")
    cut = classify.cut_bytes(F.col("text"), 1024, "…")
    return docs.select("doc_id", F.octet_length(cut).cast("long").alias("bytes"), F.sha1(cut).alias("hash"))


@query(f"WITH {FILES}, {LINES} SELECT doc_id, line_no, sha1(line) AS line_hash, length(line)::BIGINT AS chars FROM lines")
def line_spans(spark, sf_dir):
    rows = tables.lines(tables.files(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "line_no", F.sha1("line").alias("line_hash"), F.char_length("line").cast("long").alias("chars"))


@query("SELECT page_id, unnest(range(1, len(h) + 1))::BIGINT AS ordinal, unnest(h) AS href FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS h FROM pages)")
def page_link_spans(spark, sf_dir):
    return tables.page_links(spark, sf_dir).select("page_id", "ordinal", "href")


@query(r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<h[1-6][^>]*>([^<]*)</h[1-6]>', 1)) AS label, unnest(range(1, len(regexp_extract_all(html, '(?i)<h[1-6][^>]*>([^<]*)</h[1-6]>', 1)) + 1))::BIGINT AS ordinal FROM pages),
s AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(label)), '[`*_~\[\]()]', '', 'g'), '[^\p{L}\p{N}\s-]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g') AS base FROM h),
n AS (SELECT *, row_number() OVER (PARTITION BY page_id, base ORDER BY ordinal) - 1 AS n FROM s)
SELECT page_id, ordinal, base, CASE WHEN n = 0 THEN base ELSE base || '-' || n END AS anchor FROM n""")
def page_heading_slugs(spark, sf_dir):
    """The anchors of all headings of each page."""
    labels = F.regexp_extract_all("html", F.lit("(?i)<h[1-6][^>]*>([^<]*)</h[1-6]>"), F.lit(1))
    heads = tables.table(spark, sf_dir, "pages").select("page_id", F.posexplode(labels).alias("at", "label"))
    heads = heads.select("page_id", (F.col("at") + 1).cast("long").alias("ordinal"), classify.slug(F.col("label")).alias("base"))
    return spans.duplicate_slugs(heads, "page_id", "base", "ordinal").select("page_id", "ordinal", "base", "anchor")


@query("SELECT conv_id, turn, role, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS ordinal FROM conversations")
def block_ordinals(spark, sf_dir):
    return spans.block_ordinals(tables.table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role", "ordinal")


@query("""WITH heads AS (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations WHERE role = 'user'), last AS (SELECT conv_id, max(turn) AS m FROM conversations GROUP BY conv_id)
SELECT h.conv_id, h.turn AS start_line, coalesce(h.nxt - 1, l.m) AS end_line FROM heads h JOIN last l USING (conv_id)""")
def section_ranges(spark, sf_dir):
    return spans.section_ranges(tables.table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user")


@query("SELECT conv_id, turn, sha1(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS heading_hash FROM conversations")
def heading_stack(spark, sf_dir):
    rows = spans.heading_of(tables.table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user", F.col("text"))
    return rows.select("conv_id", "turn", F.sha1("heading").alias("heading_hash"))


@query("""WITH d AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS depth FROM conversations)
SELECT a.conv_id, a.turn AS start_line, a.depth, (SELECT min(b.turn) FROM d b WHERE b.conv_id = a.conv_id AND b.turn > a.turn AND b.depth <= a.depth) - 1 AS end_line FROM d a""")
def nested_section_ranges(spark, sf_dir):
    depth = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3)
    return spans.nested_sections(tables.table(spark, sf_dir, "conversations").withColumn("depth", depth), "conv_id", "turn", "depth")


@query(f"""WITH {FILES}, {LINES} SELECT 'file:' || sha1(path || ':' || hash) AS source_id, 'edge:' || sha1(path || ':contains:' || n) AS edge_id, n AS line_no
FROM (SELECT f.path, f.hash, l.line_no AS n FROM files f JOIN lines l ON f.doc_id = l.doc_id WHERE l.line <> '')""")
def contains_edges(spark, sf_dir):
    files = tables.files(spark, sf_dir)
    rows = tables.lines(files.select("path", "hash", "text")).where("line <> ''")
    return rows.select(F.concat(F.lit("file:"), F.sha1(F.concat_ws(":", "path", "hash"))).alias("source_id"), F.concat(F.lit("edge:"), F.sha1(F.concat_ws(":", "path", F.lit("contains"), F.col("line_no").cast("string")))).alias("edge_id"), "line_no")


@query("SELECT min(doc_id) AS doc_id, sha1(text) AS hash FROM documents GROUP BY text")
def dedupe_first_wins(spark, sf_dir):
    return spans.first_wins(tables.files(spark, sf_dir).select("doc_id", "hash"), ["hash"], "doc_id")


@query("SELECT p_partkey, n AS overload, CASE WHEN n = 1 THEN p_name ELSE p_name || '#overload' || n END AS full_name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)")
def overload_ordinals(spark, sf_dir):
    return spans.overload_names(tables.table(spark, sf_dir, "part"), "p_name", "p_partkey").select("p_partkey", "overload", "full_name")


@query(f"WITH {FILES} SELECT source, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs, count(*)::BIGINT AS files FROM files GROUP BY source")
def directory_roles_map(spark, sf_dir):
    return tables.files(spark, sf_dir).groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"), F.count("*").alias("files"))


@query("SELECT role AS field, count(*)::BIGINT AS n FROM conversations GROUP BY role UNION ALL SELECT event_type, count(*)::BIGINT FROM events GROUP BY event_type")
def count_by_field(spark, sf_dir):
    by = lambda name, column: tables.table(spark, sf_dir, name).groupBy(F.col(column).alias("field")).agg(F.count("*").alias("n"))
    return by("conversations", "role").union(by("events", "event_type"))


@query("""WITH d AS (SELECT doc_id, text FROM documents), l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM d)
SELECT doc_id, sha1(rtrim(x[1], ' ')) AS first, sha1(rtrim(x[-1], ' ')) AS last, sha1(array_to_string(list_transform(x[1:8], lambda s: rtrim(s, ' ')), chr(10))) AS head FROM l""")
def line_fingerprints(spark, sf_dir):
    print_ = classify.fingerprints(F.col("text"))
    return tables.table(spark, sf_dir, "documents").select("doc_id", print_["first"].alias("first"), print_["last"].alias("last"), print_["head"].alias("head"))


@query("""WITH n AS (SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS lines FROM documents)
SELECT doc_id, greatest(1, lines // 2 - 20)::BIGINT AS start_line, least(lines, lines // 2 + 20)::BIGINT AS end_line, ceil(lines / 40)::BIGINT AS segments FROM n""")
def bounded_read_range(spark, sf_dir):
    n = F.size(F.split("text", "\n", -1)).cast("long")
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", n.alias("lines"))
    half = F.floor(F.col("lines") / 2)
    return docs.select("doc_id", F.greatest(F.lit(1), half - 20).cast("long").alias("start_line"), F.least("lines", half + 20).cast("long").alias("end_line"), F.ceil(F.col("lines") / 40).cast("long").alias("segments"))


_SEGMENTS = """WITH n AS (SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS lines FROM documents WHERE text IS NOT NULL),
segments AS (SELECT doc_id, lines, s AS start_line, least(lines, s + 39)::BIGINT AS end_line FROM (SELECT doc_id, lines, unnest(range(1, lines + 1, 40))::BIGINT AS s FROM n))"""


def _segments(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("lines"))
    return docs.select("doc_id", "lines", spans.segments(F.lit(1), F.col("lines"), 40).alias("segments"))


@query(f"{_SEGMENTS} SELECT doc_id, start_line, end_line FROM segments")
def segment_ranges(spark, sf_dir):
    """The lines of a document in segments of 40."""
    return _segments(spark, sf_dir).select("doc_id", F.inline("segments"))


@query(f"""{_SEGMENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY abs((start_line + end_line) / 2.0::DOUBLE - (1 + lines // 2)), start_line) AS n FROM segments)
SELECT doc_id, start_line, end_line FROM r WHERE n = 1""")
def preview_segment(spark, sf_dir):
    """The segment nearest to the middle line."""
    return _segments(spark, sf_dir).select("doc_id", spans.nearest_segment(F.col("segments"), 1 + F.floor(F.col("lines") / 2)).alias("s")).select("doc_id", "s.*")


@query("""SELECT page_id, 'feature:' || sha1('page' || t || page_id) AS feature_id, t AS title FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages)""")
def feature_projection(spark, sf_dir):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    pages = tables.table(spark, sf_dir, "pages").select("page_id", title.alias("title"))
    return pages.select("page_id", F.concat(F.lit("feature:"), F.sha1(F.concat(F.lit("page"), "title", F.col("page_id").cast("string")))).alias("feature_id"), "title")


@query("""WITH t AS (SELECT p_brand AS source, p_name AS title, count(*) AS n FROM part GROUP BY ALL)
SELECT source, sum(n) OVER (PARTITION BY source)::BIGINT AS features, title, row_number() OVER (PARTITION BY source ORDER BY title) AS ordinal FROM t""")
def feature_tree(spark, sf_dir):
    """Sources with their features below them: a row for each title, numbered within its source, and how many there are."""
    titles = tables.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("source"), F.col("p_name").alias("title")).agg(F.count("*").alias("n"))
    totals = titles.groupBy(F.col("source").alias("of")).agg(F.sum("n").alias("features"))
    ordinal = F.row_number().over(Window.partitionBy("source").orderBy("title")).cast("long")
    return titles.withColumn("ordinal", ordinal).join(totals, F.col("source").eqNullSafe(F.col("of"))).select("source", "features", "title", "ordinal")


@query("SELECT event_id, ts, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_revision(spark, sf_dir):
    return state.precedence(tables.table(spark, sf_dir, "events"), "user_id", [F.desc("ts"), F.desc("event_id")]).select("event_id", "ts", "user_id")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1))::BIGINT AS line_no FROM documents)
SELECT doc_id, line_no AS line, array_to_string(list_filter(list_transform(string_split(line, '|'), lambda c: trim(c)), lambda c: c <> ''), ',') AS cells FROM l
WHERE contains(line, '|') AND NOT regexp_matches(line, '^\\s*\\|?[\\s:|-]*\\|?\\s*$')""")
def table_row_cells(spark, sf_dir):
    """Cells of lines with pipes."""
    files = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    return extract.table_rows(files).select(F.col("path").alias("doc_id"), "line", F.array_join("cells", ",").alias("cells"))


# The tables hold no RST, JSON or code. The next queries write each row as such a file and take it apart again.


@query("""WITH part_ AS (SELECT p_partkey, p_name, p_brand, p_size FROM part)
SELECT p_partkey, u.kind, u.pointer, u.line::BIGINT AS line, sha1(u.value) AS value_hash FROM (SELECT p_partkey, unnest([
  {'kind': 'config.entry', 'pointer': '/name', 'line': 1, 'value': to_json(p_name)::VARCHAR},
  {'kind': 'config.entry', 'pointer': '/deep', 'line': 1, 'value': '{"brand":' || to_json(p_brand)::VARCHAR || ',"a/b":[' || p_size || ',' || to_json(p_name)::VARCHAR || ']}'},
  {'kind': 'config.entry', 'pointer': '/deep/brand', 'line': 1, 'value': to_json(p_brand)::VARCHAR},
  {'kind': 'config.entry', 'pointer': '/deep/a~1b', 'line': 1, 'value': '[' || p_size || ',' || to_json(p_name)::VARCHAR || ']'},
  {'kind': 'config.array_item', 'pointer': '/deep/a~1b/0', 'line': 1, 'value': p_size::VARCHAR},
  {'kind': 'config.array_item', 'pointer': '/deep/a~1b/1', 'line': 1, 'value': to_json(p_name)::VARCHAR}]) AS u FROM part_)""")
def json_pointers(spark, sf_dir):
    part = tables.table(spark, sf_dir, "part")
    text = F.to_json(F.struct(F.col("p_name").alias("name"), F.struct(F.col("p_brand").alias("brand"), F.array(F.col("p_size").cast("string"), "p_name").alias("a/b")).alias("deep")))
    text = F.regexp_replace(text, r'\["(\d+)",', r"[$1,")
    found = structure.json_spans(part.select(F.concat(F.col("p_partkey").cast("string"), F.lit(".json")).alias("path"), text.alias("text")))
    return found.where("kind <> 'config.file'").select(F.regexp_extract("path", r"^\d+", 0).cast("long").alias("p_partkey"), "kind", "pointer", "line", "value_hash")


@query("""WITH turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations)
SELECT conv_id, 'Turn ' || n AS label, (5 * n - 4)::BIGINT AS start_line, (CASE WHEN n = 1 THEN 5 * total ELSE 5 * n END - 1)::BIGINT AS end_line, CASE WHEN n = 1 THEN 'Turn 1' ELSE 'Turn 1/Turn ' || n END AS heading_path FROM turns""")
def rst_sections(spark, sf_dir):
    turns = tables.table(spark, sf_dir, "conversations").withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    body = F.concat(F.lit("- "), F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")), F.lit("."))
    one = F.concat(F.lit("Turn "), F.col("n").cast("string"), F.lit("\n"), F.when(F.col("n") == 1, "======").otherwise("------"), F.lit("\n\n"), body, F.lit("\n"))
    whole = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", one.alias("t")))), lambda x: x.t), "\n").alias("text"))
    found = structure.rst_blocks(whole.select(F.concat(F.col("conv_id").cast("string"), F.lit(".rst")).alias("path"), "text")).where("kind = 'doc.section'")
    return found.select(F.regexp_extract("path", r"^\d+", 0).cast("long").alias("conv_id"), "label", "start_line", "end_line", F.array_join("heading_path", "/").alias("heading_path"))


@query("""WITH k AS (SELECT s_suppkey, s_suppkey % 5 AS deep FROM supplier)
SELECT s_suppkey, 'f' || s_suppkey AS label, 1::BIGINT AS start_line, (2 * deep + 4)::BIGINT AS end_line, true AS complete FROM k""")
def code_block_ends(spark, sf_dir):
    key, deep = F.col("s_suppkey").cast("string"), (F.col("s_suppkey") % 5).cast("int")
    text = F.concat(F.lit("export function f"), key, F.lit("({ a }) {\n"), F.repeat(F.lit("  if (a) {\n"), deep), F.lit("  // }\n  return '{' == /[}]/\n"), F.repeat(F.lit("  }\n"), deep), F.lit("}\n"))
    files = tables.table(spark, sf_dir, "supplier").select(F.concat(key, F.lit(".ts")).alias("path"), text.alias("text"))
    found = extract.code_spans(files).where("kind = 'code.function'")
    return found.select(F.regexp_extract("path", r"^\d+", 0).cast("long").alias("s_suppkey"), "label", "start_line", "end_line", "complete")
