"""Queries over what changes: moved spans, likely tests, enclosing elements, impact, anchors, logs and snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from ..operators import anchors, features, graph, intervals, redact, state, verify, windows
from ..sources import corpus, tables
from ..sources.corpus import SPANS_SQL
from ..sources.snapshots import Snapshots
from ..sources.store import shared_folder, staged
from .checks import _DELTA, _snapshots, anchor_lifecycle_fold
from .registry import EDGES, FILES, query

#: Lines of a span of `line_window_relocation`.
CHUNK = 12


@query(f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS old FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, old, list_concat(CASE WHEN doc_id % 2 = 0 THEN ['inserted'] ELSE [] END, list_filter(old, lambda x, i: NOT (doc_id % 3 = 0 AND i % {CHUNK} = 10))) AS now FROM l),
s AS (SELECT *, unnest(range(0, len(old), {CHUNK})) AS at0 FROM n), t AS (SELECT doc_id, at0, old[at0 + 1:at0 + {CHUNK}] AS lines, now FROM s), w AS (SELECT *, len(lines) AS k, least(len(lines), 8) AS w FROM t),
c AS (SELECT doc_id, at0, lines, now, k, w, unnest(range(1, len(now) - k + 2)) AS f FROM w),
p AS (SELECT doc_id, at0, f, CASE WHEN now[f:f + w - 1] = lines[1:w] THEN 4 ELSE 0 END + CASE WHEN now[f + k - w:f + k - 1] = lines[k - w + 1:k] THEN 4 ELSE 0 END AS ends, CASE WHEN now[f] = lines[1] THEN 1 ELSE 0 END + CASE WHEN now[f + k - 1] = lines[k] THEN 1 ELSE 0 END AS single FROM c)
SELECT doc_id || ':' || (at0 + 1) AS span_id, f::BIGINT AS found_line, (ends + single)::BIGINT AS score FROM p WHERE ends >= 4
QUALIFY row_number() OVER (PARTITION BY doc_id, at0 ORDER BY CASE WHEN ends + single >= 8 THEN 0 ELSE 1 END, ends + single DESC, CASE WHEN ends + single >= 8 THEN 0 ELSE abs(f - at0 - 1) END, f) = 1""")
def line_window_relocation(spark, sf_dir):
    """Spans of twelve lines of all documents, and where they are found in a later snapshot: of every second document a line
    more stands at the top, of every third each twelfth line from the tenth on is gone."""
    docs = tables.table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("path"), F.split("text", "\n", -1).alias("old"))
    starts = docs.select("path", "old", F.explode(F.sequence(F.lit(0), F.size("old") - 1, F.lit(CHUNK))).alias("at"))
    spans = starts.select(F.concat_ws(":", "path", F.col("at") + 1).alias("span_id"), "path", (F.col("at") + 1).alias("start_line"), F.slice("old", F.col("at") + 1, F.lit(CHUNK)).alias("lines"))
    left = F.filter("old", lambda x, i: ~((F.col("path") % 3 == 0) & ((i + 1) % CHUNK == 10)))
    now = F.concat(F.when(F.col("path") % 2 == 0, F.array(F.lit("inserted"))).otherwise(F.array().cast("array<string>")), left)
    lines = docs.select("path", F.posexplode(now).alias("_at", "line")).select("path", (F.col("_at") + 1).alias("line_no"), "line")
    return windows.found_again(windows.fingerprints(spans), lines)


_NAME = lambda text, n: f"array_to_string(regexp_extract_all(lower({text}), '[a-z]+')[1:{n}], '_')"


_TITLE = "regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)"


@query(f"""WITH s AS (SELECT DISTINCT {_NAME(_TITLE, 3)} AS stem FROM pages), sw AS (SELECT 'src/' || stem || '.ts' AS source, stem, string_split(stem, '_') AS words FROM s WHERE stem <> ''),
cs AS (SELECT source, unnest(list_distinct(list_concat([stem, regexp_replace(stem, '^(check_|verify_|validate_|run_)(..)', '\\2')], list_transform(range(2, len(words)), lambda i: array_to_string(words[i:], '_'))))) AS stem FROM sw),
t AS (SELECT DISTINCT {_NAME("text", 10)} AS name FROM documents), w AS (SELECT 'tests/test_' || name || '.py' AS test, name, string_split(name, '_') AS words FROM t WHERE name <> ''),
ct AS (SELECT test, unnest(list_distinct(list_concat(['test_' || name, regexp_replace(name, '^(test_|spec_)(..)', '\\2'), CASE WHEN len(words) >= 2 THEN name END], list_transform(range(1, len(words)), lambda i: array_to_string(words[i:], '_'))))) AS stem FROM w)
SELECT DISTINCT source, test FROM cs JOIN ct ON cs.stem = ct.stem OR length(cs.stem) >= 8 AND contains(ct.stem, cs.stem)""")
def linked_tests_heuristic(spark, sf_dir):
    """Sources named after the first three words of each page's title, and the tests, named after the first ten words of each
    document, whose names speak of them."""

    def paths_of(text, n, front, end):
        name = F.array_join(F.slice(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), 1, n), "_")
        return lambda table: tables.table(spark, sf_dir, table).select(name.alias("n")).where("n <> ''").distinct().select(F.concat(F.lit(front), "n", F.lit(end)).alias("path"))

    title = F.regexp_extract("html", "<h1[^>]*>([^<]*)</h1>", 1)
    return verify.likely_tests(paths_of(title, 3, "src/", ".ts")("pages"), paths_of(F.col("text"), 10, "tests/test_", ".py")("documents"))


_PAIRED = ["html", "body", "nav", "ul", "li", "article"]
_TAGS = f"""tags AS (SELECT page_id, at0, regexp_extract(piece, '^/?([a-z0-9]+)', 1) AS name, NOT starts_with(piece, '/') AS opens FROM (
  SELECT page_id, unnest(string_split(html, '<')) AS piece, unnest(range(len(string_split(html, '<')))) AS at0 FROM pages) WHERE at0 > 0)"""


@query(f"""WITH {_TAGS}, marks AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE -1 END) OVER (PARTITION BY page_id, name ORDER BY at0) + CASE WHEN opens THEN 0 ELSE 1 END AS depth FROM tags WHERE name IN ({", ".join(repr(t) for t in _PAIRED)})),
e AS (SELECT page_id, name, at0 AS start, lead(at0) OVER line AS stop, opens, lead(opens) OVER line AS then_opens FROM marks WINDOW line AS (PARTITION BY page_id, name, depth ORDER BY at0)), i AS (SELECT * FROM e WHERE opens AND NOT then_opens),
p AS (SELECT page_id, at0, name FROM tags WHERE opens AND name IN ('a', 'p', 'h1'))
SELECT p.page_id, p.at0::BIGINT AS pos, p.name, arg_max(i.name, i.start) AS owner, max(i.start)::BIGINT AS owner_at FROM p LEFT JOIN i ON i.page_id = p.page_id AND i.start < p.at0 AND i.stop > p.at0 GROUP BY ALL""")
def enclosing_elements(spark, sf_dir):
    """Links, paragraphs and titles of all pages, and the innermost element around each."""
    pieces = tables.table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split("html", "<", -1)).alias("pos", "piece")).where("pos > 0")
    tags = pieces.select("page_id", F.col("pos").cast("long").alias("pos"), F.regexp_extract("piece", "^/?([a-z0-9]+)", 1).alias("name"), (~F.col("piece").startswith("/")).alias("opens"))
    around = intervals.nested(tags.where(F.col("name").isin(_PAIRED)), "page_id").withColumn("id", F.struct("start", "name"))
    points = tags.where(F.col("opens") & F.col("name").isin("a", "p", "h1")).select("page_id", "pos", "name")
    found = intervals.innermost(points, around.drop("name"), "page_id")
    return found.select("page_id", "pos", "name", F.col("owner.name").alias("owner"), F.col("owner.start").alias("owner_at"))


def _step(n: int) -> str:
    return f"""r{n} AS (SELECT s.other AS node, {n} AS hops, f.path || '>' || s.other AS path, f.strength * s.confidence AS strength FROM steps s JOIN f{n - 1} f USING (node)
  WHERE s.other NOT IN (SELECT node FROM seen{n - 1}) QUALIFY row_number() OVER (PARTITION BY s.other ORDER BY s.confidence DESC, f.node) = 1),
f{n} AS (SELECT * FROM r{n}), seen{n} AS (SELECT node FROM seen{n - 1} UNION ALL SELECT node FROM f{n})"""


_IMPACT = f"""{EDGES}, steps AS (SELECT node, other, max(confidence) AS confidence FROM (SELECT source_id AS node, target_id AS other, confidence FROM edges UNION ALL SELECT target_id, source_id, confidence FROM edges) GROUP BY ALL),
f0 AS (SELECT 'supplier:' || s_suppkey AS node, 0 AS hops, 'supplier:' || s_suppkey AS path, 1.0::DOUBLE AS strength FROM supplier WHERE s_name LIKE '%00001'), seen0 AS (SELECT node FROM f0), {_step(1)}, {_step(2)},
reached AS (SELECT *, split_part(node, ':', 1) AS kind FROM f0 UNION ALL SELECT *, split_part(node, ':', 1) FROM f1 UNION ALL SELECT *, split_part(node, ':', 1) FROM f2)"""


def _reached(spark, sf_dir):
    """What is reached from the suppliers of one name, within two hops; the names are resolved to nodes."""
    suppliers = tables.table(spark, sf_dir, "supplier")
    nodes = suppliers.select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("span_id"), F.col("s_name").alias("path"), F.lit("code.class").alias("kind"), F.col("s_name").alias("label"), F.lit(1).alias("start_line"))
    wanted = suppliers.where(F.col("s_name").endswith("00001")).select(F.col("s_name").alias("target"), F.lit("auto").alias("type")).distinct()
    found = graph.impact_paths(tables.edges(spark, sf_dir, once=False), graph.resolved_seeds(wanted, nodes).select("node"), 2)
    return found.withColumn("kind", F.split("node", ":")[0])


@query(f"WITH {_IMPACT} SELECT node, hops::BIGINT AS hops, path, round(strength, 9) AS strength FROM reached ORDER BY hops, strength DESC, node LIMIT 50")
def impact_paths(spark, sf_dir):
    """The fifty nearest nodes that a change of some suppliers reaches, and by which way."""
    best = _reached(spark, sf_dir).orderBy("hops", F.desc("strength"), "node").limit(50)
    return best.select("node", "hops", F.array_join("path", ">").alias("path"), F.round("strength", 9).alias("strength"))


@query(f"WITH {_IMPACT} SELECT kind, node, row_number() OVER (PARTITION BY kind ORDER BY hops, strength DESC, node) AS place FROM reached QUALIFY place <= 25")
def impact_groups(spark, sf_dir):
    """The same by kind of node, twenty-five of each."""
    return graph.grouped_impact(_reached(spark, sf_dir), "kind").select("kind", "node", "place")


# Events a user's anchor was last seen before the newest one: dormant, archived; ignored in a row: retired.
_DORMANT, _ARCHIVED, _RETIRED = 40, 200, 6
_WORKSET = f"""e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts IS NULL, ts, event_id) AS rn FROM events),
g AS (SELECT user_id, count(*) AS seen, count(*) FILTER (event_type = 'click') AS useful, count(*) FILTER (event_type = 'error') AS errors, bool_or(event_type = 'purchase') AS pinned, max(rn) FILTER (event_type = 'click') AS u,
  max(rn) FILTER (event_type = 'error') AS i, max(rn) FILTER (event_type IN ('signup', 'purchase')) AS a, max(event_id) AS last_seen, arg_max(event_type, rn) AS last_type FROM e GROUP BY user_id),
folded AS (SELECT g.*, CASE WHEN useful = 0 AND errors >= 2 AND (a IS NULL OR i > a) THEN 'dormant' ELSE 'active' END AS state, CASE WHEN useful = 0 THEN errors ELSE (SELECT count(*) FROM e WHERE e.user_id = g.user_id AND event_type = 'error' AND rn > u) END AS ignored FROM g)"""
_AGED = f"""{_WORKSET}, m AS (SELECT max(event_id) AS now FROM events),
aged AS (SELECT user_id AS id, coalesce(c_mktsegment, 'none') AS path, useful, ignored, last_seen, pinned AND user_id % 4 = 0 AS pinned, last_type = 'signup' AND user_id % 5 = 0 AS forgotten, state, now - last_seen AS unseen FROM folded LEFT JOIN customer ON c_custkey = user_id, m),
lived AS (SELECT id, path, pinned, CASE WHEN forgotten THEN 'tombstoned' WHEN NOT pinned AND ignored >= {_RETIRED} THEN 'retired' WHEN NOT pinned AND unseen > {_ARCHIVED} THEN 'archived' WHEN NOT pinned AND unseen > {_DORMANT} AND state = 'active' THEN 'dormant' ELSE state END AS state, useful, ignored, last_seen FROM aged),
ranked AS (SELECT *, (CASE state WHEN 'active' THEN 1000 WHEN 'dormant' THEN 100 WHEN 'archived' THEN 10 ELSE -1000 END + CASE WHEN pinned THEN 500 ELSE 0 END + useful + 10 * useful - 5 * ignored + last_seen / 1000.0::DOUBLE)::DOUBLE AS rank_score FROM lived)"""
_BUDGETS = state.Budgets(per_path=25, active_per_path=6, active=24, pinned=10, cold=40)
_CAPPED = f"""{_AGED}, one AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY rank_score DESC, path, id) AS n FROM ranked WHERE state <> 'tombstoned' QUALIFY n <= {_BUDGETS.per_path}),
two AS (SELECT *, CASE WHEN state = 'active' AND row_number() OVER (PARTITION BY path, state ORDER BY rank_score DESC, path, id) <= {_BUDGETS.active_per_path} THEN 1 ELSE 0 END AS able FROM one),
three AS (SELECT *, able = 1 AND sum(able) OVER (ORDER BY rank_score DESC, path, id) <= {_BUDGETS.active} AS stays_active, pinned AND sum(pinned::INT) OVER (ORDER BY rank_score DESC, path, id) <= {_BUDGETS.pinned} AS stays_pinned FROM two),
four AS (SELECT id, path, CASE WHEN state = 'active' AND NOT stays_active THEN 'dormant' ELSE state END AS state, stays_pinned AS pinned, rank_score FROM three),
capped AS (SELECT *, sum((state <> 'active')::INT) OVER (ORDER BY rank_score DESC, path, id) AS cold FROM four QUALIFY state = 'active' OR pinned OR cold <= {_BUDGETS.cold})"""


def _workset(spark, sf_dir):
    """Anchors of users, in one of five states: pinned by a purchase, forgotten where a last sign-up says so, aged by events."""
    events = tables.table(spark, sf_dir, "events")
    at = F.struct(F.col("ts").isNull().alias("none"), "ts", "event_id")
    seen = events.groupBy(F.col("user_id").alias("of")).agg(F.max("event_id").alias("last_seen"), F.max_by("event_type", at).alias("last_type"))
    paths_of = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("path"))
    rows = state.anchor_lifecycle(events).withColumnRenamed("user_id", "id").join(seen, F.col("id").eqNullSafe(F.col("of"))).join(paths_of, "id", "left")
    rows = rows.withColumns({"path": F.coalesce("path", F.lit("none")), "pinned": F.col("pinned") & (F.col("id") % 4 == 0), "forgotten": (F.col("last_type") == "signup") & (F.col("id") % 5 == 0)})
    rows = rows.crossJoin(events.agg(F.max("event_id").alias("now")))  # one row
    rows = state.aged(rows, F.col("last_seen"), F.col("now"), _DORMANT, _ARCHIVED, _RETIRED)
    return staged(state.anchor_rank(rows, F.col("useful"), F.col("last_seen")).select("id", "path", "state", "pinned", F.col("rank_score").cast("double").alias("rank_score")))


@query(f"WITH {_AGED} SELECT id, path, state, pinned FROM lived")
def anchor_states(spark, sf_dir):
    return _workset(spark, sf_dir).select("id", "path", "state", "pinned")


@query(f"WITH {_CAPPED} SELECT id, path, state, pinned, round(rank_score, 6) AS rank_score FROM capped")
def anchor_caps(spark, sf_dir):
    """The anchors within all budgets, with what was made dormant and unpinned."""
    return state.capped_anchors(_workset(spark, sf_dir), _BUDGETS).select("id", "path", "state", "pinned", F.round("rank_score", 6).alias("rank_score"))


@query(f"""WITH {_CAPPED}, b AS (SELECT r.state AS was, r.pinned AS pin, c.state, c.pinned FROM ranked r LEFT JOIN capped c USING (id) WHERE r.state <> 'tombstoned')
SELECT * FROM (SELECT 'dropped' AS warning, count(*) FILTER (state IS NULL)::BIGINT AS n FROM b UNION ALL SELECT 'made_dormant', count(*) FILTER (was = 'active' AND state = 'dormant') FROM b UNION ALL SELECT 'unpinned', count(*) FILTER (pin AND NOT pinned) FROM b) WHERE n > 0""")
def anchor_cap_warnings(spark, sf_dir):
    before = _workset(spark, sf_dir)
    return state.cap_warnings(before, state.capped_anchors(before, _BUDGETS))


@query("""SELECT event_id, '{"user":' || user_id || ',"props":' || replace(props, ' ', '') || ',"note":"' || CASE WHEN event_type = 'click' THEN '[REDACTED:email]' ELSE event_type END || '","api_key":"[REDACTED:metadata]","inner":[{"Token_x":"[REDACTED:metadata]","ok":true,"deep":' ||
  CASE WHEN event_type = 'view' THEN '{"a":{"b":{"c":{"d":{"e":"[REDACTED:metadata_depth]"}}}}}' ELSE 'null' END || '}]}' AS metadata FROM events""")
def metadata_redaction(spark, sf_dir):
    """Nested metadata made of all events, with secrets under keys, in texts and too deep, redacted."""
    note = F.when(F.col("event_type") == "click", F.concat(F.lit("u"), "user_id", F.lit("@example.com"))).otherwise(F.col("event_type"))
    deep = F.when(F.col("event_type") == "view", '{"a": {"b": {"c": {"d": {"e": {"f": 1}}}}}}').otherwise("null")
    text = F.concat(F.lit('{"user": '), "user_id", F.lit(', "props": '), "props", F.lit(', "note": "'), note, F.lit('", "api_key": {"k": "'), "event_id", F.lit('"}, "inner": [{"Token_x": 5, "ok": true, "deep": '), deep, F.lit("}]}"))
    return redact.redacted_metadata(tables.table(spark, sf_dir, "events").select("event_id", text.alias("metadata")))


@query(rf"""WITH {SPANS_SQL}, h AS (SELECT path, start_line, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(label)), '[`*_~\[\]()]', '', 'g'), '[^\p{{L}}\p{{N}}\s-]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g') AS base FROM spans WHERE kind = 'doc.heading'),
a AS (SELECT path, base, row_number() OVER (PARTITION BY path, base ORDER BY start_line) - 1 AS n FROM h), s AS (SELECT path, CASE WHEN n = 0 THEN base ELSE base || '-' || n END AS slug FROM a),
l AS (SELECT page_id, concat_ws('/', 'web', regexp_replace(coalesce(url, ''), '^[^:]*://|/*(?:[?#].*)?$', '', 'g'), page_id::VARCHAR || '.md') AS target, regexp_extract(url, '#(.*)$', 1) AS fragment FROM pages)
SELECT page_id::VARCHAR AS path, target, fragment FROM l WHERE fragment <> '' AND (target, lower(fragment)) NOT IN (SELECT (path, slug) FROM s)""")
def stale_anchors(spark, sf_dir):
    """Pages whose own address has a fragment that none of their headings makes."""
    place = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[^:]*://|/*(?:[?#].*)?$", "")
    target = F.concat_ws("/", F.lit("web"), place, F.concat(F.col("page_id").cast("string"), F.lit(".md")))
    linked = tables.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), target.alias("target"), F.regexp_extract("url", "#(.*)$", 1).alias("fragment"))
    linked = staged(linked.where("fragment <> ''"))
    # Only files that an address with a fragment names are taken apart.
    named = corpus.files(spark, sf_dir).join(linked.select(F.col("target").alias("path")).distinct(), "path", "left_semi")
    every = staged(corpus.titled_lines(named).select("path", F.col("start_line").alias("line_no"), F.col("title").alias("label")))
    heads = every.where("label is not null").union(every.select("path", F.lit(0).cast("long"), F.lit(None).cast("string")).distinct())
    return verify.stale_anchors(linked, heads)


def _refreshed(spark, sf_dir):
    """A table of all files in a new folder: a first version, one by a delta, one that takes the delta back, and a last one."""
    before, after = _snapshots(spark, sf_dir)
    before, after = (staged(x.dropDuplicates(["path"])) for x in (before, after))
    table = Snapshots(spark, f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}")
    change = staged(state.changed_files(before, after))
    forth = (after.join(change.where("change <> 'deleted'"), "path", "left_semi"), change.where("change = 'deleted'").select("path"))
    back = (before.join(change.where("change <> 'added'"), "path", "left_semi"), change.where("change = 'added'").select("path"))
    table.replace(before)
    made = [table.manifest(), table.apply(*forth, base=1), table.apply(*forth), table.apply(*back), table.replace(after)]
    table.retain(2)
    return table, made


@query(f"WITH {_DELTA} SELECT path, hash FROM after")
def snapshot_refresh(spark, sf_dir):
    """The last version of a table of all files, after deltas both ways, a delta without a change, and retention."""
    return _refreshed(spark, sf_dir)[0].read()


@query(f"""WITH {_DELTA}, c AS (SELECT CASE WHEN x.path IS NULL THEN 'added' WHEN y.path IS NULL THEN 'deleted' WHEN x.hash <> y.hash THEN 'modified' END AS change FROM before x FULL JOIN after y USING (path)),
n AS (SELECT count(*) FILTER (change = 'added') AS a, count(*) FILTER (change = 'modified') AS m, count(*) FILTER (change = 'deleted') AS d FROM c), z AS (SELECT (SELECT count(*) FROM before) AS b, (SELECT count(*) FROM after) AS e)
SELECT v::BIGINT AS version, CASE WHEN v % 2 = 1 THEN b ELSE e END::BIGINT AS rows, CASE WHEN v = 1 THEN b WHEN v % 2 = 0 THEN a ELSE d END::BIGINT AS added, CASE WHEN v = 1 THEN 0 ELSE m END::BIGINT AS modified, CASE WHEN v = 1 THEN 0 WHEN v % 2 = 0 THEN d ELSE a END::BIGINT AS deleted FROM n, z, range(1, 5) AS r(v)""")
def refresh_report(spark, sf_dir):
    """What each version of that table changed; the delta without a change made none."""
    made = {v.version: (v.version, v.rows, v.added, v.modified, v.deleted) for v in _refreshed(spark, sf_dir)[1]}
    return spark.createDataFrame(list(made.values()), "version long, rows long, added long, modified long, deleted long")


_COMMANDS = """cmds AS (SELECT event_id AS seq, user_id, CASE event_type WHEN 'error' THEN CASE WHEN value > 200 THEN 'retire' ELSE 'demote' END ELSE 'promote' END AS action, event_type = 'purchase' AND value > 150 AS pin,
  CASE WHEN value > 60 THEN 'archived' ELSE 'dormant' END AS st FROM events WHERE event_type IN ('signup', 'purchase', 'error')),
begun AS (SELECT user_id, min(seq) FILTER (action = 'promote') AS b FROM cmds GROUP BY user_id), live AS (SELECT c.* FROM cmds c JOIN begun USING (user_id) WHERE seq >= b),
gone AS (SELECT user_id, min(seq) FILTER (action = 'retire') AS r FROM live GROUP BY user_id), done AS (SELECT l.* FROM live l JOIN gone USING (user_id) WHERE r IS NULL OR seq <= r),
after_ AS (SELECT 'users/' || user_id || '.md' AS path, arg_max(CASE action WHEN 'promote' THEN 'active' WHEN 'retire' THEN 'tombstoned' ELSE st END, seq) AS state, bool_or(pin AND action = 'promote') AS pinned, max(seq)::DOUBLE AS last_seen FROM done GROUP BY user_id)"""


def _commanded(spark, sf_dir):
    """Events as commands over anchors of users: sign-ups and purchases promote, errors demote or, from a value on, retire."""
    events = tables.table(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "purchase", "error"))
    action = F.when(F.col("event_type") == "error", F.when(F.col("value") > 200, "retire").otherwise("demote")).otherwise("promote")
    commands = events.select(F.col("event_id").alias("seq"), action.alias("action"), F.concat(F.lit("./users/"), F.col("user_id").cast("string"), F.lit(".md")).alias("path"),
        F.when(F.col("value") > 60, "archived").otherwise("dormant").alias("state"), ((F.col("event_type") == "purchase") & (F.col("value") > 150)).alias("pinned"))
    none = spark.createDataFrame([], "path string, state string, pinned boolean, score double, confidence double, last_seen double")
    return anchors.commanded(none, commands)


@query(f"WITH {_COMMANDS} SELECT path, state, pinned, last_seen, 100.0::DOUBLE AS score FROM after_")
def anchor_commands(spark, sf_dir):
    return _commanded(spark, sf_dir)[0].select("path", "state", "pinned", "last_seen", "score")


@query(f"WITH {_COMMANDS} SELECT seq, 'users/' || user_id || '.md' AS path, 'no such anchor' AS warning FROM cmds LEFT JOIN begun USING (user_id) WHERE b IS NULL OR seq < b")
def anchor_command_warnings(spark, sf_dir):
    return _commanded(spark, sf_dir)[1]


@query(f"""WITH {_COMMANDS}, n AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY last_seen DESC, path) AS n FROM after_)
SELECT state, count(*)::BIGINT AS n, array_to_string(list(path ORDER BY n) FILTER (n <= 10), ',') AS shown, greatest(count(*) - 10, 0)::BIGINT AS omitted FROM n GROUP BY state""")
def anchor_status(spark, sf_dir):
    """How many anchors are in each state after the commands, and those seen last."""
    return anchors.status(_commanded(spark, sf_dir)[0].withColumn("rank_score", F.col("last_seen"))).select("state", "n", F.array_join("shown", ",").alias("shown"), "omitted")


@query(f"""WITH {EDGES}, s AS (SELECT DISTINCT node, other FROM (SELECT source_id AS node, target_id AS other FROM edges WHERE confidence >= 0.6 UNION ALL SELECT target_id, source_id FROM edges WHERE confidence >= 0.6))
SELECT 'nation:' || n_nationkey AS id, other AS linked FROM nation LEFT JOIN s ON node = 'nation:' || n_nationkey""")
def feature_clusters(spark, sf_dir):
    """Nations as features, and all that sure edges link to them."""
    nodes = tables.table(spark, sf_dir, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"))
    return features.clusters(nodes, tables.edges(spark, sf_dir, once=False))


@query(f"""WITH {SPANS_SQL}, safe AS (SELECT * FROM spans WHERE NOT regexp_matches(path, '(^|/)(dist|build|logs|archive|backup)/') AND len(list_filter([{", ".join(repr(t) for t in features.FORBIDDEN)}], lambda t: contains(lower(concat_ws(chr(10), path, label, summary, text)), t))) = 0)
SELECT 'directories' AS section, split_part(path, '/', 1) AS path, 'design_doc' AS label, NULL AS kind, count(*)::BIGINT AS n FROM safe GROUP BY 2
UNION ALL SELECT 'documents', path, label, 'design_doc', 1 FROM safe UNION ALL SELECT 'links', heading_id, span_id, 'contains 1.00', 1 FROM safe WHERE heading_id <> span_id""")
def repository_map(spark, sf_dir):
    """The map of all documents and pages: top folders, documents, and which heading each span stands under."""
    every = staged(corpus.spans(spark, sf_dir).select("span_id", "path", "role", "kind", "label", "heading_id", "summary", "text"))
    return features.repository_map(every, corpus.contains_edges(every))
