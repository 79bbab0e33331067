"""Operators over small frames made for them."""

import random

import pytest
from pyspark.sql import functions as F

from spanworks.functions import classify, ranking, scoring
from spanworks.functions.requests import normalize
from spanworks.operators import graph, links, relocate, spans, state, verify
from spanworks.plans import retrieval
from spanworks.sources import tables
from spanworks.streaming import lifecycle


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("path, role, language, layer", [
    ("README.md", "readme_doc", "markdown", "business"), ("README", "unknown", "markdown", "business"), ("docs/api/x.md", "canonical_api_doc", "markdown", "business"), ("docs/tutorial-1/x.rst", "tutorial_doc", "rst", "business"),
    ("vendor/a.js", "vendor_file", "javascript", "vendor"), ("examples/a.py", "example_doc", "python", "business"), ("tests/a.py", "test_file", "python", "business"), ("src/a_test.go", "test_file", "go", "business"),
    ("src/a.ts", "source_file", "typescript", "business"), ("tool.rs", "source_file", "rust", "business"), ("a/b.schema.json", "schema_file", "json", "business"), ("package.json", "package_metadata", "json", "business"),
    ("conf/a.yaml", "config_file", "yaml", "business"), ("notes/a.md", "experiment_note_doc", "markdown", "business"), ("dist/a.js", "generated_file", "javascript", "generated"), ("a/b.pyc", "generated_file", "unknown", "generated"),
    (".claude/x.md", "design_doc", "markdown", "tooling_agent"), ("logs/x.json", "config_file", "json", "artifact"), ("my-backup/x.md", "design_doc", "markdown", "backup"), ("old/archived-2/x.md", "design_doc", "markdown", "archive"),
    ("fixback/x.md", "design_doc", "markdown", "repair_worktree"), (".spanindex/x", "unknown", "unknown", "derived_state"), ("a.TS", "source_file", "unknown", "business"),
])
def test_classification(spark, path, role, language, layer):
    p = F.lit(path)
    row = spark.range(1).select(classify.role(p).alias("role"), classify.language(p).alias("language"), classify.layer(p).alias("layer")).first()
    assert (row.role, row.language, row.layer) == (role, language, layer)


def test_paths(spark):
    for path, bad in ((".env", True), ("a/.env.local", True), ("a/id_rsa.pub", True), ("x.pem", True), ("environment.py", False), ("conf/secrets.yaml", True)):
        assert one(spark, classify.sensitive(F.lit(path))) is bad
    for path, glob, hit in (("a/b/c.json", "*.json", True), ("vendor/x/y", "vendor/**", True), ("a/vendor/x", "vendor/**", False), ("a/b.c", "a/?.c", True), ("node_modules/x", "node_modules", True)):
        assert one(spark, classify.ignored(F.lit(path), [glob])) is hit
    assert one(spark, links.resolved(F.lit("docs/api/x.md"), F.lit("../img/./a.png"))) == "docs/img/a.png"


def test_texts(spark):
    text, kinds = classify.redacted(F.lit("api_key = 'abcdefghijklmnop1234' mail a@b.org ip 10.0.0.1"))
    assert one(spark, text) == "[REDACTED:api_key] mail [REDACTED:email] ip 10.0.0.1" and one(spark, kinds) == ["api_key", "email"]
    assert one(spark, classify.slug(F.lit(" Héllo `World`, <b>x</b> -- 1 "))) == "héllo-world-x-1"
    for n in range(1, 12):
        raw = "aé日🎉z"
        assert one(spark, classify.cut_bytes(F.lit(raw), n)) == raw.encode()[:n].decode("utf-8", "ignore")
    assert one(spark, classify.dice(F.lit("a b c"), F.lit("B c d"))) == pytest.approx(2 / 3) and one(spark, classify.dice(F.lit(""), F.lit(""))) == 0


def test_scores(spark):
    ranked = lambda *a: F.array(*[F.struct(F.lit(r).alias("rank"), F.lit(w).alias("weight")) for w, r in a])
    assert one(spark, scoring.weighted_rrf(ranked((8, 1), (4, 2), (2, 4)))) == 23 and one(spark, scoring.weighted_rrf(ranked((100, 1)))) == 24
    decide = lambda s, **k: one(spark, scoring.decision(F.lit(s), **{a: F.lit(b) for a, b in k.items()}))
    assert [decide(s) for s in (85, 84, 70, 69)] == ["must_edit", "maybe_edit", "maybe_edit", "inspect_only"]
    assert decide(200, stale=True) == decide(200, risk="high") == decide(200, indexed=False) == "inspect_only"
    assert decide(200, is_test=True) == "verify_only" and decide(69, old_term=True) == "maybe_edit" and decide(70, old_term=True) == "must_edit"
    assert [one(spark, scoring.confidence(F.lit(s))) for s in (-5, 0, 20)] == [0, 0, 0.5]
    assert one(spark, ranking.path_strength(F.lit("src/scheduler.ts"), {"raw": "", "path": ["src/scheduler.ts"]})) == 42
    assert one(spark, ranking.path_strength(F.lit("src/scheduler.ts"), {"raw": "change the scheduler now", "path": ["nothing.ts"]})) == 36


def test_budget_goes_on_after_what_does_not_fit(spark):
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(c).cast("long").alias("cost")) for n, c in (("a", 50), ("b", 60), ("c", 40))])
    assert [r.name for r in one(spark, spans.greedy_budget(rows, F.lit(100)))] == ["a", "c"]
    assert [r.name for r in one(spark, spans.greedy_budget(rows, F.lit(10)))] == ["a"]


def test_spans(spark):
    rows = spark.createDataFrame([("p", 1, 1), ("p", 4, 2), ("p", 6, 3), ("p", 9, 2), ("p", 12, 1)], "path string, line long, depth int")
    assert [(r.start_line, r.end_line) for r in spans.nested_sections(rows, "path", "line", "depth").orderBy("start_line").collect()] == [(1, 11), (4, 8), (6, 8), (9, 11), (12, None)]
    names = spans.overload_names(spark.createDataFrame([("foo", i) for i in range(3)], "name string, at int"), "name", "at")
    assert [r.full_name for r in names.orderBy("at").collect()] == ["foo", "foo#overload2", "foo#overload3"]
    slugs = spans.duplicate_slugs(spark.createDataFrame([("p", "a", i) for i in range(3)], "path string, base string, at int"), "path", "base", "at")
    assert [r.anchor for r in slugs.orderBy("at").collect()] == ["a", "a-1", "a-2"]


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b", "calls", 0.9), ("b", "c", "calls", 0.8), ("c", "d", "tests", 0.7), ("x", "a", "contains", 1.0)], "source_id string, target_id string, relation string, confidence double")
    seed = spark.createDataFrame([("a",)], "node string")
    hops = lambda **k: {r.node: r.hops for r in graph.trace(edges, seed, **k).collect()}
    assert hops(depth=2, direction="out") == {"a": 0, "b": 1, "c": 2} and hops(depth=5) == {"a": 0, "b": 1, "x": 1, "c": 2, "d": 3}
    assert hops(depth=3, direction="out", relations=["calls"]) == {"a": 0, "b": 1, "c": 2} and hops(depth=0) == {"a": 0}
    assert hops(depth=1, most_edges=1) == {"a": 0, "x": 1} and len(hops(depth=5, most_nodes=2)) == 2


def test_checks(spark):
    rows = spark.createDataFrame([("p", "timeout here"), ("q", "Timeout")], "path string, line string")
    assert [r.path for r in verify.old_term_sweep(rows, ["timeout"]).collect()] == ["p"]
    assert [one(spark, verify.status(F.lit(h), F.lit(s))) for h, s in ((1, 0), (0, 1), (0, 0))] == ["fail", "needs_attention", "pass"]
    severity = lambda policy: [one(spark, verify.doc_severity(F.lit(c), policy)) for c in (True, False)]
    assert severity("strict_global") == ["fail", "fail"] and severity("changed_paths") == ["fail", None] and severity("changed_paths_plus_advisory_docs") == ["fail", "needs_attention"]


def test_snapshots(spark):
    frame = lambda *rows: spark.createDataFrame(rows, "path string, hash string")
    change = {r.path: r.change for r in state.changed_files(frame(("a", "1"), ("b", "1"), ("c", "1")), frame(("a", "1"), ("b", "2"), ("d", "1"))).collect()}
    assert change == {"b": "modified", "c": "deleted", "d": "added"}
    merged = state.merged(frame(("a", "1"), ("b", "1"), ("c", "1")), frame(("b", "2")), frame(("c", "")), "path")
    assert {(r.path, r.hash) for r in merged.collect()} == {("a", "1"), ("b", "2")}


def test_request(spark):
    found = normalize(spark, "Rename fooBar to bazQuux in src/scheduler.ts with --dry-run and MAX_SIZE")
    assert found["old"] == ["fooBar"] and found["new"] == ["bazQuux"] and "src/scheduler.ts" in found["path"] and {"--dry-run", "MAX_SIZE"} <= set(found["config"]) and {"fooBar", "bazQuux"} <= set(found["symbol"])


def test_repository_source(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\n")
    (tmp_path / "README.md").write_text("# Hi\n")
    rows = {r.path: (r.size, r.text) for r in tables.repository(spark, str(tmp_path)).collect()}
    assert rows == {"src/a.py": (6, "x = 1\n"), "README.md": (5, "# Hi\n")}


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        stream_query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        stream_query.awaitTermination(120)
        return spark.table(name)

    counts = run(lifecycle.windowed_counts(stream), "counts", "complete")
    assert sorted(map(tuple, counts.select("event_type", "n").collect())) == sorted(map(tuple, lifecycle.windowed_counts(events).select("event_type", "n").collect()))
    anchors = run(lifecycle.anchor_stream(stream), "anchors", "update")
    seen = anchors.groupBy("user_id").agg(F.max("seen").alias("seen"))
    folded = state.anchor_lifecycle(events).select("user_id", "seen")
    assert sorted(map(tuple, seen.collect())) == sorted(map(tuple, folded.collect()))


def test_budget_collects_few_and_keeps_the_same(spark):
    rng = random.Random(5)
    ranked = {lang: [(n, rng.choice(costs)) for n in range(1, 401)] for lang, costs in (("a", (38, 46, 54, 70)), ("b", (130, 140)), ("c", (62, 38)))}
    rows = spark.createDataFrame([(lang, n, c) for lang, each in ranked.items() for n, c in each], "lang string, n long, cost long")
    few = {}
    for r in retrieval.budgeted(rows, 120, "n").orderBy("lang", "n").collect():
        few.setdefault(r.lang, []).append((r.n, r.cost))

    def greedy(each):
        used, kept = 0, []
        for n, c in each:
            if not kept or used + c <= 120:
                used, kept = used + c, [*kept, n]
        return kept

    assert {k: greedy(v) for k, v in few.items()} == {k: greedy(v) for k, v in ranked.items()}
    assert all(len(v) <= 12 for v in few.values())


def test_lifecycle_is_the_fold_without_holding_a_key(spark):
    rng, kinds = random.Random(6), [*state.ACTIONS, "other", None]
    events = [(None if k == 0 else k, rng.randrange(50), i, rng.choice(kinds if k % 3 else ["error", "view", "signup"])) for i, k in enumerate(rng.choices(range(150), k=1200))]
    got = state.anchor_lifecycle(spark.createDataFrame(events, "user_id long, ts long, event_id long, event_type string"))
    want = {}
    for key, _, _, kind in sorted(events, key=lambda e: e[1:3]):
        want[key] = state.fold_anchor(want.get(key, state.NEW_ANCHOR), state.ACTIONS.get(kind, "observe"))
    assert {r.user_id: {k: r[k] for k in state.NEW_ANCHOR} for r in got.collect()} == want
    assert {v["state"] for v in want.values()} == {"active", "dormant"}
    assert "Pandas" not in got._jdf.queryExecution().toString()


def test_relocation(spark):
    schema = "span_id string, path string, kind string, anchor string, heading string, ordinal int, nearby string, text_hash string, text string"
    row = lambda i, anchor=None, heading="h", ordinal=0, nearby="n", text="", kind="k", path="p": (i, path, kind, anchor, heading, ordinal, nearby, text, text)
    old = [
        row("text", text="same"), row("anchor", "a", ordinal=9, text="x"), row("twice", "b", ordinal=9, text="y"), row("place", heading="g", ordinal=3, text="z"),
        row("fuzzy", heading="f", ordinal=9, text="one two three four"), row("near", heading="e", ordinal=9, nearby="m", text="a1 a2 a3 a4"), row("tie", heading="d", ordinal=9, nearby="t", text="b1 b2"),
        row("low", heading="c", ordinal=9, nearby="l", text="c1 c2 c3 c4"), row("bare", heading=None, ordinal=None, nearby=None, text=None), row("other", path="q", ordinal=9, text="same")]
    new = [
        row("1", heading="-", text="same"), row("2", "a", "-", text="2"), row("3", "b", "-", text="3"), row("4", "b", "-", text="4"), row("5", heading="g", ordinal=3, text="5"),
        row("6", heading="f", ordinal=1, nearby="-", text="one two three five four"), row("7", heading="f", ordinal=2, nearby="-", text="one seven"),
        row("8", heading="-", nearby="m", text="A1 a2 x"), row("9", heading="-", nearby="m", text="a1, a2, a3"), row("10", heading="-", nearby="t", text="b1 x"), row("11", heading="-", nearby="t", text="b2 x"),
        row("12", heading="-", nearby="l", text="c1 y1 y2 y3"), row("13", heading=None, ordinal=None, nearby=None, text=None)]
    make = lambda rows: spark.createDataFrame(rows, schema)
    got = {r.span_id: (r.step, r.outcome, r.found_id) for r in relocate.relocated(make(old), make(new)).collect()}
    missing = (None, "not_found", None)
    assert got == {
        "text": ("text_hash", "relocated", "1"), "anchor": ("anchor_kind", "relocated", "2"), "twice": ("anchor_kind", "ambiguous", None), "place": ("heading_block_kind", "relocated", "5"),
        "fuzzy": ("heading_fuzzy_text", "relocated", "6"), "near": ("nearest_heading_similarity", "relocated", "9"), "tie": ("nearest_heading_similarity", "ambiguous", None),
        "low": missing, "bare": missing, "other": missing}
    assert relocate.relocated(make([]), make(new)).count() == 0 and relocate.relocated(make(old), make([])).where("outcome <> 'not_found'").count() == 0


def test_segments(spark):
    cut = lambda a, b, n: [tuple(x) for x in one(spark, spans.segments(F.lit(a), F.lit(b), n))]
    assert cut(1, 5, 2) == [(1, 2), (3, 4), (5, 5)] and cut(3, 3, 40) == [(3, 3)] and cut(4, 3, 40) == []
    assert tuple(one(spark, spans.nearest_segment(spans.segments(F.lit(1), F.lit(8), 4), F.lit(4.5)))) == (1, 4)
