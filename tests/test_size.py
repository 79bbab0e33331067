"""What queries read and write for their result, and that it is whole."""

from pyspark.sql import functions as F

from spanworks.functions import classify
from spanworks.operators import dispatch, features, graph, index, links, locate
from spanworks.plans import workspace
from spanworks.queries import QUERIES
from spanworks.sources import corpus


def plan(rows):
    return rows._jdf.queryExecution().toString()


def recorded(monkeypatch, *modules):
    """The rows that modules stage from here on."""
    seen = []
    for module in modules:
        real = module.staged
        monkeypatch.setattr(module, "staged", lambda rows, *rest, real=real: seen.append(real(rows, *rest)) or seen[-1])
    return seen


def test_mentions_of_repeated_paths_come_once(spark, tmp_path):
    docs = [(1, "# quick start here\nsee", "en", "web", 1), (1, "# quick start\nsee", "en", "web", 1), (2, "the Quick start, HERE and there\nquick start", "en", "web", 1), (3, "a quick\nstart here", "en", "web", 1), (4, None, "en", "web", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r.source_id, r.target_id) for r in QUERIES["mention_links"](spark, str(tmp_path)).collect())
    assert got == [("web/en/2.md:1", "web/en/1.md:1"), ("web/en/2.md:2", "web/en/1.md:1")]


def test_phrases_of_frequent_words_write_little(spark, monkeypatch):
    words = [f"{a} {b} {c} {d} {e}" for a in "abc" for b in "abc" for c in "abc" for d in "abc" for e in "abc"]
    rows = spark.createDataFrame([(i, t.split()) for i, t in enumerate(words)], "id long, words array<string>")
    said = [("a b c a b", 1), ("a b c a b", 2), ("c c", 3), ("a b c a b c", 4), ("", 5), ("absent", 6)]
    seen = recorded(monkeypatch, index)
    asked = spark.createDataFrame(said, "said string, p long").select("p", index.tokens(F.col("said")).alias("said"))
    got = sorted((r.p, r.id) for r in index.phrase_rows(rows, ["id"], F.col("words"), asked, ["p"], F.col("said")).collect())
    assert got == sorted((p, i) for s, p in said if s for i, t in enumerate(words) if f" {s} " in f" {t} ")
    near = next(x for x in seen if x.columns == ["_no", "_at"])
    alone = sum(s == "a b c a b" for s, p in said) * sum("a" in t for t in words)  # what the places of one word would give for one phrase
    assert near.count() < alone / 4


def test_redaction_takes_each_step_once(spark):
    text, kinds = classify.redacted(F.col("t"))
    rows = spark.createDataFrame([("mail a.b@c.org, password: hunter22hunter",), ("token @ secret password",), (None,), ("AKIA" + "A1" * 8,)], "t string")
    made = rows.select(text.alias("text"), kinds.alias("kinds"), classify.any_redacted(F.col("t")).alias("any"))
    last = plan(made).split("== Physical Plan ==")[1]
    assert last.count("regexp_replace(") <= 2 * len(classify.REDACTIONS)
    assert [(r.text, r.kinds, r.any) for r in made.collect()] == [
        ("mail [REDACTED:email], [REDACTED:password]", ["password", "email"], True), ("token @ secret password", [], False), (None, [], None), ("[REDACTED:aws_access_key]", ["aws_access_key"], True)]


def test_redaction_guards_hold_wherever_a_pattern_fits(spark):
    held = {"api_key": "API-key = abcdefghijklmnop", "token": "Bearer: " + "x" * 32, "secret": "'SECRET'='abcdefghijklmnop'", "password": "PWD=12345678", "aws_access_key": "xAKIA" + "B" * 16,
            "private_key": "-----BEGIN PRIVATE KEY-----\nx\n-----END PRIVATE KEY-----", "jwt": "eyJa.eyJb.c", "email": "a@b.co"}
    rows = spark.createDataFrame(list(held.items()), "kind string, t string")
    for kind, pattern in classify.REDACTIONS:
        found = rows.where(F.col("t").rlike(pattern)).select("kind", classify.may_hold(F.col("t"), kind).alias("may")).collect()
        assert kind in [r.kind for r in found] and all(r.may for r in found)


def test_stale_anchors_take_apart_only_named_files(spark, sf, monkeypatch):
    seen = recorded(monkeypatch, workspace)
    QUERIES["stale_anchors"](spark, sf).count()
    named = {r.path for r in corpus.files(spark, sf).collect() if r.path.startswith("web/")}
    lines = next(x for x in seen if "line_no" in x.columns or "span_id" in x.columns)
    fragments = spark.read.parquet(f"{sf}/pages.parquet").where("url like '%#_%'").count()
    assert {r.path for r in lines.select("path").distinct().collect()} <= named and lines.select("path").distinct().count() <= fragments


def test_impact_neither_writes_nor_groups_all_edges(spark, sf, monkeypatch):
    seen = recorded(monkeypatch, workspace)
    assert QUERIES["impact_paths"](spark, sf).count() == 50 and not any("source_id" in x.columns for x in seen)
    edges = spark.createDataFrame([("a", "b", "r", 0.5), ("a", "b", "r", 0.5), ("b", "a", "s", 0.7), ("b", "c", "r", 1.0), ("b", None, "r", 1.0)], "source_id string, target_id string, relation string, confidence double")
    got = {r.node: (r.hops, r.path, r.strength) for r in graph.impact_paths(edges, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {"a": (0, ["a"], 1.0), "b": (1, ["a", "b"], 0.7), "c": (2, ["a", "b", "c"], 0.7)}


def test_parsers_read_their_own_files_only(spark):
    files = spark.createDataFrame([("a.md", "# t"), ("b.json", '{"k": 1}'), ("tests/test_c.PY", "def test_x():\n  pass"), ("d.bin", None)], "path string, text string")
    made = dispatch.dispatched(files)
    assert "PartitionFilters: [isnotnull(_language" in plan(made)
    got = {(r.path, r.kind) for r in made.collect()}
    assert {("a.md", "doc.heading"), ("b.json", "config.entry"), ("tests/test_c.PY", "code.module"), ("d.bin", "file")} <= got and len([k for p, k in got if k == "file"]) == 4


def test_layers_of_a_map_are_told_by_file(spark):
    spans = [("a.md:1", "a.md", "design_doc", "doc.heading", "A", "A"), ("a.md:2", "a.md", "design_doc", "doc.paragraph", "x", "x"), ("dist/b.md:1", "dist/b.md", "design_doc", "doc.heading", "B", "B"), ("c:1", None, "design_doc", "doc.heading", "C", "C")]
    rows = spark.createDataFrame(spans, "span_id string, path string, role string, kind string, label string, text string").withColumn("summary", F.col("text"))
    edges = spark.createDataFrame([("a.md:1", "a.md:2", "contains", 1.0), ("a.md:1", "dist/b.md:1", "contains", 1.0)], "source_id string, target_id string, relation string, confidence double")
    made = features.repository_map(rows, edges)
    assert "resources/code" not in plan(made)
    got = sorted((r.section, r.path or "", r.label, r.n) for r in made.collect())
    assert [g for g in got if g[0] != "directories"] == [("documents", "", "C", 1), ("documents", "a.md", "A", 1), ("documents", "a.md", "x", 1), ("links", "a.md:1", "a.md:2", 1)]


def test_parts_of_words_are_looked_up_no_further_than_their_first_places(spark, monkeypatch):
    n, most = 2000, 5
    paths = [f"p{i // 2 * 7919 % n:05d}" for i in range(n)]  # each path twice, and spans of every second pair of them alike
    made = [(f"{p}:{i % 4 // 2 + 1}", p, i % 4 // 2 + 1, f"the W{i} {'late' if p > 'p01900' else ''} {'seldom' if p == 'p00004' else ''}") for i, p in enumerate(paths)]
    rows = spark.createDataFrame(made, "span_id string, path string, start_line long, text string").withColumn("at", F.substring("path", 2, 5).cast("long"))
    rows = rows.withColumns({c: F.lit("") for c in ("label", "role", "kind", "summary", "metadata", "symbol_path", "heading")})
    terms = ["th", "w", "w19", "seldom", "late", "ate", "absent", "the w1"]
    wanted = spark.createDataFrame([(1, "word", i, t) for i, t in enumerate(terms)], "q long, field string, ordinal int, term string")
    monkeypatch.setattr(index, "SHARES", (16, 4), raising=False)
    monkeypatch.setattr(index, "SHARE_ROWS", 10, raising=False)
    for most_sent in (1_000_000, 1):
        monkeypatch.setattr(index, "MOST_SENT", most_sent, raising=False)
        seen = recorded(monkeypatch, index)
        got = locate.routes(rows, wanted, "q", locate.Limits(words=most)).where("step = 4 and part = 1").collect()
        expected = set()
        for i, t in enumerate(terms):
            spots = sorted({(p, line, s) for s, p, line, text in made if t in text.lower() or t in p})[:most]
            expected |= {(i, s, rank + 1) for rank, (_, _, s) in enumerate(spots)}
        assert {(r.ordinal, r.span_id, r["rank"]) for r in got} == expected and len(got) == len(expected)
        # Each text has a run of its own with a "w"; pairs of it and what holds it are written for the first ones alone.
        pairs = [x for x in seen if "run" in x.columns and {"low", "part"} & set(x.columns)]
        assert pairs and all(x.where("run like 'w%'").count() < n / 2 for x in pairs)


def test_pairs_of_a_frequent_word_are_made_in_many_tasks(spark, tmp_path, monkeypatch):
    docs = [(i, f"Word {'rare' if i % 2 else 'Seldom'} Word{i % 3}" if i % 50 else "Seldom Word", "en", "web", 1) for i in range(450)]
    spark.createDataFrame([*docs, docs[7], docs[10]], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(links, "SOURCES", 20, raising=False)
    monkeypatch.setattr(links, "TARGETS", 10, raising=False)
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.skewJoin.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in held}
    label = {i: t.split()[0] for i, t, *_ in docs if i % 9 in (0, 5)}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        for name, kinds in (("inline_code_links", (1, 6)), ("test_call_links", (7,))):
            made = QUERIES[name](spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
            expected = sorted((f"span:{i}", f"span:{j}") for i, t, *_ in docs if i % 9 in kinds for j, said in label.items() if said in t.split())
            assert sorted((r.source_id, r.target_id) for r in made) == expected
            assert len({r.task for r in made if label[int(r.target_id[5:])] == "Word"}) > 2
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_only_runs_that_a_phrase_has_are_shuffled(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [f"a{i % 7}", f"b{i % 11}", f"c{i}", f"d{i % 13}", f"e{i}", "f"]) for i in range(500)], "id long, words array<string>")
    said = [(1, ["a1", "b1", "c1", "d1"]), (2, ["b2", "c2", "d2", "e2", "f"]), (3, ["f"]), (4, ["a0", "b0"]), (5, ["absent"])]
    asked = spark.createDataFrame(said, "p long, said array<string>")
    text = lambda words: f" {' '.join(words)} "
    expected = sorted((p, r.id) for r in rows.collect() for p, s in said if text(s) in text(r.words))
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        for most, words in ((1_000_000, 1 << 20), (1, 1 << 20), (1, 2)):  # keys by themselves, by bits, and by bits that are mostly set
            monkeypatch.setattr(index, "MOST_SENT", most, raising=False)
            monkeypatch.setattr(index, "WORDS_SENT", words, raising=False)
            plans, real = [], index.staged
            monkeypatch.setattr(index, "staged", lambda rows, *rest, real=real: plans.append(plan(rows)) or real(rows, *rest))
            found = index.phrase_rows(rows, ["id"], F.col("words"), asked, ["p"], F.col("said"))
            assert sorted((r.p, r.id) for r in found.collect()) == expected
            monkeypatch.setattr(index, "staged", real)
            runs = next(p for p in plans if "Generate explode" in p and "_at" in p and "Join" in p and "xxhash64(slice" in p).split("== Physical Plan ==")[1]
            assert "BroadcastHashJoin" in runs and "Exchange" not in runs[(at := runs.index("BroadcastHashJoin")) : runs.index("Generate", at)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
