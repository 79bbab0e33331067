"""The way of a request from its terms to targets, over small spans made for it."""

import pytest
from pyspark.sql import functions as F

from spanworks.functions import requests
from spanworks.operators import index, locate, verify
from spanworks.plans import ranking as plan
from spanworks.sources import corpus

FILES = [
    ("docs/api/client.md", "# Client API\nThe createClient call takes a `timeout` option.\n\n## Options\n- timeoutMs: how long\n| name | text |\nsee [guide](guide.md#x)\n@deprecated use timeoutMs"),
    ("docs/guide.md", "# Guide\nSet api_key = abc and read about the Client API here.\nNothing else."),
    ("src/client.ts", "export function createClient"), ("dist/app.js", "createClient timeout"), ("empty.md", ""), ("blank.md", " \n\t\n"), ("none.md", None),
]


@pytest.fixture(scope="module")
def spans(spark):
    rows = corpus.spans_of(spark.createDataFrame(FILES, "path string, text string").withColumn("text", F.coalesce("text", F.lit(""))))
    code = F.col("path") == "src/client.ts"
    return rows.withColumns({"kind": F.when(code, "code.function").otherwise(F.col("kind")), "label": F.when(code, "createClient").otherwise(F.col("label"))}).cache()


def test_spans_of_lines(spans):
    rows = {r.span_id: r for r in spans.collect()}
    assert rows["docs/api/client.md:1"].kind == "doc.heading" and rows["docs/api/client.md:1"].label == "Client API" and rows["docs/api/client.md:1"].role == "canonical_api_doc"
    assert rows["docs/api/client.md:2"].heading == "Client API" and rows["docs/api/client.md:2"].symbol_path == "timeout" and rows["docs/api/client.md:5"].kind == "doc.list_item"
    assert rows["docs/api/client.md:6"].kind == "doc.table_row" and rows["docs/api/client.md:7"].metadata == "guide.md#x" and rows["docs/api/client.md:7"].heading_id == "docs/api/client.md:4"
    assert rows["docs/api/client.md:8"].deprecated and rows["docs/guide.md:2"].redacted and not any(p in {r.path for r in rows.values()} for p in ("empty.md", "blank.md", "none.md"))


def test_phrases(spark):
    rows = spark.createDataFrame([(1, "The red fish, the RED fish-tank"), (2, "fish red the"), (3, None), (4, "red the red red fish")], "id int, text string")
    wanted = spark.createDataFrame([("a", "red fish"), ("b", "the"), ("c", "fish tank"), ("d", "no such"), ("e", ""), ("f", "red red")], "p string, text string")
    found = index.phrase_hits(index.postings(rows, "id", ["text"]), "id", wanted.select("p", index.tokens(F.col("text")).alias("w")), "p", F.col("w"))
    assert sorted((r.p, r.id, r.base) for r in found.collect()) == [("a", 1, 1), ("a", 1, 4), ("a", 4, 3), ("b", 1, 0), ("b", 1, 3), ("b", 2, 2), ("b", 4, 1), ("c", 1, 5), ("f", 4, 2)]


def test_parts_of_words(spark):
    words = ["scheduler", "reschedule", "a.b/c", "é", "xyx", "sc"]
    terms = ["sched", "s", "é", "b/", "yx", "zz", "scheduler"]
    vocabulary = spark.createDataFrame([(w,) for w in words], "w string")
    found = index.containing(spark.createDataFrame([(t,) for t in terms], "t string"), "t", vocabulary, "w").collect()
    assert sorted((r.t, r.w) for r in found) == sorted((t, w) for t in terms for w in words if t in w)


def test_like_hits(spark):
    rows = [(1, "src/Client.ts", "a TimeOut option"), (2, "x", "the timeout option"), (3, None, "option"), (4, "tim", None)]
    terms = ["timeout", "out op", "client.ts", "é", "timeout option", "tim"]
    found = index.like_hits(spark.createDataFrame(rows, "id int, path string, text string"), "id", ["path", "text"], spark.createDataFrame([(t,) for t in terms], "t string"), "t")
    assert sorted((r.t, r.id) for r in found.collect()) == sorted((t, i) for t in terms for i, *cells in rows if any(t in (c or "").lower() for c in cells))


def test_boundaries(spark):
    flags = [dict(stale=True), dict(generated=True), dict(bare=True, stale=True), dict(outside=True), {}, dict(vendor=True, stale=True)]
    names = [name for _, name, _ in locate.WARNINGS]
    rows = spark.createDataFrame([(i, *[f.get(n, False) for n in names]) for i, f in enumerate(flags)], ["i", *names]).select("i", locate.boundary({n: F.col(n) for n in names}).alias("b")).orderBy("i").collect()
    assert [(r.b.ok, r.b.stale, r.b.risk, len(r.b.warnings)) for r in rows] == [(True, True, "medium", 1), (False, False, "high", 1), (False, True, "medium", 2), (False, False, "high", 1), (True, False, "low", 0), (False, True, "high", 2)]


def test_from_requests_to_targets(spark, spans):
    asked = spark.createDataFrame([(1, "Update docs/api/client.md for createClient timeout"), (2, "rename timeout to timeoutMs"), (3, "zzzz"), (4, None)], "q int, text string")
    asked = requests.with_terms(asked, roles=["docs"]).drop("text")
    rows = locate.candidates(spans, corpus.contains_edges(spans), asked, "q")
    found = {(r.q, r.span_id): r for r in rows.collect()}
    assert found[1, "src/client.ts:1"].routes[0] == "code_symbol_name_signature" and "fts_lexical" in found[1, "src/client.ts:1"].routes
    assert found[1, "docs/api/client.md:2"].routes[0] == "path_role_expansion" and found[1, "docs/api/client.md:2"].linked == 1
    assert "cross_reference_edge" in found[2, "docs/api/client.md:1"].routes and "old_term_sweep" in found[2, "docs/api/client.md:2"].routes
    assert found[1, "dist/app.js:1"].risk == "high" and found[1, "dist/app.js:1"].boundary.warnings == ["generated file not explicitly requested"]
    best = locate.targets(locate.ranked(rows, "q"), "q").collect()
    first = {r.q: r for r in best if r["rank"] == 1}
    assert first[1].path == "docs/api/client.md" and first[1].decision == "must_edit" and not any(r.path.startswith("dist/") for r in best)
    assert len({r.path for r in best if r.q == 2}) == sum(r.q == 2 for r in best), "one span a path where none is named"
    plan = {r.q: r for r in locate.coverage_plan(locate.targets(locate.ranked(rows, "q"), "q"), asked, "q", most=1).collect()}
    assert plan[2].sweeps == ["timeout", "timeoutMs"] and plan[1].docs == ["docs/api/client.md"] and plan[1].docs_omitted >= 1 and "canonical_api_doc" in plan[1].roles and "paper_doc" in plan[1].missing
    assert plan[4].sweeps == [], "a request without terms still has its roles"


def test_caps_and_changed_files(spark, spans):
    asked = requests.with_terms(spark.createDataFrame([(1, "timeout option")], "q int, text string")).drop("text")
    few = locate.Limits(words=1, spans=2)
    kept = locate.candidates(spans, corpus.contains_edges(spans), asked, "q", few).collect()
    assert len(kept) == 2
    now = spark.createDataFrame([("docs/api/client.md", 3, True)], "path string, lines int, changed boolean")
    rows = {r.span_id: r for r in locate.candidates(spans, corpus.contains_edges(spans), asked, "q", current=now).collect()}
    assert rows["docs/api/client.md:2"].risk == "medium" and rows["docs/api/client.md:2"].stale and rows["docs/api/client.md:5"].risk == "high"


def test_the_request_of_the_plans(spark):
    assert requests.normalize(spark, plan.REQUEST_TEXT, plan.REQUEST_ROLES) == plan.REQUEST


def test_passages_beside_brute_force(spark):
    texts = {10: "zero one two three four five six", 11: "two  three", 12: "one", 13: None, 14: "xone twox", 15: ""}
    items = {1: "one", 2: "one two", 3: "two three four fi", 4: "absent here", 5: "o", 6: " ", 7: "", 8: None, 9: "o three four f"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = index.passages(docs, "doc_id", "text", spark.createDataFrame(list(items.items()), "item_id long, p string"), "item_id", "p").collect()
    assert sorted(map(tuple, found)) == sorted((i, d) for i, p in items.items() for d, t in texts.items() if p and p.strip() and t and p in t)


def test_parts_by_long_grams_and_without_broadcasts_of_names(spark):
    words = ["alpha_beta_gamma", "beta_gam", "gamma_alpha_beta_x", "zzz", "alpha_bet"]
    terms = ["alpha_beta", "beta_gam", "gamma_alpha", "not_there_at_all"]
    frame = lambda values, name: spark.createDataFrame([(v,) for v in values], f"{name} string")
    got = {(r.t, r.w) for r in index.containing(frame(terms, "t"), "t", frame(words, "w"), "w", 8).collect()}
    assert got == {(t, w) for t in terms for w in words if t in w}
    found = verify.likely_tests(frame(["src/alpha_beta_gamma.ts"], "path"), frame(["tests/test_x_alpha_beta_gamma_y.py", "tests/test_alpha.py"], "path"))
    assert [tuple(r) for r in found.collect()] == [("src/alpha_beta_gamma.ts", "tests/test_x_alpha_beta_gamma_y.py")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("strategy=merge") == 4


def test_words_of_rows_without_places(spark):
    rows = spark.createDataFrame([(1, "The end, the END", None), (2, "ending", "the"), (3, None, None)], "id int, a string, b string")
    words = spark.createDataFrame([("the",), ("end.",), ("none",)], "w string")
    got = index.word_hits(rows, "id", ["a", "b"], words, "w", index.tokens(F.col("w"))[0])
    assert sorted(tuple(r) for r in got.collect()) == [("end.", 1), ("the", 1), ("the", 2)]
    again = index.like_hits(rows, "id", ["a", "b"], words.where("w = 'the'"), "w", once=False)
    assert {tuple(r) for r in again.collect()} == {("the", 1), ("the", 2)}
