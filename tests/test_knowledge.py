"""Anchors and their commands, features, maps of repositories, mentions, evidence and fallbacks over small frames."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spanworks.functions import requests
from spanworks.operators import anchors, features, locate


def test_reading_anchors(spark):
    given = [
        {"id": "x", "path": "./src//a.ts", "state": "dormant", "pinned": True, "score": 5, "headingPath": ["A", None, "B"], "source": "checkpoint", "startLine": 3}, {"path": "b.md", "state": "odd", "score": "high", "label": "", "source": "me"},
        {"path": "../out"}, {"path": "/abs"}, {"path": ""}, {"label": "none"}, {"path": "c\\d.md", "pinned": "yes", "usefulHitCount": 2}]
    rows = spark.createDataFrame([(json.dumps({"anchors": given}),), ("no json",), (None,), ('{"anchors": 5}',)], "text string")
    got = {r.path: r for r in anchors.read_anchors(rows, "text", seq=9).collect()}
    assert set(got) == {"src/a.ts", "b.md", "c/d.md"}
    a, b, c = got["src/a.ts"], got["b.md"], got["c/d.md"]
    assert (a.id, a.state, a.pinned, a.score, a.heading_path, a.source, a.start_line, a.kind) == ("x", "dormant", True, 5, ["A", "B"], "checkpoint", 3, "file")
    assert (b.state, b.score, b.label, b.source, b.last_seen, b.reason) == ("active", 0, "b.md", "automatic", 9, "navigation target") and b.id.startswith("anchor:")
    assert not c.pinned and c.useful == 2


def brute_commands(held, commands):
    held, warned = {p: dict(a) for p, a in held.items()}, []
    for seq, action, path, state, pinned in sorted(commands):
        if path.startswith("/"):
            warned.append((seq, path))
            continue
        if path not in held:
            if action != "promote":
                warned.append((seq, path))
                continue
            held[path] = {"state": "active", "pinned": False, "score": 0.0, "last_seen": None}
        a = held[path]
        if a["state"] == "tombstoned":
            continue
        a["last_seen"] = float(seq)
        if action == "promote":
            a |= {"state": "active", "pinned": a["pinned"] or bool(pinned), "score": max(a["score"], 100.0)}
        elif action == "retire":
            a["state"] = "tombstoned"
        else:
            a["state"] = state or "dormant"
    return {p: (a["state"], a["pinned"], a["score"], a["last_seen"]) for p, a in held.items()}, sorted(warned)


@pytest.mark.parametrize("seed", range(3))
def test_commands(spark, seed):
    rng = random.Random(seed)
    held = {p: {"state": rng.choice(["active", "dormant", "tombstoned"]), "pinned": False, "score": 120.0 if p == "a" else 1.0, "last_seen": 0.0} for p in "abc"}
    commands = [(i, rng.choice(["promote", "demote", "demote", "retire"] if rng.random() < 0.3 else ["promote", "demote"]), rng.choice(["a", "b", "c", "d", "e", "/abs"]), rng.choice([None, "archived"]), rng.choice([None, True, False])) for i in range(30)]
    table = spark.createDataFrame([(p, a["state"], a["pinned"], a["score"], 0.5, a["last_seen"]) for p, a in held.items()], "path string, state string, pinned boolean, score double, confidence double, last_seen double")
    after, warned = anchors.commanded(table, spark.createDataFrame(commands, "seq long, action string, path string, state string, pinned boolean"))
    want = brute_commands(held, commands)
    assert {r.path: (r.state, r.pinned, r.score, r.last_seen) for r in after.collect()} == want[0]
    assert sorted((r.seq, r.path) for r in warned.collect()) == want[1]


def test_status_and_validity(spark):
    rows = spark.createDataFrame([(f"p{i:02}", "active" if i % 3 else "dormant", float(i)) for i in range(20)], "path string, state string, rank_score double")
    got = {r.state: (r.n, r.shown, r.omitted) for r in anchors.status(rows, 2).collect()}
    assert got == {"active": (13, ["p19", "p17"], 11), "dormant": (7, ["p18", "p15"], 5)}
    paths = spark.createDataFrame([("a",), (".env",), ("gone",)], "path string")
    assert sorted(map(tuple, anchors.invalid(paths, spark.createDataFrame([("a",), (".env",)], "path string")).collect())) == [(".env", "sensitive path"), ("gone", "no such file")]


def test_features(spark):
    texts = ['[{"id": "f1"}, {"title": "Two"}, {}, null, {"id": "f3", "title": "Three", "source": "s"}]', "{}", None, "nope", "[]"]
    got = features.read_features(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()
    assert sorted(map(tuple, got)) == sorted([("f1", "f1", "feature-projection"), ("Two", "Two", "feature-projection"), ("feature.unknown", "Untitled feature", "feature-projection"), ("f3", "Three", "s")])
    nodes = spark.createDataFrame([("a", None, "name"), (None, "T", None), ("", "", ""), ("b", None, None)], "id string, title string, name string")
    edges = spark.createDataFrame([("a", None, None, "b", None, None), (None, "x", "y", None, "", "uses"), ("a", None, None, None, "r", None), ("", "", "b", "", None, None)], "source string, `from` string, target string, `to` string, relation string, kind string")
    got_nodes, got_edges = features.normalized_projection(nodes, edges)
    titles = {r.title: r.id for r in got_nodes.collect()}
    assert titles["name"] == "a" and titles["b"] == "b" and titles["T"].startswith("feature:") and "Untitled feature" in titles
    assert sorted(map(tuple, got_edges.collect())) == [("a", "b", "depends_on"), ("x", "y", "uses")]
    links = spark.createDataFrame([("a", "n1", "r", 0.9), ("n2", "a", "r", 0.6), ("a", "n3", "r", 0.5), ("n1", "a", "r", 0.7)], "source_id string, target_id string, relation string, confidence double")
    near = features.clusters(spark.createDataFrame([("a",), ("z",)], "id string"), links).collect()
    assert sorted((r.id, r.linked or "") for r in near) == [("a", "n1"), ("a", "n2"), ("z", "")]


def test_repository_map(spark, tmp_path):
    rows = [
        ("1", "README.md", "readme_doc", "doc.heading", "Hi", "hi", "text"), ("2", "src/a.ts", "source_file", "code.function", "go", "", ""), ("3", "tests/t.py", "test_file", "test.case", "t", "", ""), ("4", "conf/a.yaml", "config_file", "config.entry", "k", "", ""),
        ("5", "logs/x.json", "config_file", "config.entry", "log", "", ""), ("6", "src/b.ts", "source_file", "code.function", "b", "", "a Full Code Snippet here"), ("7", "notes/n.md", "experiment_note_doc", "doc.heading", "n", "", "")]
    spans = spark.createDataFrame(rows, "span_id string, path string, role string, kind string, label string, summary string, text string")
    edges = spark.createDataFrame([("1", "2", "documents", 0.97), ("1", "6", "documents", 0.97), ("2", "3", "tests", 0.4)], "source_id string, target_id string, relation string, confidence double")
    made = features.repository_map(spans, edges)
    got = {(r.section, r.path, r.label) for r in made.collect()}
    assert got == {("directories", ".", "readme_doc"), ("directories", "src", "source_file"), ("directories", "tests", "test_file"), ("directories", "conf", "config_file"), ("documents", "README.md", "Hi"), ("modules", "src/a.ts", "go"), ("tests", "tests/t.py", "t"), ("config", "conf/a.yaml", "k"), ("links", "1", "2")}
    features.write_map(made, str(tmp_path))
    features.write_map(made, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/map.json").count() == len(got) and "- `links` 1: 2 [documents 0.97]" in [r.value for r in spark.read.text(f"{tmp_path}/map.md").collect()]


def test_mentions(spark):
    text = "see `go()` and `a b`\nimport X from 'lib/x'\nconst y = require(\"y\")\nspan status --all\nspanner\n  key_1: v\nhttp://x\nread docs/a.md#top, ./b/c.py and src/d.rs `$(x).md` `e.ts#y`"
    row = spark.createDataFrame([("p", text), ("q", None)], "path string, text string")
    got = {(r.path, r.kind, r.value) for r in features.mentions(row, "text", "span").collect()}
    assert got == {("p", "inline_code", "go()"), ("p", "inline_code", "a b"), ("p", "inline_code", "$(x).md"), ("p", "inline_code", "e.ts#y"), ("p", "import", "lib/x"), ("p", "import", "y"), ("p", "cli", "span status --all"), ("p", "config_key", "key_1"), ("p", "config_key", "http")}
    tokens = row.select("path", features.path_tokens(F.col("text")).alias("t")).where("path = 'p'").first().t
    assert set(tokens) == {"go()", "e.ts", "docs/a.md", "./b/c.py"}
    code = spark.createDataFrame([("c1", "createClient"), ("c0", "createClient"), ("c2", "other"), ("c3", "")], "span_id string, label string")
    found = features.example_links(spark.createDataFrame([("e", "x = createClient(1); createClient(2)"), ("f", "none")], "span_id string, text string"), code).collect()
    assert [(r.source_id, r.target_id, r.confidence) for r in found] == [("e", "c0", 0.9)]
    kinds = spark.createDataFrame([(p,) for p in ("a.md", "dist/b.md", "c.json", "src/d.ts", "examples/e.txt", "notes/f.md", "g.bin")], "path string").select("path", features.read_as(F.col("path")).alias("k"), features.read_as(F.col("path"), True).alias("s"))
    assert {r.path: (r.k.document, r.k.artifact, r.k.code, r.s.document) for r in kinds.collect()} == {
        "a.md": (True, False, False, True), "dist/b.md": (False,) * 4, "c.json": (False, True, False, False), "src/d.ts": (False, False, True, False), "examples/e.txt": (False, False, True, False), "notes/f.md": (False, False, False, True), "g.bin": (False,) * 4}


def test_evidence_and_fallback(spark):
    from spanworks.sources import corpus

    files = [("docs/api/client.md", "# Client\ncall createClient with timeout --dry-run\nmore timeout"), ("docs/x.md", "nothing")]
    spans = corpus.spans_of(spark.createDataFrame(files, "path string, text string"))
    asked = requests.with_terms(spark.createDataFrame([(1, "createClient timeout --dry-run"), (2, "absent")], "q int, text string")).drop("text")
    edges = corpus.contains_edges(spans)
    got = {(r.q, r.span_id): r for r in locate.evidence_bundle(locate.candidates(spans, edges, asked, "q"), edges, "q").collect()}
    best = got[1, "docs/api/client.md:2"]
    assert best.evidence == ["direct_text_match:createclient", "direct_text_match:timeout", "direct_text_match:--dry-run"] and best.linked == ["docs/api/client.md:1"] and (best.risk, best.stale, best.warnings) == ("low", False, 0)
    assert got[1, "docs/api/client.md:1"].linked == ["docs/api/client.md:2", "docs/api/client.md:3"] and not any(k[0] == 2 for k in got)
    inventory = spark.createDataFrame([("src/client.ts", "source_file", "typescript"), ("docs/clients.md", "design_doc", "markdown"), ("x.py", "source_file", "python")], "path string, role string, language string")
    wanted = requests.with_terms(spark.createDataFrame([(1, "client typescript"), (2, "zzz")], "q int, text string"), roles=["design_doc"]).drop("text")
    assert sorted((r.q, r.path) for r in locate.from_inventory(wanted, inventory, "q").collect()) == [(1, "docs/clients.md"), (1, "src/client.ts"), (2, "docs/clients.md")]
