"""Dispatching files by format, what a refresh reads, and listing without pruned folders."""

import json

from pyspark.sql import functions as F

from spanworks.operators import dispatch, scope
from spanworks.sources import listing


def test_every_format_and_what_fails(spark):
    files = {
        "a.md": "# A\n\ntext\n\n## B\n- x\n", "b.mdx": "import X from 'x'\n\n# T\n\n<Note>hi</Note>\n", "plain.mdx": "# Only\n", "c.rst": "Title\n=====\n\nbody\n", "d.ts": "export function go() {\n  run()\n}\n", "broken.ts": "export function go() {\n  run()\n",
        "tests/test_d.py": "def test_go():\n    go()\n", "e.json": '{"a": {"b": [1, "x"]}}', "bad.json": "{nope", "empty.json": "", "f.yaml": "a:\n  b: 1\n", "bad.yaml": "- just\n- items\n", "g.toml": "[t]\nk = 1\n", "bad.toml": "nothing here",
        "package.json": '{"scripts": {"go": "x"}, "main": "m.js"}', "h.bin": "\x00\x01", "none.md": None, "big.md": "# H\n" + "x" * 3000}
    rows = dispatch.dispatched(spark.createDataFrame(list(files.items()), "path string, text string"), most_bytes=2000).collect()
    of = lambda path, kind=None: [r for r in rows if r.path == path and kind in (None, r.kind)]
    assert all(len(of(p, "file")) == 1 for p in files)
    assert {r.kind for r in of("a.md")} == {"file", "doc.heading", "doc.section", "doc.paragraph", "doc.list"} and [r.detail for r in sorted(of("a.md", "doc.section"), key=lambda r: r.start_line)] == ["A", "A/B"]
    assert [(r.start_line, r.end_line) for r in of("b.mdx", "parse.warning")] == [(1, 5)] and of("b.mdx", "doc.heading")[0].label == "T" and not of("plain.mdx", "parse.warning")
    assert of("c.rst", "doc.heading") and of("d.ts", "code.function")[0].end_line == 3 and of("d.ts", "code.callsite")[0].label == "run" and of("broken.ts", "code.function")[0].error == "no end found"
    assert of("tests/test_d.py", "test.case")[0].label == "test_go" and {r.detail for r in of("e.json", "config.entry")} >= {"/a", "/a/b"}
    assert all(of(p, "parse.error") for p in ("bad.json", "empty.json", "bad.yaml", "bad.toml")) and not any(of(p, "parse.error") for p in ("e.json", "f.yaml", "g.toml", "none.md"))
    assert of("f.yaml", "config.entry")[-1].detail is not None and {r.label for r in of("g.toml", "config.entry")} == {"t.k"} and {r.kind for r in of("package.json")} >= {"package.script", "package.entrypoint"}
    assert [r.kind for r in of("h.bin")] == ["file"] and [r.kind for r in of("none.md")] == ["file"] and [(r.kind, r.error) for r in of("big.md")] == [("file", "oversized")]


def test_bounded_text(spark):
    rows = spark.createDataFrame([(1, "é" * 10), (2, "ab"), (3, None), (4, "\n".join(f"l{i}" for i in range(20)))], "id int, text string")
    got = {r.id: r for r in dispatch.bounded_text(rows, 7).collect()}
    assert got[1].text == "ééé" and got[1].truncated and got[2].text == "ab" and not got[2].truncated and got[2].prints is None and got[3].text is None and got[4].line_count == 20 and got[4].prints.head


def inventory(spark):
    return spark.createDataFrame([("src/a.ts", False), ("src/sub/b.ts", False), ("docs/c.md", True), ("runs/x.csv", False), ("lib/d.py", False)], "path string, oversized boolean")


def chosen(rows):
    got = rows.collect()
    return {r.path for r in got if r.deep}, {r.path: r.warning for r in got if r.warning}


def test_deep_files_by_target(spark):
    rows = inventory(spark)
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    hot = spark.createDataFrame([("runs/x.csv", False), ("docs/c.md", True)], "path string, pinned boolean")
    assert chosen(scope.deep_files(rows, "files")) == (set(), {})
    assert chosen(scope.deep_files(rows, "all"))[0] == {"src/a.ts", "src/sub/b.ts", "runs/x.csv", "lib/d.py"}
    deep, warned = chosen(scope.deep_files(rows, "hotset", hotset=hot))
    assert deep == set() and set(warned) == {"runs/x.csv", "docs/c.md"} and "cold" in warned["runs/x.csv"]
    deep, warned = chosen(scope.deep_files(rows, "paths", paths("src/", "runs/x.csv", "nope"), hot))
    assert deep == {"src/a.ts", "src/sub/b.ts", "runs/x.csv"} and "not in the inventory" in warned["nope"]
    assert chosen(scope.deep_files(rows, "changed", changed=paths("lib/d.py", "docs/c.md", "gone"), previous="full")) == ({"lib/d.py"}, {"docs/c.md": "oversized changed file kept as a file only"})
    assert chosen(scope.deep_files(rows, "changed", hotset=hot, changed=paths("lib/d.py"), previous="scoped"))[0] == set()
    assert scope.coverage(scope.deep_files(rows, "all")).first().deep == "scoped" and scope.coverage(scope.deep_files(rows, "files")).first().deep == "none"


def test_changed_folders(spark):
    files = spark.createDataFrame([(p,) for p in ("a/x.md", "a/y.py", "a/b/z.md", "a/bin.exe", "node_modules/q.md", "c.md")], "path string")
    got = scope.expanded(spark.createDataFrame([("a",), ("c.md",), ("node_modules",), ("gone",)], "path string"), files)
    assert sorted(map(tuple, got.collect())) == [("a/x.md", 0), ("a/y.py", 0), ("c.md", 0)]
    assert sorted(map(tuple, scope.expanded(spark.createDataFrame([("a",)], "path string"), files, most=1).collect())) == [("a/x.md", 1)]


def test_pruned_folders_are_not_opened(spark, tmp_path):
    for name in ("src/a.py", "src/deep/er/b.py", "node_modules/x/y.js", ".git/config", "docs/c.md", "docs/skip/d.md", ".ssh/id", "top.md", ".env"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x\n")
    (tmp_path / "link").symlink_to(tmp_path / "docs")
    opened = []
    real = listing.Files

    class Counted(real):
        def __init__(self, *a):
            super().__init__(*a)
            fs = self.fs
            self.fs = type("Fs", (), {"listStatus": lambda _, p: (opened.append(p.toUri().getPath().removeprefix(str(tmp_path)).strip("/")), fs.listStatus(p))[1]})()

    listing.Files = Counted
    try:
        kept, left = listing.kept_folders(spark, str(tmp_path), globs=["skip"])
    finally:
        listing.Files = real
    assert sorted(opened) == kept and {"", "docs", "src", "src/deep", "src/deep/er"} <= set(kept) and {".git", ".ssh", "docs/skip", "node_modules"} <= set(left)
    assert listing.kept_folders(spark, str(tmp_path), most_depth=2)[0] == [f for f in kept if f.count("/") == 0]
    got = {r.path: r.size for r in listing.listed(spark, str(tmp_path), globs=["skip"]).collect()}
    assert {"src/a.py", "src/deep/er/b.py", "docs/c.md", "top.md"} <= set(got) and not {".env", "docs/skip/d.md", "node_modules/x/y.js"} & set(got)


def test_inventory_of_a_json_snapshot(spark, tmp_path):
    (tmp_path / "inventory.json").write_text(json.dumps({"files": [{"path": "./src/a.ts", "contentHash": "h"}, {"path": "../out"}, {"contentHash": "x"}, {"path": "docs\\b.md"}]}))
    got = listing.snapshot_files(spark, f"{tmp_path}/inventory.json").orderBy("path").collect()
    assert [(r.path, r.hash, r.language) for r in got] == [("docs/b.md", "", "markdown"), ("src/a.ts", "h", "typescript")]
    merged = scope.snapshot_inventory(*(spark.createDataFrame(rows, "path string, hash string") for rows in ([("a", "1"), ("b", "1")], [("b", "2"), ("c", "1")], [("a", "")])))
    assert sorted(map(tuple, merged.collect())) == [("b", "2"), ("c", "1")] and merged.where(F.col("path") == "a").count() == 0
