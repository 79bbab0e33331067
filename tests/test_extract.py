"""Extraction over a small repository."""

import pytest

from spanworks.operators import extract, structure

FILES = [
    ("src/a.ts", "import { x } from './b'\nexport class Foo {\n}\nexport function bar(a) {\n  return baz(a, qux(1))\n}\n"),
    ("src/m.py", "class A:\n    def run(self):\n        go()\n\ndef main():\n    run(1)\n"),
    ("src/l.rs", "pub fn one() {}\n#[test]\nfn two() {}\n"), ("tests/test_m.py", "def test_run():\n    pass\nclass TestX:\n    pass\n"), ("tests/l.rs", "#[test]\nfn checks() {}\n"), ("tests/a.test.ts", "describe('all', () => {\n  it('works', () => {})\n})\n"),
    ("docs/api/x.md", "# Title\n\nText one\ntwo\n\n## Part `a`\n- item\n- more\n\n```\n# no heading\n```\n> quote\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n## Part a\nsee [b](../y.md#top) and [c](#part-a) [d](http://z)\n"),
    ("conf/a.yaml", "root:\n  name: x\n  deep:\n    more: 1\nother: 2\n"), ("conf/a.toml", "top = 1\n[tool.x]\nkey = \"v\"\n"), ("package.json", '{"name": "n", "scripts": {"test": "t"}}'), ("bad.json", "{"),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "path string, text string")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_code(files):
    found = rows(extract.code_spans(files), "path", "kind", "label", "start_line")
    assert ("src/a.ts", "code.class", "Foo", 2) in found and ("src/a.ts", "code.function", "bar", 4) in found and ("src/a.ts", "code.import", "./b", 1) in found
    assert ("src/m.py", "code.method", "run", 2) in found and ("src/m.py", "code.function", "main", 5) in found and ("src/l.rs", "code.function", "one", 1) in found
    assert ("src/m.py", "code.module", "src/m.py", 1) in found
    calls = rows(extract.callsites(files), "path", "label", "line")
    assert [c for c in calls if c[0] == "src/a.ts"] == [("src/a.ts", "baz", 5), ("src/a.ts", "qux", 5)] and ("src/m.py", "run", 6) in calls


def test_markdown(files):
    heads = {r.start_line: r for r in extract.markdown_headings(files).collect()}
    assert [(heads[n].label, heads[n].anchor, heads[n].end_line, heads[n].heading_path) for n in sorted(heads)] == [
        ("Title", "title", 20, ["Title"]), ("Part `a`", "part-a", 18, ["Title", "Part `a`"]), ("Part a", "part-a-1", 20, ["Title", "Part a"])]
    blocks = rows(extract.markdown_blocks(files), "start_line", "end_line", "kind")
    assert blocks == [
        (1, 1, "doc.heading"), (3, 4, "doc.paragraph"), (6, 6, "doc.heading"), (7, 8, "doc.list"), (10, 12, "doc.code_fence"), (13, 13, "doc.quote"), (15, 17, "doc.table"), (19, 19, "doc.heading"), (20, 20, "doc.paragraph")]
    assert rows(extract.table_rows(files), "line", "cells") == [(15, ["a", "b"]), (17, ["1", "2"])]
    assert rows(extract.markdown_links(files).fillna("", ["resolved"]), "target", "kind", "resolved") == [("#part-a", "anchor", "docs/api/x.md"), ("../y.md#top", "relative", "docs/y.md"), ("http://z", "external", "")]


def test_config_and_tests(files):
    assert rows(extract.config_entries(files), "path", "key", "value") == [
        ("conf/a.toml", "tool.x.key", '"v"'), ("conf/a.toml", "top", "1"), ("conf/a.yaml", "other", "2"), ("conf/a.yaml", "root", ""), ("conf/a.yaml", "root.deep", ""), ("conf/a.yaml", "root.deep.more", "1"), ("conf/a.yaml", "root.name", "x")]
    assert {"/name", "/scripts", "/scripts/test"} == {r.pointer for r in extract.json_entries(files).collect()}
    assert rows(extract.test_cases(files), "path", "name") == [("tests/a.test.ts", "all"), ("tests/a.test.ts", "works"), ("tests/l.rs", "checks"), ("tests/test_m.py", "TestX"), ("tests/test_m.py", "test_run")]


def of(spark, path, text):
    return spark.createDataFrame([(path, text), ("empty" + path[path.rindex(".") :], ""), ("null" + path[path.rindex(".") :], None)], "path string, text string")


def test_braces():
    ends = lambda text: sorted(structure.brace_ends(text))
    assert ends("function f({ a }) {\n  return '}' // }\n}\n") == [(1, 3, True)]
    assert ends("a {\n /* } \n } */ `}\n}` /[}/]}/\n}") == [(1, 4, True)] and ends("x = (/}/)\ny {}") == [(2, 2, True)] and ends("{\n return /}/\n}") == [(1, 3, True)]
    assert ends("a {\n b {\n }\n") == [(1, 4, False), (2, 3, True)] and ends("a {} {\n}\n") == [(1, 2, True)] and ends("") == []
    assert ends('"' + "\\\\" * 50_000 + '" {\n}') == [(1, 2, True)]


def test_indents():
    ends = lambda text: sorted(structure.indent_ends(text))
    text = 'class A:\n    def f(\n        a,\n    ):\n        """Text\nnot indented\n"""\n        return (1,\n2)\n\n    # note\n    x = 1\n\ndef g(): pass\n# end\n'
    assert ends(text) == [(1, 12, True), (2, 9, True), (14, 14, True)] and ends("") == []


def test_code_ends(spark):
    found = {r.label: (r.start_line, r.end_line, r.complete) for r in extract.code_spans(of(spark, "a.ts", "export class A {\n  x() {\n  }\n}\nexport const c = 1\nexport function f()\n{\n  if (1) {\n")).where("kind <> 'code.module'").collect()}
    assert found == {"A": (1, 4, True), "c": (5, 5, False), "f": (6, 9, False)}


def test_rst(spark):
    text = "Top\n===\n\nSee `here <a.rst#x>`_ now\nand on::\n\n  code\n\nRun::\n\n  one\n  two\n\nPart\n----\n- a\n- b\ntail\n\nNext\n====\n\n"
    found = [(r.kind, r.label, r.start_line, r.end_line) for r in structure.rst_blocks(of(spark, "a.rst", text)).collect()]
    assert sorted(found, key=lambda x: (x[2], x[0])) == [
        ("doc.heading", "Top", 1, 2), ("doc.section", "Top", 1, 18), ("doc.link", "here", 4, 5), ("doc.paragraph", "See `here <a.rst#x>`_ now", 4, 5), ("doc.paragraph", "code", 7, 7), ("doc.code_fence", "Run", 9, 12),
        ("doc.heading", "Part", 14, 15), ("doc.section", "Part", 14, 18), ("doc.list", "- a", 16, 17), ("doc.paragraph", "tail", 18, 18), ("doc.heading", "Next", 20, 21), ("doc.section", "Next", 20, 21)]


def test_json(spark):
    text = '{\n "a/b": {"c": ["x", "--flag", {"d": null}]},\n "e": "HOME"\n}'
    found = [(r.kind, r.label, r.pointer, r.line, r.mention) for r in structure.json_spans(of(spark, "conf/x.json", text)).where("path = 'conf/x.json'").collect()]
    assert found == [
        ("config.file", "x.json", "", 1, None), ("config.entry", "a/b", "/a~1b", 2, None), ("config.entry", "c", "/a~1b/c", 2, None), ("config.array_item", "x", "/a~1b/c/0", 2, None), ("config.array_item", "--flag", "/a~1b/c/1", 2, "cli"),
        ("config.array_item", "2", "/a~1b/c/2", 1, None), ("config.entry", "d", "/a~1b/c/2/d", 2, None), ("config.entry", "e", "/e", 3, None), ("config.entry", "HOME", "/e", 3, "env")]
    assert [r.kind for r in structure.json_spans(of(spark, "x.json", "[" * 100_000)).where("path = 'x.json'").collect()] == ["warning"]
    assert [r.kind for r in structure.json_spans(of(spark, "x.json", "[1, 2, 3]"), most=3).where("path = 'x.json'").collect()] == ["config.file", "config.array_item", "config.array_item", "warning"]


def test_packages(spark):
    text = '{"scripts": {"go": "x"}, "main": "m.js", "exports": {".": {"import": "./a.js"}, "./b": "./b.js"}, "bin": {"n": "n.js"}, "workspaces": {"packages": ["p/*"]}}'
    found = rows(structure.package_entries(of(spark, "q/package.json", text)), "role", "name", "label")
    assert found == [
        ("entrypoint", "bin.n", "n.js"), ("entrypoint", "exports..import", "./a.js"), ("entrypoint", "exports./b", "./b.js"), ("entrypoint", "main", "m.js"), ("script", "go", "go"), ("workspace", "p/*", "p/*")]
    project = structure.package_entries(of(spark, "pyproject.toml", "[project.scripts]\ngo = 'a.b:main'\n[other]\nx = 1\n"))
    assert rows(project, "role", "name", "label", "line") == [("entrypoint", "project.scripts.go", "a.b:main", 2), ("script", "go", "go", 2)]


def test_examples(spark):
    text = "# A\n## Quickstart\n```bash\nls\n```\n```text\nno\n```\n# B\n```py\n1\n```\n"
    rows_ = [("README.md", text), ("docs/tutorial/a.md", "```sh\nx\n```"), ("examples/e.py", "1\n2"), ("a.md", "```js\n```")]
    found = rows(extract.example_blocks(spark.createDataFrame(rows_, "path string, text string")), "path", "language", "source", "start_line", "end_line")
    assert found == [
        ("README.md", "bash", "readme_quickstart", 3, 5), ("README.md", "py", "markdown_executable", 10, 12), ("a.md", "js", "markdown_executable", 1, 2),
        ("docs/tutorial/a.md", "sh", "tutorial_markdown", 1, 3), ("examples/e.py", "python", "examples_path", 1, 2)]
