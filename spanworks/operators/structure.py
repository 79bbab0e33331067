"""Structure that shows only when a file is read in order: ends of blocks, RST blocks, JSON pointers, package entries.

Spark spreads the files. A scan is a small function of one file's text, called over Arrow batches and linear in the text;
it gives rows, which joins and windows take further. Files are rows (path, text); null texts give no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import classify

#: Default caps of a JSON file: spans and depth; of a package file: depth of its exports.
MOST_SPANS, MOST_DEPTH, EXPORT_DEPTH = 1000, 100, 50

# What an RST title is underlined with, from the shallowest.
RST_MARKS = ["=", "-", "~", "^", '"']

_STRINGS = r'"(?:[^"\\\n]|\\.)*+"?|' r"'(?:[^'\\\n]|\\.)*+'?"
# Words after which a slash begins a pattern.
_BEFORE_PATTERN = ["return", "case", "throw", "typeof", "instanceof", "delete", "void", "new"]
_PATTERN_LITERAL = r"(?:\A|(?<=[(=,:\[!&|?{};\n])|" + "|".join(rf"(?<=\b{w})" for w in _BEFORE_PATTERN) + r")[ \t]*/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/"
_BRACE_TOKEN = re.compile(rf"//[^\n]*|/\*.*?(?:\*/|\Z)|{_PATTERN_LITERAL}|{_STRINGS}|`(?:[^`\\]|\\.)*+`?|[{{}}\n]", re.S)
_INDENT_TOKEN = re.compile(r'"""(?:[^"\\]|\\.|"(?!""))*+(?:"""|\Z)|' rf"'''(?:[^'\\]|\\.|'(?!''))*+(?:'''|\Z)|{_STRINGS}|#[^\n]*|[()\[\]{{}}\n]", re.S)
_BLOCK = re.compile(r"\s*(?:async\s+def|def|class)\b")
_LIST_ITEM, _RST_LINK = re.compile(r"[-*+]\s"), re.compile(r"`([^`<]+?)\s*<([^>]+)>`_")


def _scanned(files: DataFrame, scan: Callable[[str, str], Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that `scan(path, text)` gives of each file, each with the path before it."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 100) for b in batches for i in range(0, b.num_rows, 100)):  # bounded memory
            found = [(path, *row) for path, text in zip(*(c.to_pylist() for c in batch.columns)) if path is not None and text is not None for row in scan(path, text)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(zip(*found), arrow)], schema=arrow)

    return files.select("path", F.regexp_replace("text", "\r\n", "\n")).mapInArrow(run, schema)


def brace_ends(text: str) -> Iterator[tuple[int, int, bool]]:
    """(line, end, complete) of each line that opens a brace outside of strings, patterns and comments: the end is the
    first line from it on after which no more braces are open than before it; without one the last line, not complete."""
    line, depth, before, opens = 1, 0, 0, False
    waiting: list[tuple[int, int]] = []  # lines with open blocks, and the depth before each: rising
    for token in _BRACE_TOKEN.finditer(text + "\n"):
        what = token.group()
        if what == "{":
            depth, opens = depth + 1, True
        elif what == "}":
            depth -= 1
        for _ in range(what.count("\n")):
            if opens:
                waiting.append((line, before))
            while waiting and depth <= waiting[-1][1]:
                yield waiting.pop()[0], line, True
            line, before, opens = line + 1, depth, False
    for start, _ in waiting:
        yield start, text.count("\n") + 1, False


def indent_ends(text: str) -> Iterator[tuple[int, int, bool]]:
    """(line, end, complete) of each `def` and `class` line: up to the last line with more than a comment on it
    before the next such line indented as little. Lines that go on in brackets or in a long string have no indent of their own."""
    lines, inner, depth, at = text.split("\n"), {1: False}, 0, 1
    for token in _INDENT_TOKEN.finditer(text):
        what = token.group()
        depth = max(0, depth + (what in "([{") - (what in ")]}")) if len(what) == 1 else depth
        for _ in range(what.count("\n")):
            at += 1
            inner[at] = depth > 0 or len(what) > 1
    open_, last = [], 0
    for n, line in enumerate(lines, 1):
        if not line.strip() or line.lstrip().startswith("#") and not inner[n]:
            continue
        if not inner[n]:
            indent = len(line) - len(line.lstrip())
            while open_ and indent <= open_[-1][1]:
                yield open_.pop()[0], last, True
            if _BLOCK.match(line):
                open_.append((n, indent))
        last = n
    for start, _ in open_:
        yield start, last, True


def block_ends(files: DataFrame) -> DataFrame:
    """(path, line_no, end_line, complete) of lines that open a block: by braces in JavaScript and TypeScript, by indent
    in Python. Other files have no rows."""
    language = classify.language(F.col("path"))
    schema = "path string, line_no long, end_line long, complete boolean"
    braces = _scanned(files.where(language.isin("javascript", "typescript")), lambda _, text: brace_ends(text), schema)
    return braces.unionByName(_scanned(files.where(language == "python"), lambda _, text: indent_ends(text), schema))


def _rst_runs(lines: list[str]) -> Iterator[tuple[str, int, int, int]]:
    """(kind, first line, last line, depth) of the blocks of a file, in order; lines count from 1."""

    def depth_under(n: int) -> int:  # of a title whose underline follows line n; 0: it is none
        mark = lines[n].strip() if n < len(lines) else ""
        return RST_MARKS.index(mark[0]) + 1 if len(mark) >= 3 and len(set(mark)) == 1 and mark[0] in RST_MARKS else 0

    def literal_end(n: int) -> int:  # the last line of the indented ones after `::`, with at most one blank line between
        first = n + 2 if n < len(lines) and not lines[n].strip() else n + 1
        end = first
        while end <= len(lines) and lines[end - 1][:1].isspace() and lines[end - 1].strip():
            end += 1
        return end - 1 if end > first else 0

    n = 1
    while n <= len(lines):
        line, start = lines[n - 1].strip(), n
        if not line:
            n += 1
            continue
        if depth := depth_under(n):
            yield "doc.heading", n, n + 1, depth
            n += 2
        elif line.endswith("::") and (end := literal_end(n)):
            yield "doc.code_fence", n, end, 0
            n = end + 1
        else:
            listed = bool(_LIST_ITEM.match(line))
            while n <= len(lines) and lines[n - 1].strip() and bool(_LIST_ITEM.match(lines[n - 1].strip())) == listed and (listed or not depth_under(n)):
                n += 1
            yield "doc.list" if listed else "doc.paragraph", start, n - 1, 0


def _rst(_: str, text: str) -> Iterator[tuple]:
    lines = text.split("\n")
    runs = list(_rst_runs(lines))
    above: list[tuple[int, int, str, list[str]]] = []  # open sections: depth, line, title, path of titles
    last = 0  # the last line of the blocks so far
    for kind, start, end, depth in [*runs, ("", 0, 0, 1)]:
        while depth and above and above[-1][0] >= depth:
            _, at, title, path = above.pop()
            yield "doc.section", title, at, last, path, None
        if not kind:
            return
        label = lines[start - 1].strip()
        if depth:
            above.append((depth, start, label, [*(above[-1][3] if above else []), label]))
        path = above[-1][3] if above else []
        yield kind, label.removesuffix("::") if kind == "doc.code_fence" else label, start, end, path, None
        if kind == "doc.paragraph":
            for name, target in _RST_LINK.findall("\n".join(lines[start - 1 : end])):
                yield "doc.link", name.strip(), start, end, path, target
        last = end


def rst_blocks(files: DataFrame) -> DataFrame:
    """(path, kind, label, start_line, end_line, heading_path, target) of RST files: headings by their underline, their
    sections, literal blocks, lists, paragraphs, and the links of these with their targets."""
    of = files.where(classify.language(F.col("path")) == "rst")
    return _scanned(of, _rst, "path string, kind string, label string, start_line long, end_line long, heading_path array<string>, target string")


def _parsed(text: str):
    """The JSON value of a text; an error, for a text that is none or too deep to read."""
    try:
        return json.loads(text), None
    except (ValueError, RecursionError) as error:
        return None, str(error)


class _Lines:
    """The first line on which a text holds a needle; 1 if none does."""

    def __init__(self, text: str):
        self.text, self.known = text, {}

    def of(self, needle: str) -> int:
        if needle not in self.known:
            self.known[needle] = self.text.count("\n", 0, max(0, self.text.find(needle))) + 1
        return self.known[needle]


def _compact(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _json(_: str, text: str, most: int, most_depth: int) -> Iterator[tuple]:
    value, error = _parsed(text)
    if error:
        yield "warning", error, None, 1, None, None
        return
    yield "config.file", None, "", 1, None, None
    line, n = _Lines(text), 1
    todo = [(value, "", None, False, 0)]
    while todo:
        value, pointer, key, item, depth = todo.pop()
        if n >= most or depth > most_depth:
            yield "warning", "more entries than are taken", pointer, 1, None, None
            return
        mention = "env" if isinstance(value, str) and re.fullmatch(r"[A-Z][A-Z0-9_]*", value) else "cli" if isinstance(value, str) and re.fullmatch(r"--[A-Za-z0-9][A-Za-z0-9-]*", value) else None
        if key is not None:
            at = line.of(_compact(value if item else key))
            label = value if item and isinstance(value, str) else key
            yield "config.array_item" if item else "config.entry", label, pointer, at, _compact(value), mention if item else None
            n += 1
            if mention and not item and n < most:
                yield "config.entry", value, pointer, at, _compact(value), mention
                n += 1
        inner = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
        below = [(v, f"{pointer}/{str(k).replace('~', '~0').replace('/', '~1')}", str(k), isinstance(value, list), depth + 1) for k, v in inner]
        todo += below[::-1]


def json_spans(files: DataFrame, most: int = MOST_SPANS, most_depth: int = MOST_DEPTH) -> DataFrame:
    """(path, kind, label, pointer, line, value_hash, mention) of JSON files: the file, its entries and items of arrays at
    any depth in document order, and a second entry for a value that names an environment variable or an option. At most
    `most` spans of a file and `most_depth` levels; a file with more, or one that is no JSON, has a row of kind warning."""
    of = files.where(classify.language(F.col("path")) == "json")
    found = _scanned(of, partial(_json, most=most, most_depth=most_depth), "path string, kind string, label string, pointer string, line long, value string, mention string")
    label = F.when(F.col("kind") == "config.file", classify.basename(F.col("path"))).otherwise(F.col("label"))
    return found.select("path", "kind", label.alias("label"), "pointer", "line", F.sha1("value").alias("value_hash"), "mention")


def _package(_: str, text: str) -> Iterator[tuple]:
    value, _error = _parsed(text)
    if not isinstance(value, dict):
        return
    line = _Lines(text)
    of = lambda label: line.of(_compact(label))
    as_dict = lambda x: x if isinstance(x, dict) else {}
    for script in as_dict(value.get("scripts")):
        yield "script", script, script, of(script)
    points = [(k, value[k]) for k in ("main", "module", "types") if isinstance(value.get(k), str)]
    todo = [("exports", value.get("exports"), 0)]
    while todo:
        name, target, depth = todo.pop()
        if isinstance(target, str):
            points.append((name, target))
        elif depth < EXPORT_DEPTH:
            todo += [(name + k if k.startswith(".") else f"{name}.{k}", v, depth + 1) for k, v in reversed(as_dict(target).items())]
    bin_ = value.get("bin")
    points += [("bin", bin_)] if isinstance(bin_, str) else [(f"bin.{k}", v) for k, v in as_dict(bin_).items() if isinstance(v, str)]
    for name, target in points:
        yield "entrypoint", name, target, of(target)
    spaces = value.get("workspaces")
    for space in spaces if isinstance(spaces, list) else as_dict(spaces).get("packages") or []:
        if isinstance(space, str):
            yield "workspace", space, space, of(space)


def package_entries(files: DataFrame) -> DataFrame:
    """(path, role, name, label, line): scripts, entry points (main, module, types, exports at any depth, bin) and
    workspaces of package.json files; scripts and their targets of pyproject.toml files."""
    name = classify.basename(F.col("path"))
    found = _scanned(files.where(name == "package.json"), _package, "path string, role string, name string, label string, line long")
    from .extract import config_entries

    scripts = config_entries(files.where(name == "pyproject.toml")).withColumn("name", F.regexp_extract("key", r"^(?:project|tool\.poetry)\.scripts\.(.+)$", 1)).where("name <> ''")
    rows = F.inline(F.array(
        F.struct(F.lit("script").alias("role"), F.col("name").alias("name"), F.col("name").alias("label")),
        F.struct(F.lit("entrypoint").alias("role"), F.col("key").alias("name"), F.regexp_replace("value", "^['\"]|['\"]$", "").alias("label"))))
    return found.unionByName(scripts.select("path", rows, "line"))


_YAML_ENTRY = re.compile(r"(\s*)(?:-\s+)?([A-Za-z0-9_.-]+):\s*(.*)$")


def _yaml(_: str, text: str) -> Iterator[tuple]:
    above: list[tuple[int, str]] = []
    for n, line in enumerate(text.split("\n"), 1):
        if entry := _YAML_ENTRY.match(line):
            indent = len(entry[1])
            while above and above[-1][0] >= indent:
                above.pop()
            above.append((indent, entry[2]))
            yield ".".join(name for _, name in above), entry[3].strip(), n


def yaml_entries(files: DataFrame) -> DataFrame:
    """(path, key, value, line) of YAML files: keys with those they stand under, by indent."""
    return _scanned(files.where(classify.language(F.col("path")) == "yaml"), _yaml, "path string, key string, value string, line long")
