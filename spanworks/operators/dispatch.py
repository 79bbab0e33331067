"""Spans of any file, by its format; what can't be read leaves a row that says so."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import classify
from ..sources.store import staged
from ..sources.tables import lines
from . import extract, structure

#: Bytes beyond which a file stays a file.
MOST_BYTES = 1 << 20
#: What only MDX has: modules and components.
_MDX_ONLY = r"^\s*(?:import|export)\s|^\s*</?[A-Z]|^\s*\{"
SCHEMA = ["path", "parser", "kind", "label", "start_line", "end_line", "detail", "error"]


def _rows(found: DataFrame, parser: str, kind: Column, start: str, end: str | None = None, detail: Column | None = None, error: Column | None = None, label: str = "label") -> DataFrame:
    none = F.lit(None).cast("string")
    return found.select(
        "path", F.lit(parser).alias("parser"), kind.alias("kind"), F.col(label).cast("string").alias("label"), F.col(start).cast("long").alias("start_line"), F.col(end or start).cast("long").alias("end_line"),
        (none if detail is None else detail).alias("detail"), (none if error is None else error).alias("error"))


def dispatched(files: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, parser, kind, label, start_line, end_line, detail, error) of files (path, text), each by its language.

    Markdown: blocks and sections; MDX the same, with a warning row where it has modules or components, which are read as
    text; RST: blocks; code: declarations and calls, test cases; JSON, YAML, TOML: entries, packages' scripts and entry
    points. Every file has a row of kind `file`. A file that its parser can't read has one of kind `parse.error`, and an
    oversized one no other span. Null texts are empty. Files are written once, by what reads them, and each parser reads its
    own only."""
    language, ends = classify.language(F.col("path")), F.lower(classify.extension(F.col("path")))
    is_ = lambda c: F.coalesce(c, F.lit(False))
    flags = {"_language": language, "_code": is_(ends.isin(classify.CODE)), "_test": is_(classify.role(F.col("path")) == "test_file"), "_package": is_(classify.basename(F.col("path")).isin("package.json", "pyproject.toml"))}
    rows = staged(files.select("path", F.coalesce("text", F.lit("")).alias("text"), *[c.alias(name) for name, c in flags.items()]), list(flags))
    big = F.octet_length("text") > most_bytes
    whole = rows.select("path", F.col("_language").alias("parser"), F.lit("file").alias("kind"), classify.basename(F.col("path")).alias("label"), F.lit(1).cast("long").alias("start_line"),
        F.greatest(F.size(F.split(F.regexp_replace("text", r"\r?\n$", ""), "\n", -1)), F.lit(1)).cast("long").alias("end_line"), F.lit(None).cast("string").alias("detail"), F.when(big, "oversized").alias("error"))
    read = rows.where(~big)
    kinds = lambda *names: read.where(F.col("_language").isin(*names)).select("path", "text")
    kind, none = F.col("kind"), F.lit(None).cast("string")
    parts = [whole]
    for name in ("markdown", "mdx"):
        parts.append(_rows(extract.markdown_blocks(kinds(name)), name, kind, "start_line", "end_line"))
        parts.append(_rows(extract.markdown_headings(kinds(name)), name, F.lit("doc.section"), "start_line", "end_line", F.array_join("heading_path", "/")))
    odd = lines(kinds("mdx")).where(F.col("line").rlike(_MDX_ONLY)).groupBy("path").agg(F.min("line_no").alias("line"), F.max("line_no").alias("last")).withColumn("label", F.lit("read as Markdown"))
    parts.append(_rows(odd, "mdx", F.lit("parse.warning"), "line", "last", error=F.lit("modules and components are read as text")))
    parts.append(_rows(structure.rst_blocks(kinds("rst")), "rst", kind, "start_line", "end_line", F.coalesce("target", F.array_join("heading_path", "/"))))
    code = read.where("_code").select("path", "text")
    spans = extract.code_spans(code)
    parts.append(_rows(spans, "code", kind, "start_line", "end_line", error=F.when(~F.col("complete") & (F.col("end_line") > F.col("start_line")), "no end found")))
    parts.append(_rows(extract.callsites(code), "code", F.lit("code.callsite"), "line"))
    parts.append(_rows(extract.test_cases(read.where("_test").select("path", "text")), "code", F.lit("test.case"), "line", label="name"))
    entries = structure.json_spans(kinds("json"))
    failed = kind == "warning"
    parts.append(_rows(entries, "json", F.when(failed, "parse.error").otherwise(kind), "line", detail=F.when(~failed, F.col("pointer")), error=F.when(failed, F.col("label"))))
    for name in ("yaml", "toml"):
        found = extract.config_entries(kinds(name))
        parts.append(_rows(found, name, F.lit("config.entry"), "line", detail=F.col("value"), label="key"))
        empty = kinds(name).where(F.col("text").rlike(r"(?m)^\s*[^\s#]")).join(found.select("path").distinct(), "path", "left_anti").select("path", F.lit(1).alias("line"), none.alias("label"))
        parts.append(_rows(empty, name, F.lit("parse.error"), "line", error=F.lit("no entry found")))
    packages = structure.package_entries(read.where("_package").select("path", "text"))
    parts.append(_rows(packages, "package", F.concat(F.lit("package."), F.col("role")), "line", detail=F.col("name")))
    return reduce(DataFrame.unionByName, parts)


def bounded_text(spans: DataFrame, most: int, text: str = "text") -> DataFrame:
    """spans with a text of at most `most` bytes, `truncated`, and what relocation needs where it was cut: line_count and hashes
    of the first and last eight lines of the whole text."""
    prints = classify.fingerprints(F.col(text))
    long = F.octet_length(text) > most
    return spans.withColumns({"truncated": F.coalesce(long, F.lit(False)), "line_count": F.size(F.split(text, "\n", -1)), "prints": F.when(long, prints)}).withColumn(text, F.when(long, classify.cut_bytes(F.col(text), most)).otherwise(F.col(text)))
