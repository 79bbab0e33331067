"""Spans from the text of files: an exploded line each, patterns for what opens a span, windows for how far it goes.

The forms are line-based subsets: no grammar is parsed. Files are rows (path, text); every result has path, kind, label,
start_line and end_line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import classify
from ..sources.tables import lines
from .structure import MOST_SPANS, block_ends, json_spans, yaml_entries

# Fixed values: (language, kind, pattern with the name as its first group).
DECLARATIONS = [
    ("typescript", "code.class", r"^export\s+(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)"),
    ("typescript", "code.function", r"^export\s+(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)"),
    ("typescript", "code.constant", r"^export\s+const\s+([A-Za-z_$][\w$]*)"),
    ("typescript", "code.import", r"""^import\s.*?from\s+['"]([^'"]+)['"]"""),
    ("python", "code.class", r"^\s*class\s+([A-Za-z_]\w*)"),
    ("python", "code.method", r"^\s+(?:async\s+)?def\s+([A-Za-z_]\w*)"),
    ("python", "code.function", r"^(?:async\s+)?def\s+([A-Za-z_]\w*)"),
    ("go", "code.method", r"^func\s+\([^)]*\)\s*([A-Za-z_]\w*)"),
    ("go", "code.function", r"^func\s+([A-Za-z_]\w*)"),
    ("go", "code.class", r"^type\s+([A-Za-z_]\w*)\s+(?:struct|interface)"),
    ("rust", "code.function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+([A-Za-z_]\w*)"),
    ("rust", "code.class", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+([A-Za-z_]\w*)"),
    ("java", "code.class", r"^\s*(?:public\s+|private\s+|protected\s+|abstract\s+|final\s+|static\s+)*(?:class|interface|enum|object)\s+([A-Za-z_]\w*)"),
    ("java", "code.method", r"^\s+(?:public\s+|private\s+|protected\s+|static\s+|final\s+|fun\s+)+[\w<>\[\], ]*?([A-Za-z_]\w*)\s*\("),
]
FAMILY = {"javascript": "typescript", "kotlin": "java", "scala": "java"}
# Words before a parenthesis that are no calls.
KEYWORDS = ["if", "for", "while", "switch", "catch", "function", "return", "def", "class", "func", "fn", "new", "typeof", "await", "match", "elif", "print"]
MOST_CALLS, MOST_CALLS_A_LINE, LONGEST_LINE = 1000, 50, 20_000


def _numbered(files: DataFrame) -> DataFrame:
    return lines(files.select("path", "text").withColumn("text", F.regexp_replace("text", "\r\n", "\n")))


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def code_spans(files: DataFrame) -> DataFrame:
    """Declarations by language and a module span for each code file. Classes, functions and methods of JavaScript and
    TypeScript end where their braces do, those of Python where their indent does; others end on their own line. `complete`
    tells whether an end was found."""
    language = classify.language(F.col("path"))
    family = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in FAMILY.items() for x in kv]), language), language)
    rows = _numbered(files.where(F.lower(classify.extension(F.col("path"))).isin(classify.CODE))).withColumn("family", family)
    found = F.lit(None).cast("struct<kind:string,label:string>")
    for lang, kind, pattern in reversed(DECLARATIONS):
        hit = (F.col("family") == lang) & F.col("line").rlike(pattern)
        found = F.when(hit, F.struct(F.lit(kind).alias("kind"), F.regexp_extract("line", pattern, 1).alias("label"))).otherwise(found)
    modules = rows.groupBy("path").agg(F.max("line_no").alias("end_line")).select("path", F.lit("code.module").alias("kind"), F.col("path").alias("label"), F.lit(1).cast("long").alias("start_line"), "end_line", F.lit(True).alias("complete"))
    marked = rows.select("path", "line_no", "family", found.alias("found"), F.lit(None).cast("struct<line_no:long,end_line:long,complete:boolean>").alias("block")).where("found is not null")
    blocks = block_ends(files).select("path", "line_no", F.lit(None).cast("string").alias("family"), F.lit(None).cast("struct<kind:string,label:string>").alias("found"), F.struct("line_no", "end_line", "complete").alias("block"))
    # From the last line up, a block before the declarations of its line: the nearest block at or below each declaration.
    upward = Window.partitionBy("path").orderBy(F.desc("line_no"), F.col("found").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nearest = marked.unionByName(blocks).withColumn("block", F.last("block", True).over(upward)).where("found is not null")
    braced = (F.col("family") == "typescript") & F.col("found.kind").isin("code.class", "code.function", "code.method")
    own = (F.col("family") == "python") & (F.col("block.line_no") == F.col("line_no"))
    single = F.struct(F.col("line_no").alias("end_line"), F.lit(False).alias("complete"))
    whole = modules.select("path", F.col("end_line").alias("last"))
    end = F.when(braced & F.col("block").isNull(), F.struct(F.col("last").alias("end_line"), F.lit(False).alias("complete"))).when(braced | own, F.struct("block.end_line", "block.complete")).otherwise(single)
    spans = nearest.join(whole, "path").withColumn("end", end).select("path", "found.kind", "found.label", F.col("line_no").alias("start_line"), "end.end_line", "end.complete")
    return modules.unionByName(spans)


def callsites(files: DataFrame) -> DataFrame:
    """(path, label, line): names before a parenthesis, at most 50 of a line and 1000 of a file, in order."""
    rows = _numbered(files.where(F.lower(classify.extension(F.col("path"))).isin(classify.CODE))).where(F.char_length("line") <= LONGEST_LINE)
    declared = F.col("line").rlike(r"^\s*(?:export\s+)?(?:async\s+)?(?:def|func|fn|function|class)\s")
    names = F.filter(F.regexp_extract_all("line", F.lit(r"\b([A-Za-z_$][\w$]*)\s*\("), F.lit(1)), lambda n: ~n.isin(KEYWORDS))
    each = rows.where(~declared).select("path", "line_no", F.posexplode(F.slice(names, 1, MOST_CALLS_A_LINE)).alias("at", "label"))
    n = F.row_number().over(Window.partitionBy("path").orderBy("line_no", "at"))
    return each.withColumn("n", n).where(F.col("n") <= MOST_CALLS).select("path", "label", F.col("line_no").alias("line"))


def markdown_blocks(files: DataFrame) -> DataFrame:
    """Headings, sections, fences, lists, quotes, table rows and paragraphs of Markdown files, as runs of lines of a kind."""
    rows = _numbered(files.where(classify.language(F.col("path")).isin("markdown", "mdx")))
    above = Window.partitionBy("path").orderBy("line_no")
    fence = F.col("line").rlike(r"^\s*(```|~~~)")
    opened = F.sum(fence.cast("int")).over(above.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("fence", fence).withColumn("opened", opened)
    line = F.col("line")
    kind = (
        F.when(F.col("fence") | (F.col("opened") % 2 == 1), "doc.code_fence").when(line.rlike(r"^\s*$"), None).when(line.rlike(r"^#{1,6}\s"), "doc.heading")
        .when(line.rlike(r"^\s*>"), "doc.quote").when(line.rlike(r"^\s*\|.*\|\s*$"), "doc.table").when(line.rlike(r"^\s*(?:[-*+]|\d+[.)])\s"), "doc.list").otherwise("doc.paragraph"))
    rows = rows.withColumn("kind", kind)
    before = F.lag("kind").over(above)
    fence_start = F.col("fence") & (F.col("opened") % 2 == 1)
    starts = F.col("kind").isNotNull() & ((F.col("kind") == "doc.heading") | fence_start | before.isNull() | (before != F.col("kind")))
    rows = rows.withColumn("run", F.sum(starts.cast("int")).over(above.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    blocks = rows.where("kind is not null").groupBy("path", "run", "kind").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.min_by("line", "line_no").alias("label")).drop("run")
    return blocks.select("path", "kind", F.regexp_replace(F.trim("label"), r"^#{1,6}\s+", "").alias("label"), "start_line", "end_line")


def markdown_headings(files: DataFrame) -> DataFrame:
    """(path, label, depth, anchor, start_line, end_line, heading_path): headings with their sections and ancestors."""
    rows = _numbered(files.where(classify.language(F.col("path")).isin("markdown", "mdx")))
    above = Window.partitionBy("path").orderBy("line_no")
    opened = F.sum(F.col("line").rlike(r"^\s*(```|~~~)").cast("int")).over(above.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = F.max(F.when(F.trim("line") != "", F.col("line_no"))).over(Window.partitionBy("path"))
    heads = rows.withColumn("opened", opened).withColumn("last", last).where((F.col("opened") % 2 == 0) & F.col("line").rlike(r"^#{1,6}\s"))
    heads = heads.select("path", "line_no", F.char_length(F.regexp_extract("line", "^(#{1,6})", 1)).alias("depth"), F.trim(F.regexp_replace("line", r"^#{1,6}\s+|\s+#+\s*$", "")).alias("label"), "last")
    here = above.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names = []
    for d in range(1, 7):  # the last heading of depth d, unless a shallower one came after it
        at, cover = F.last(F.when(F.col("depth") == d, F.col("line_no")), True).over(here), F.last(F.when(F.col("depth") < d, F.col("line_no")), True).over(here)
        name = F.last(F.when(F.col("depth") == d, F.col("label")), True).over(here)
        names.append(F.when((F.col("depth") >= d) & at.isNotNull() & (cover.isNull() | (at > cover)), name))
    upward = Window.partitionBy("path").orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1)  # linear; a frame to the last row is not
    following = [F.min(F.when(F.col("depth") <= d, F.col("line_no"))).over(upward) for d in range(1, 7)]
    end = F.coalesce(F.coalesce(*[F.when(F.col("depth") == d, n) for d, n in enumerate(following, 1)]) - 1, F.col("last"))
    found = heads.select("path", "label", "depth", classify.slug(F.col("label")).alias("base"), F.col("line_no").alias("start_line"), end.alias("end_line"), F.array_compact(F.array(*names)).alias("heading_path"))
    n = F.row_number().over(Window.partitionBy("path", "base").orderBy("start_line")) - 1
    return found.withColumn("n", n).withColumn("anchor", F.when(F.col("n") == 0, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("n").cast("string")))).drop("n", "base")


def markdown_links(files: DataFrame) -> DataFrame:
    """(path, line, target, kind, resolved): links of Markdown files; external, anchor or relative to the file."""
    rows = _numbered(files.where(classify.language(F.col("path")).isin("markdown", "mdx", "rst")))
    each = rows.select("path", F.col("line_no").alias("line"), F.explode(F.regexp_extract_all("line", F.lit(r"\[[^\]]*\]\(([^)\s]+)[^)]*\)"), F.lit(1))).alias("target"))
    kind = F.when(F.col("target").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:|^//"), "external").when(F.col("target").startswith("#"), "anchor").otherwise("relative")
    from .links import resolved

    file = F.regexp_replace("target", "#.*$", "")
    return each.withColumn("kind", kind).withColumn("resolved", F.when(F.col("kind") == "anchor", F.col("path")).when(F.col("kind") == "relative", resolved(F.col("path"), file)))


# Languages of fences that can be run.
EXECUTABLE = ["bash", "sh", "shell", "python", "py", "ts", "tsx", "js", "jsx", "typescript", "javascript"]


def example_blocks(files: DataFrame) -> DataFrame:
    """(path, language, source, start_line, end_line): the files of the examples folder, whole; of other Markdown files the
    fences that can be run, from a quickstart of README.md, a tutorial or elsewhere."""
    inside = F.col("path").startswith("examples/")
    fences = markdown_blocks(files.where(~inside)).where("kind = 'doc.code_fence'").withColumn("language", F.lower(F.regexp_extract("label", r"^```([A-Za-z0-9_-]+)\s*$", 1))).where(F.col("language").isin(EXECUTABLE))
    heads = markdown_headings(files.where(~inside)).select("path", "start_line", F.array_join("heading_path", "/").alias("titles"))
    line = Window.partitionBy("path").orderBy("start_line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = fences.select("path", "language", "start_line", "end_line").unionByName(heads, allowMissingColumns=True)
    under = both.withColumn("titles", F.last("titles", True).over(line)).where("language is not null")
    source = F.when((F.lower(classify.basename(F.col("path"))) == "readme.md") & F.coalesce("titles", F.lit("")).rlike("(?i)quickstart"), "readme_quickstart").when(F.col("path").rlike("(?i)tutorial"), "tutorial_markdown").otherwise("markdown_executable")
    whole = _numbered(files.where(inside)).groupBy("path").agg(F.max("line_no").alias("end_line"))
    return under.select("path", "language", source.alias("source"), "start_line", "end_line").unionByName(
        whole.select("path", classify.language(F.col("path")).alias("language"), F.lit("examples_path").alias("source"), F.lit(1).cast("long").alias("start_line"), "end_line"))


def table_rows(files: DataFrame) -> DataFrame:
    """(path, line, cells): rows of pipe tables, without the ruling and without empty ones."""
    rows = _numbered(files).where(F.col("line").rlike(r"\|") & ~F.col("line").rlike(r"^\s*\|?[\s:|-]*\|?\s*$"))
    cells = F.filter(F.transform(F.split("line", r"\|"), lambda c: F.trim(c)), lambda c: c != "")
    return rows.select("path", F.col("line_no").alias("line"), cells.alias("cells"))


def config_entries(files: DataFrame) -> DataFrame:
    """(path, key, value, line) of YAML and TOML files: keys with those they stand under, by indent or table."""
    toml = _numbered(files.where(classify.language(F.col("path")) == "toml"))
    table = F.last(F.when(F.col("line").rlike(r"^\s*\[+[^\]]+\]+"), F.regexp_extract("line", r"^\s*\[+([^\]]+)\]+", 1)), True).over(Window.partitionBy("path").orderBy("line_no"))
    toml = toml.withColumn("table", table).where(F.col("line").rlike(r"^\s*[\w.-]+\s*="))
    toml = toml.select("path", F.concat_ws(".", "table", F.regexp_extract("line", r"^\s*([\w.-]+)\s*=", 1)).alias("key"), F.trim(F.regexp_extract("line", r"=\s*(.*)$", 1)).alias("value"), F.col("line_no").alias("line"))
    return yaml_entries(files).unionByName(toml)


def json_entries(files: DataFrame, most: int = MOST_SPANS) -> DataFrame:
    """(path, pointer, value_hash) of the entries of JSON files, at any depth; a file that is no JSON gives no rows."""
    spans = json_spans(files, most).where(F.col("kind").isin("config.entry", "config.array_item"))
    return spans.select("path", "pointer", "value_hash").distinct()


def test_cases(files: DataFrame) -> DataFrame:
    """(path, name, line): test functions and cases of files that look like tests; an annotation names the next line's."""
    rows = _numbered(files.where(classify.role(F.col("path")) == "test_file"))
    before = F.lag("line").over(Window.partitionBy("path").orderBy("line_no"))
    patterns = [r"^\s*(?:async\s+)?def\s+(test\w*)", r"^\s*class\s+(Test\w*)", r"""^\s*(?:describe|it|test)(?:\.\w+)?\(\s*['"`]([^'"`]+)""", r"^func\s+((?:Test|Benchmark)\w*)"]
    annotated = before.rlike(r"^\s*(?:#\[(?:\w+::)?test\]|@Test\b)")
    after = r"(?:fn|void|fun)\s+([A-Za-z_]\w*)"
    name = F.when(_any([F.col("line").rlike(p) for p in patterns]), F.coalesce(*[F.nullif(F.regexp_extract("line", p, 1), F.lit("")) for p in patterns])).when(annotated & F.col("line").rlike(after), F.regexp_extract("line", after, 1))
    return rows.select("path", name.alias("name"), F.col("line_no").alias("line")).where("name is not null")
