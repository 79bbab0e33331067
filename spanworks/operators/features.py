"""Features read from projections, and the parts of a repository they belong to; mentions in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import classify
from ..sources.store import staged
from .graph import both_ways
from .links import with_confidence

# Contents that a map of a repository never shows, roles of its documents, endings of paths in texts.
FORBIDDEN = ["chat summary", "experiment conclusion", "user preference", "agent experience", "long-term memory", "full code snippet", "unanchored judgment"]
CANONICAL = ["canonical_api_doc", "readme_doc", "tutorial_doc", "design_doc"]
PATH_ENDS = ["md", "mdx", "rst", "py", "ts", "js", "json", "yaml", "yml", "toml", "sh"]
LEAST_CONFIDENCE = 0.6


def _said(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def read_features(rows: DataFrame, text: str) -> DataFrame:
    """(id, title, source) of JSON arrays of features: an id stands for a missing title and a title for a missing id. A text
    that is no array has none."""
    each = rows.select(F.explode(F.from_json(F.col(text), "array<string>")).alias("f")).where(F.col("f").startswith("{"))
    raw = each.select(F.from_json("f", "struct<id:string,title:string,source:string>").alias("f")).select("f.*")
    return raw.select(F.coalesce("id", "title", F.lit("feature.unknown")).alias("id"), F.coalesce("title", "id", F.lit("Untitled feature")).alias("title"), F.coalesce("source", F.lit("feature-projection")).alias("source"))


def normalized_projection(features: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An imported projection in one form: features (id, title) of (id, title, name), edges (source, target, relation) of (source,
    from, target, to, relation, kind). A name or id stands for a missing title, a hash of the title for a missing id; edges
    without both ends go."""
    title = F.coalesce(_said(F.col("title"), F.col("name"), F.col("id")), F.lit("Untitled feature"))
    nodes = features.select(F.coalesce(_said(F.col("id")), F.concat(F.lit("feature:"), F.substring(F.sha1(title), 1, 12))).alias("id"), title.alias("title"))
    ends = edges.select(_said(F.col("source"), F.col("from")).alias("source"), _said(F.col("target"), F.col("to")).alias("target"), F.coalesce(_said(F.col("relation"), F.col("kind")), F.lit("depends_on")).alias("relation"))
    return nodes, ends.where("source is not null and target is not null")


def clusters(features: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, linked): each feature (column id) and every node at the other end of a sure edge, a row each; without any, null. Rows,
    as a feature may have any number."""
    near = both_ways(edges.where(F.col("confidence") >= LEAST_CONFIDENCE)).select(F.col("node").alias("id"), F.col("other").alias("linked")).distinct()
    return features.select("id").distinct().join(near, "id", "left")


def mapped_spans(spans: DataFrame) -> DataFrame:
    """The spans that a map of a repository may show: on business paths, no notes of experiments, without forbidden contents."""
    text = F.lower(F.concat_ws("\n", "path", "label", "summary", "text"))
    held = F.lit(False)
    for term in FORBIDDEN:
        held = held | text.contains(term)
    layers = staged(spans.select("path").where("path is not null").distinct().withColumn("_layer", classify.layer(F.col("path"))))
    shown = spans.where((F.col("role") != "experiment_note_doc") & ~held).join(layers, "path", "left")
    return shown.where(F.coalesce("_layer", F.lit("business")) == "business").select(*spans.columns)


def repository_map(spans: DataFrame, edges: DataFrame) -> DataFrame:
    """(section, path, label, kind, n) of a map: top directories with their roles, canonical documents, source modules, tests,
    config entries, and sure links between what is shown."""
    safe = staged(mapped_spans(spans).select("span_id", "path", "role", "kind", "label"))
    top = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise(".")
    one, none = F.lit(1).cast("long"), F.lit(None).cast("string")
    roles = safe.groupBy(top.alias("path")).agg(F.array_join(F.array_sort(F.collect_set("role")), ", ").alias("label"), F.count("*").alias("n"))
    of = lambda section, rows, kind: rows.select(F.lit(section).alias("section"), "path", "label", kind.alias("kind"), one.alias("n"))
    kind, role = F.col("kind"), F.col("role")
    ids = safe.select("span_id")
    sure = edges.where(F.col("confidence") >= LEAST_CONFIDENCE).join(ids, F.col("source_id") == F.col("span_id"), "left_semi").join(ids, F.col("target_id") == F.col("span_id"), "left_semi")
    return (
        roles.select(F.lit("directories").alias("section"), "path", "label", none.alias("kind"), "n")
        .union(of("documents", safe.where(role.isin(CANONICAL)), role)).union(of("modules", safe.where((role == "source_file") & kind.startswith("code.")), kind))
        .union(of("tests", safe.where(kind.startswith("test.")), kind)).union(of("config", safe.where(kind.startswith("config.")), kind))
        .union(of("links", sure.select(F.col("source_id").alias("path"), F.col("target_id").alias("label"), F.concat_ws(" ", "relation", F.format_number("confidence", 2)).alias("kind")), F.col("kind"))))


def write_map(rows: DataFrame, folder: str) -> None:
    """The map as JSON lines and as Markdown, a line for each row, sorted by section, path and label."""
    ordered = rows.orderBy("section", "path", "label", "kind")
    ordered.write.mode("overwrite").json(f"{folder}/map.json")
    line = F.concat(F.lit("- `"), "section", F.lit("` "), "path", F.lit(": "), F.coalesce("label", F.lit("")), F.when(F.col("kind").isNotNull(), F.concat(F.lit(" ["), "kind", F.lit("]"))).otherwise(F.concat(F.lit(" ("), F.col("n").cast("string"), F.lit(")"))))
    ordered.select(line.alias("value")).write.mode("overwrite").text(f"{folder}/map.md")


def path_tokens(text: Column) -> Column:
    """What a text names in ticks, and what looks like a path, once each: without fragments, blanks and calls of a shell."""
    ticked = F.regexp_extract_all(text, F.lit("`([^`]+)`"), F.lit(1))
    paths = F.regexp_extract_all(text, F.lit(rf"(?im)(?:^|[\s*-])((?:\.?\.?/)?[\w.\x{{4e00}}-\x{{9fff}}/-]+\.(?:{'|'.join(PATH_ENDS)}))"), F.lit(1))
    bare = F.transform(F.array_distinct(F.concat(ticked, paths)), lambda t: F.trim(F.substring_index(t, "#", 1)))
    return F.filter(bare, lambda t: (t != "") & ~t.rlike(r"\s") & ~t.contains("$("))


def mentions(rows: DataFrame, text: str, command: str) -> DataFrame:
    """(path, kind, value) of what the text of a block names, once each: code in ticks, imported modules, lines that call a command,
    keys of configurations."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = {
        "inline_code": F.filter(F.transform(F.regexp_extract_all(t, F.lit("`([^`]+)`"), F.lit(1)), lambda v: F.trim(v)), lambda v: v != ""),
        "import": F.concat(F.regexp_extract_all(t, F.lit(r"""\bimport\s+(?:[^'"]+\s+from\s+)?['"]([^'"]+)['"]"""), F.lit(1)), F.regexp_extract_all(t, F.lit(r"""\brequire\(\s*['"]([^'"]+)['"]\s*\)"""), F.lit(1))),
        "cli": F.filter(F.transform(F.split(t, r"\r?\n"), lambda v: F.trim(v)), lambda v: v.rlike(rf"^{command}(?:\s|$)")),
        "config_key": F.regexp_extract_all(t, F.lit(r"(?m)^[^\S\n]*([A-Za-z][A-Za-z0-9_-]*)[^\S\n]*:"), F.lit(1))}
    each = F.array(*[F.struct(F.lit(kind).alias("kind"), F.array_distinct(values).alias("values")) for kind, values in found.items()])
    return rows.select("path", F.inline(each)).select("path", "kind", F.explode("values").alias("value"))


def example_links(examples: DataFrame, code: DataFrame) -> DataFrame:
    """(source_id, target_id, evidence, confidence): examples (span_id, text) and the code (span_id, label) whose label they hold as
    a word; of equal labels the first stands for all, so there are as many links as words with a label."""
    words = examples.select(F.col("span_id").alias("source_id"), F.explode(F.array_distinct(F.split("text", r"[^A-Za-z0-9_$]+"))).alias("token"))
    named = code.where("label <> ''").groupBy(F.col("label").alias("token")).agg(F.min("span_id").alias("target_id"))
    return with_confidence(words.join(named, "token").select("source_id", "target_id", F.lit("example_imports_or_calls_source_symbol").alias("evidence")))


def read_as(path: Column, scoped: bool = False) -> Column:
    """struct(document, artifact, code): as what a refresh reads a file, by language and role. Generated and vendored files are
    left out, notes of experiments unless the refresh is scoped."""
    language, role = classify.language(path), classify.role(path)
    usable = ~role.isin("generated_file", "vendor_file") & (F.lit(scoped) | (role != "experiment_note_doc"))
    coded = language.isin("python", "typescript", "javascript", "go", "rust", "java", "kotlin", "scala") | path.rlike(r"(^|/)examples?/")
    return F.struct((usable & language.isin("markdown", "mdx", "rst")).alias("document"), (usable & language.isin("json", "yaml", "toml")).alias("artifact"), (usable & coded).alias("code"))
