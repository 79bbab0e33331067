"""documents as typed spans: the columns that candidates of a request have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .tables import table

#: What a document's number picks: a folder with its role, a name, an ending, a kind.
FOLDERS = [
    ("docs/api/", "canonical_api_doc"), ("src/", "source_file"), ("tests/", "test_file"), ("docs/tutorial/", "tutorial_doc"), ("vendor/", "vendor_file"), ("dist/", "generated_file"), ("examples/", "example_doc"), ("fixtures/", "fixture_file")]
NAMES, ENDS = ["client", "request_timeout", "scheduler", "check_limits.test", "run_backup-plan", "index"], [".ts", ".md", ".py", ".json", ".rst"]
KINDS = ["code.function", "doc.paragraph", "doc.table_row", "config.entry", "doc.heading", "code.module", "doc.table", "test.case", "file"]
#: The routes by which a kind is found, in order.
ROUTES = {"code": ["code_symbol_name_signature", "fts_lexical"], "doc": ["fts_lexical", "path_role_expansion", "markdown_heading_anchor_inline_code"], "config": ["config_cli_env_schema", "fts_lexical"], "test": ["test_example_import_call", "fts_lexical"], "file": ["path_role_expansion"]}


def _literal(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


#: The same for the oracles.
SPANS = f"""spans AS (SELECT doc_id, 'span:' || doc_id AS span_id,
    {_literal(f for f, _ in FOLDERS)}[doc_id % {len(FOLDERS)} + 1] || source || '/' || {_literal(NAMES)}[doc_id % {len(NAMES)} + 1] || '_' || (doc_id % 100) || {_literal(ENDS)}[doc_id % {len(ENDS)} + 1] AS path,
    {_literal(r for _, r in FOLDERS)}[doc_id % {len(FOLDERS)} + 1] AS role, {_literal(KINDS)}[doc_id % {len(KINDS)} + 1] AS kind, regexp_extract(text, '[A-Za-z]+') AS label, concat_ws(' ', source, lang) AS heading, text,
    (doc_id % 11) / 10.0::DOUBLE AS linked, doc_id % 17 = 0 AS stale, doc_id % 23 = 0 AS deprecated, CASE WHEN doc_id % 19 = 0 THEN 'high' WHEN doc_id % 13 = 0 THEN 'medium' ELSE 'low' END AS risk, doc_id % 3 = 0 AS covers,
    1 + doc_id % 50 AS start_line FROM documents WHERE doc_id IS NOT NULL)"""


def spans(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, span_id, path, role, kind, label, heading, text, linked, stale, deprecated, risk, covers, start_line)."""
    n = F.col("doc_id")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
    path = F.concat(pick([f for f, _ in FOLDERS]), "source", F.lit("/"), pick(NAMES), F.lit("_"), (n % 100).cast("string"), pick(ENDS))
    return table(spark, folder, "documents").where("doc_id is not null").select(
        "doc_id", F.concat(F.lit("span:"), n.cast("string")).alias("span_id"), path.alias("path"), pick([r for _, r in FOLDERS]).alias("role"), pick(KINDS).alias("kind"),
        F.regexp_extract("text", "[A-Za-z]+", 0).alias("label"), F.concat_ws(" ", "source", "lang").alias("heading"), "text", ((n % 11) / 10.0).alias("linked"), (n % 17 == 0).alias("stale"),
        (n % 23 == 0).alias("deprecated"), F.when(n % 19 == 0, "high").when(n % 13 == 0, "medium").otherwise("low").alias("risk"), (n % 3 == 0).alias("covers"), (1 + n % 50).alias("start_line"))


def routes(kind) -> "F.Column":
    """The routes of a kind, in order."""
    family = F.split(kind, r"\.")[0]
    known = F.create_map(*[x for k, v in ROUTES.items() for x in (F.lit(k), F.array(*[F.lit(r) for r in v]))])
    return F.try_element_at(known, family)
