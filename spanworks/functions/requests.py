"""A change request as lists of terms, by kind: columns over the tokens of its text, and the same as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .paths import ROLE_GROUPS

# Words that are no terms, words of documents, file extensions.
STOP_WORDS = ["and", "the", "for", "with", "into", "from", "to", "all", "across", "update", "change", "replace", "modify", "read", "span"]
DOC_WORDS = ["api", "doc", "docs", "readme", "quickstart", "tutorial", "guide", "example", "design", "table", "row", "rows"]
TABLE_WORDS = ["table", "row", "rows"]
EXTENSIONS = ["md", "py", "ts", "tsx", "js", "jsx", "json", "yaml", "yml", "toml", "txt", "csv", "ipynb"]
MOST_CHARS, LEAST_LENGTH = 10_000, 2
# The forms in which a request names an old and a new term.
_NAME = r"[A-Za-z_$][A-Za-z0-9_$-]*(?:[.:][A-Za-z_$][A-Za-z0-9_$-]*)*"
OLD_NEW = [
    rf"(?i)\bfrom\s+({_NAME})\s+to\s+({_NAME})", rf"(?i)\b(?:rename|change)\s+({_NAME})\s+to\s+({_NAME})", rf"({_NAME})\s*[-=]>\s*({_NAME})",
    r"(?i)\breplace\s+(.+?)\s+with\s+(.+?)(?:$|\s+(?:in|across|for|and)\b)"]

# What a token is, as patterns of the whole token; both engines read them alike.
SEPARATORS, BLANKS = r"[^\p{L}\p{N}_./:-]+", r"\s+"
EDGES, BRACKETS = r"""^['"`]+|['"`.,;:]+$""", r"^[(\[{<]+|[)\]}>]+$"
CONFIG = r"^(?:--[A-Za-z0-9][A-Za-z0-9-]*|[A-Z][A-Z0-9_]{2,}|[a-z]+(?:\.[a-z0-9_-]+)+)$"
PATH = r"\.[A-Za-z0-9]+$|^(?:\.{1,2}|~)?/|^[A-Za-z0-9._@~+-]+(?:/+[A-Za-z0-9._@~+-]+)+/*$"
EXTENSION = rf"^(?:\.(?i:{'|'.join(EXTENSIONS)})|{'|'.join(EXTENSIONS)})$"
IDENTIFIER = r"^[A-Za-z_$][A-Za-z0-9_$]*$"
SYMBOL = r"^(?:[A-Za-z_$][A-Za-z0-9_$]*[A-Z_][A-Za-z0-9_$]*|_[A-Za-z0-9_$]*|[A-Za-z_$][A-Za-z0-9_$]{9,})$"
QUALIFIED = r"^[^/\s]*[.:][^/\s]*$"
TICKED = r"`([A-Za-z_$][A-Za-z0-9_$]*)`"
FIELDS = ("exact", "config", "path", "symbol", "doc", "feature", "old", "new")


def _array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _fits(words: Column, pattern: str, wanted: bool = True) -> Column:
    return F.filter(words, lambda w: w.rlike(pattern) if wanted else ~w.rlike(pattern))


def _set(*lists: Column) -> Column:
    return F.array_distinct(F.filter(F.concat(*lists), lambda w: w != ""))


def _stripped(words: Column, pattern: str) -> Column:
    return F.transform(words, lambda w: F.regexp_replace(w, pattern, ""))


def with_terms(requests: DataFrame, text: str = "text", roles: list[str] | tuple = ()) -> DataFrame:
    """requests with raw and an array for each of FIELDS, and roles: those asked for, groups of them unfolded. A null text
    has no terms. Each field is a set in the order of the text."""
    step = lambda rows, **columns: rows.withColumns({f"_q_{k}" if k not in (*FIELDS, "raw", "roles") else k: v for k, v in columns.items()})
    rows = step(requests, raw=F.substring(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^\s+|\s+$", ""), 1, MOST_CHARS))
    forms = [F.arrays_zip(F.regexp_extract_all("raw", F.lit(p), F.lit(1)).alias("a"), F.regexp_extract_all("raw", F.lit(p), F.lit(2)).alias("b")) for p in OLD_NEW]
    tidy = lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), EDGES, ""), BLANKS, " ")
    pairs = F.filter(F.transform(F.concat(*forms), lambda p: F.struct(tidy(p["a"]).alias("a"), tidy(p["b"]).alias("b"))), lambda p: (p["a"] != "") & (p["b"] != "") & (p["a"] != p["b"]))
    rows = step(rows, terms=F.filter(F.split("raw", SEPARATORS), lambda t: t != ""), words=_stripped(_stripped(F.split("raw", BLANKS), EDGES), BRACKETS), pairs=pairs)
    rows = step(rows, clean=_stripped(F.col("_q_terms"), EDGES), old=_set(F.transform("_q_pairs", lambda p: p["a"])), new=_set(F.transform("_q_pairs", lambda p: p["b"])))
    named = F.transform(_fits(F.concat("_q_clean", "old", "new"), QUALIFIED), lambda w: F.split(w, "[.:]+"))
    rows = step(rows, parts=F.array_distinct(_fits(F.flatten(named), IDENTIFIER)))
    plain = lambda w: (F.char_length(w) >= LEAST_LENGTH) & ~w.isin(STOP_WORDS) & ~w.rlike(EXTENSION)
    rows = step(
        rows, exact=_set(F.filter(F.transform(F.concat("_q_clean", "_q_parts"), F.lower), plain)), config=_set(_fits(F.col("_q_terms"), CONFIG)),
        path=_set(_fits(_fits(F.concat("_q_words", "_q_terms"), PATH), EXTENSION, False)),
        symbol=_set(_fits(F.col("_q_terms"), SYMBOL), F.col("old"), F.col("new"), F.col("_q_parts"), F.regexp_extract_all("raw", F.lit(TICKED), F.lit(1))))
    tables = F.when(F.arrays_overlap("exact", _array(TABLE_WORDS)), _array(["table", "row"])).otherwise(_array([]))
    of_config = F.flatten(F.transform("config", lambda c: F.split(F.lower(F.regexp_replace(c, "^--", "")), "[_./-]+")))
    rows = step(
        rows, doc=_set(F.filter("exact", lambda t: t.isin(DOC_WORDS) | F.lower("raw").contains(F.concat(t, F.lit(" api")))), tables),
        feature=_set(F.filter("exact", lambda t: ~t.isin(DOC_WORDS) & (F.char_length(t) >= 4) & ~F.array_contains("path", t)), F.filter(of_config, lambda t: F.char_length(t) >= 4)))
    wanted = list(dict.fromkeys(r for name in roles for r in ROLE_GROUPS.get(name, [name])))
    return rows.withColumn("roles", _array(wanted)).drop(*[c for c in rows.columns if c.startswith("_q_")])


def normalize(spark, text: str, roles: list[str] | tuple = ()) -> dict:
    """The terms of one request: a short text of the driver."""
    row = with_terms(spark.createDataFrame([(text,)], "text string"), roles=roles).first()
    return {k: row[k] for k in ("raw", *FIELDS, "roles")}


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]::VARCHAR[]"


def terms_sql(table: str, key: str, text: str = "text", name: str = "requests") -> str:
    """CTEs that end in `name`: key, raw and FIELDS of the requests in a table."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    fits = lambda words, p, no="": f"list_filter({words}, lambda w: {no} regexp_matches(w, {quoted(p)}))"
    stripped = lambda words, p: f"list_transform({words}, lambda w: regexp_replace(w, {quoted(p)}, '', 'g'))"
    tidy = lambda x: rf"regexp_replace(regexp_replace(trim({x}), {quoted(EDGES)}, '', 'g'), '\s+', ' ', 'g')"
    pairs = ", ".join(f"list_transform(list_zip(regexp_extract_all(raw, {quoted(p)}, 1), regexp_extract_all(raw, {quoted(p)}, 2)), lambda p: [{tidy('p[1]')}, {tidy('p[2]')}])" for p in OLD_NEW)
    # A set in order: a value stays where it is met first.
    ordered = lambda *lists: f"list_filter(flatten([{', '.join(lists)}]), lambda w, i: w <> '' AND list_position(flatten([{', '.join(lists)}]), w) = i)"
    return rf"""
{name}_raw AS (SELECT {key}, substr(regexp_replace(coalesce({text}, ''), '^\s+|\s+$', '', 'g'), 1, {MOST_CHARS}) AS raw FROM {table}),
{name}_cut AS (SELECT *, list_filter(string_split_regex(raw, {quoted(SEPARATORS)}), lambda t: t <> '') AS terms, {stripped(stripped(rf"string_split_regex(raw, '{BLANKS}')", EDGES), BRACKETS)} AS words,
  list_filter(flatten([{pairs}]), lambda p: p[1] <> '' AND p[2] <> '' AND p[1] <> p[2]) AS pairs FROM {name}_raw),
{name}_named AS (SELECT *, {stripped("terms", EDGES)} AS clean, {ordered("list_transform(pairs, lambda p: p[1])")} AS old, {ordered("list_transform(pairs, lambda p: p[2])")} AS new FROM {name}_cut),
{name}_parts AS (SELECT *, {fits(f"flatten(list_transform({fits('flatten([clean, old, new])', QUALIFIED)}, lambda w: string_split_regex(w, '[.:]+')))", IDENTIFIER)} AS parts FROM {name}_named),
{name}_terms AS (SELECT *, {ordered(f"list_filter(list_transform(flatten([clean, parts]), lambda w: lower(w)), lambda w: length(w) >= {LEAST_LENGTH} AND NOT list_contains({_sql_list(STOP_WORDS)}, w) AND NOT regexp_matches(w, {quoted(EXTENSION)}))")} AS exact,
  {ordered(fits("terms", CONFIG))} AS config, {ordered(fits(fits("flatten([words, terms])", PATH), EXTENSION, "NOT"))} AS path,
  {ordered(fits("terms", SYMBOL), "old", "new", "parts", f"regexp_extract_all(raw, {quoted(TICKED)}, 1)")} AS symbol FROM {name}_parts),
{name} AS (SELECT {key}, raw, exact, config, path, symbol, old, new,
  {ordered(f"list_filter(exact, lambda t: list_contains({_sql_list(DOC_WORDS)}, t) OR contains(lower(raw), t || ' api'))", f"CASE WHEN list_has_any(exact, {_sql_list(TABLE_WORDS)}) THEN ['table', 'row'] ELSE []::VARCHAR[] END")} AS doc,
  {ordered(f"list_filter(exact, lambda t: NOT list_contains({_sql_list(DOC_WORDS)}, t) AND length(t) >= 4 AND NOT list_contains(path, t))", "list_filter(flatten(list_transform(config, lambda c: string_split_regex(lower(regexp_replace(c, '^--', '')), '[_./-]+'))), lambda t: length(t) >= 4)")} AS feature
  FROM {name}_terms)"""
