"""Derivations of paths and of names, as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import classify

# Roles by the name of their group; groups of a role; what an import may leave out; text files; heavy folders.
_DOC_ROLES = ["canonical_api_doc", "tutorial_doc", "quickstart_doc", "example_doc", "paper_doc", "experiment_note_doc", "changelog_doc", "design_doc", "readme_doc"]
_CONFIG_ROLES = ["config_file", "schema_file", "package_metadata"]
ROLE_GROUPS = {
    "source": ["source_file"], "code": ["source_file"], "test": ["test_file", "fixture_file"], "tests": ["test_file", "fixture_file"], "fixture": ["fixture_file"],
    "config": _CONFIG_ROLES, "configuration": _CONFIG_ROLES, "doc": _DOC_ROLES, "docs": _DOC_ROLES, "document": _DOC_ROLES, "documentation": _DOC_ROLES,
    "example": ["example_doc"], "examples": ["example_doc"], "feature": ["feature_plan"], "features": ["feature_plan"],
}
IMPORT_ENDS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py"]
TEXT_FILES = [".md", ".mdx", ".rst", ".txt", ".json", ".jsonl", ".yaml", ".yml", ".toml", ".csv", ".sh", ".bash", ".zsh", ".sql", ".css", ".html", ".xml"]
TEST_PREFIXES, SOURCE_PREFIXES = ["test_", "test-", "spec_", "spec-"], ["check_", "check-", "verify_", "verify-", "validate_", "validate-", "run_", "run-"]
STEM_ENDS = [".test", ".spec", "_test", "-test", "_spec", "-spec"]
COLD = [r"(^|/)resources/code/github/", r"(^|/)\.ds/bash_exec/", r"(^|/)experiments/stage[^/]*/.*/runs/", r"(^|/)runs/", r"(?i)\.(jsonl|csv|log)$", r"(?i)(^|/)(checkpoints?|models?|cache|\.cache)/", r"(?i)(^|/)(planning|archive|archives)/"]
BOUNDARY = r"(?i)(^|/)(planning|archive|archives|recommendations?|suggestions?|directions?)/"
KIND_ORDER = ["code.function", "code.method", "code.class", "code.constant", "code.component"]


def trimmed(path: Column) -> Column:
    """With slashes of one kind, none at either end and none doubled."""
    return F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), "/{2,}", "/"), "^/|/$", "")


def role_group(role: Column) -> Column:
    """The group of a role: source, test, config, doc, example or feature; other for those of none."""
    return (
        F.when(role == "source_file", "source").when(role.isin(ROLE_GROUPS["test"]), "test").when(role.isin(_CONFIG_ROLES), "config")
        .when(role == "example_doc", "example").when(role.isin(_DOC_ROLES), "doc").when(role == "feature_plan", "feature").otherwise("other"))


def generated(path: Column) -> Column:
    p = classify.normal_path(path)
    return (classify.layer(path) == "generated") | p.rlike(r"^(dist|build|coverage|__pycache__)/") | p.rlike(r"\.(pyc|pyo)$")


def text_path(path: Column) -> Column:
    """Whether a changed path is read as text."""
    return ~generated(path) & classify.extension(path).isin(*TEXT_FILES, *classify.CODE)


def import_variants(source: Column) -> Column:
    """The paths that an import may mean, the likeliest first."""
    base = F.regexp_replace(F.regexp_replace(F.translate(source, "\\", "/"), "^/+", ""), "/index$", "")
    ends = F.array(*[F.lit(x) for e in IMPORT_ENDS for x in (e, f"/index{e}")])
    return F.when(base.rlike(r"\.[A-Za-z0-9]+$"), F.array(base)).otherwise(F.concat(F.array(base), F.transform(ends, lambda e: F.concat(base, e))))


def structured_tokens(name: Column) -> Column:
    """Parts of at least 3 letters or digits between `_`, `-`, `.` and `:`."""
    return F.filter(F.split(F.lower(name), r"[^\p{L}0-9]+"), lambda t: F.char_length(t) >= 3)


def stem(path: Column) -> Column:
    """The file name without its extension and one ending of a test."""
    name = classify.basename(path)
    bare = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return F.regexp_replace(bare, "(" + "|".join(e.replace(".", r"\.") for e in STEM_ENDS) + ")$", "")


def stem_aliases(path: Column, prefixes: list[str]) -> Column:
    """The stem in lower case, without one or two leading prefixes, and the tails of each from a later word on."""
    start = F.lower(stem(path))
    cut = lambda s: F.regexp_replace(s, "^(" + "|".join(prefixes) + ")(?=..)", "")
    bases = F.array_distinct(F.array(start, cut(start), cut(cut(start))))
    words = lambda s: F.filter(F.split(s, r"[_\-.]+"), lambda w: w != "")
    tails = F.flatten(F.transform(bases, lambda s: F.transform(F.sequence(F.lit(2), F.greatest(F.size(words(s)) - 1, F.lit(2))), lambda i: F.when(i < F.size(words(s)), F.array_join(F.slice(words(s), i, F.size(words(s))), "_")))))
    return F.array_sort(F.array_distinct(F.filter(F.concat(bases, F.array_compact(tails)), lambda s: s != "")))


def cold(path: Column) -> Column:
    p = F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", ""), "^/+", "")
    return p.rlike(COLD[0]) | p.rlike(COLD[1]) | p.rlike(COLD[2]) | p.rlike(COLD[3]) | p.rlike(COLD[4]) | p.rlike(COLD[5]) | p.rlike(COLD[6])


def editable(path: Column) -> Column:
    return ~path.rlike(BOUNDARY)


def kind_order(kind: Column) -> Column:
    """Functions first, then methods, classes, constants, components, all other kinds, modules last."""
    known = F.array_position(F.array(*[F.lit(k) for k in KIND_ORDER]), kind)
    return F.when(kind == "code.module", 7).when(known > 0, known).otherwise(6).cast("int")


def symbol_module(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]+$", "")


def full_name(path: Column, label: Column, qualified: Column) -> Column:
    return F.coalesce(qualified, F.concat_ws(":", path, label))


def symbol_path(full: Column) -> Column:
    return F.split(F.element_at(F.split(full, ":"), -1), r"\.")


def parent_name(full: Column) -> Column:
    """What stands before the last dot of a symbol's own name; null if it has none."""
    return F.nullif(F.regexp_extract(full, r"^(.*:.*)\.[^.:]*$", 1), F.lit(""))
