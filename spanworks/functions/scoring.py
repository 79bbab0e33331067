"""Scores, decisions and confidence, as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Weights of the routes and confidence of the evidence.
ROUTE_WEIGHTS = {
    "code_symbol_name_signature": 8, "fts_lexical": 4, "markdown_heading_anchor_inline_code": 3, "config_cli_env_schema": 3, "old_term_sweep": 3,
    "path_role_expansion": 2, "test_example_import_call": 2, "feature_projection": 2, "cross_reference_edge": 1,
}
EVIDENCE_CONFIDENCE = {
    "explicit_markdown_link": 1.0, "exact_qualified_symbol_inline_code": 0.97, "exact_config_cli_env_mention": 0.95, "test_case_calls_source_symbol": 0.92,
    "example_imports_or_calls_source_symbol": 0.9, "rpg_feature_explicit_map": 0.88, "exact_symbol_name_relevant_heading": 0.82, "path_name_exact_relation": 0.75,
    "call_neighborhood_overlap": 0.68, "fuzzy_heading_symbol_relation": 0.6,
}
LEAST_CONFIDENCE, RRF_CAP, RRF_SHIFT = 0.6, 24, 60


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def weighted_rrf(routes: Column, cap: int = RRF_CAP) -> Column:
    """Of an array of (rank, weight): min(cap, round(sum of 100 * weight / (60 + rank)))."""
    total = F.aggregate(routes, F.lit(0.0), lambda acc, r: acc + r["weight"] * 100.0 / (RRF_SHIFT + r["rank"]))
    return F.least(F.lit(cap), half_up(total).cast("int"))


def route_fusion(names: Column) -> Column:
    """Of an array of route names in the order they were found."""
    weights = F.create_map(*[F.lit(x) for kv in ROUTE_WEIGHTS.items() for x in kv])
    return weighted_rrf(F.transform(names, lambda n, i: F.struct((i + 1).alias("rank"), F.coalesce(F.try_element_at(weights, n), F.lit(1)).alias("weight"))))


def hits(terms: list[str], text: Column, fold: bool = True) -> Column:
    """How many of the terms the text contains."""
    text = F.lower(text) if fold else text
    return sum((text.contains(t.lower() if fold else t).cast("int") for t in terms), F.lit(0))


def exact_term(n: Column) -> Column:
    return F.least(F.lit(20), 5 * n)


def confidence(score: Column) -> Column:
    high = F.greatest(score, F.lit(0)).cast("double")
    return F.when(high == 0, 0.0).otherwise(high / (high + 20))


def decision(score: Column, indexed=None, risk=None, stale=None, is_test=None, old_term=None, evidence=None) -> Column:
    """What to do with a target; flags left out are the harmless ones."""
    flag = lambda x, default: F.lit(default) if x is None else x
    return (
        F.when(~flag(indexed, True), "inspect_only")
        .when((flag(risk, "low") == "high") | flag(stale, False), "inspect_only")
        .when(flag(is_test, False), "verify_only")
        .when(flag(old_term, False), F.when(score >= 70, "must_edit").otherwise("maybe_edit"))
        .when((score >= 85) & (flag(evidence, 1) >= 1), "must_edit")
        .when(score >= 70, "maybe_edit")
        .otherwise("inspect_only")
    )
