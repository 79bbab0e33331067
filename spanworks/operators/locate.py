"""Where a batch of change requests has to look: routes to candidate spans, their boundaries, scores and decisions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import classify, paths, ranking
from ..sources.corpus import SEARCHED
from ..sources.store import staged
from . import index

#: The most terms of a request that routes look for, and spans from which edges are followed.
MOST_TERMS, MOST_SEEDS, LEAST_CONFIDENCE = 24, 250, 0.6


@dataclass(frozen=True)
class Limits:
    """The most candidates that a route takes for one term, and that a request has in all (more, if it names a path)."""

    symbols: int = 80
    labels: int = 50
    exact_paths: int = 700
    paths: int = 100
    roles: int = 50
    words: int = 100
    edges: int = 1000
    spans: int = 400
    spans_of_paths: int = 800
    targets: int = 20


# What a boundary is warned of, in order, and which of that makes it a high risk.
WARNINGS = [
    ("file ignored", "ignored", True), ("generated file not explicitly requested", "generated", True), ("vendor file not explicitly requested", "vendor", True), ("invalid line range", "invalid", True),
    ("line range outside current file", "outside", True), ("file content hash differs from index", "stale", False), ("candidate lacks linked evidence", "bare", False)]


def boundary(flags: dict[str, Column]) -> Column:
    """struct(ok, stale, risk, warnings) of a candidate by its flags (names as in WARNINGS); those left out are false."""
    given = [(text, F.coalesce(flags[name], F.lit(False)), high) for text, name, high in WARNINGS if name in flags]
    warnings = F.array_compact(F.array(*[F.when(holds, text) for text, holds, _ in given]).cast("array<string>"))
    high = F.lit(False)
    for _, holds, is_high in given:
        high = high | holds if is_high else high
    stale = F.coalesce(flags.get("stale", F.lit(False)), F.lit(False))
    ok = (F.size(warnings) == 0) | ((F.size(warnings) == 1) & stale)
    return F.struct(ok.alias("ok"), stale.alias("stale"), F.when(high, "high").when(stale, "medium").otherwise("low").alias("risk"), warnings.alias("warnings"))


def _named_path(term: Column) -> Column:
    return term.contains("/") | term.rlike(r"\.[A-Za-z0-9]+$")


def searches(requests: DataFrame, key: str) -> DataFrame:
    """(key, field, ordinal, term) of what the routes look for: `symbol`, `path`, `role` and `word` terms, each in order."""
    every = F.array_distinct(F.concat("path", "symbol", "config", "old", "exact", "feature"))
    words = F.slice(F.filter(every, lambda t: F.char_length(F.trim(t)) >= 2), 1, MOST_TERMS)
    in_paths = F.array_distinct(F.concat("path", F.filter(words, lambda t: t.contains(".") | t.contains("/") | t.contains("_"))))
    lists = F.array(*[F.struct(F.lit(name).alias("field"), of.alias("terms")) for name, of in (("symbol", F.col("symbol")), ("path", in_paths), ("role", F.col("roles")), ("word", words))])
    return requests.select(key, F.inline(lists)).select(key, "field", F.posexplode("terms").alias("ordinal", "term"))


def routes(spans: DataFrame, wanted: DataFrame, key: str, limits: Limits = Limits()) -> DataFrame:
    """(key, span_id, step, ordinal, part, rank, route): the spans that each term of each request is routed to, the best ones
    by that route's order. A term that many requests share is looked up once."""
    term = lambda field: wanted.where(F.col("field") == field).select(F.lower("term").alias("low"), "term").distinct()
    place = spans.select("span_id", "path", "kind", "label", "start_line")

    def best(found: DataFrame, by: str, most: Column | int, *order) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(by).orderBy(*order, "path", "start_line", "span_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= most).select(by, "span_id", "rank")

    def routed(found: DataFrame, field: str, by: str, step: int, part: int, route: str) -> DataFrame:
        asked = wanted.where(F.col("field") == field).select(key, "ordinal", (F.lower("term") if by == "low" else F.col("term")).alias(by))
        return asked.join(found, by).select(key, "span_id", F.lit(step).alias("step"), "ordinal", F.lit(part).alias("part"), "rank", F.lit(route).alias("route"))

    code = spans.where(F.col("kind").startswith("code."))
    labels = code.join(term("symbol"), F.col("label") == F.col("term")).select("term", "span_id")
    held = index.like_hits(code, "span_id", ["symbol_path", "metadata"], term("symbol").select("low"), "low").join(term("symbol"), "low").select("term", "span_id")
    # What is found is written, so that Spark knows how few spans it needs of all.
    symbols = staged(labels.union(held).distinct()).join(place, "span_id")
    symbols = best(symbols, "term", limits.labels, F.when(F.col("label") == F.col("term"), 0).otherwise(1), paths.kind_order(F.col("kind")), F.char_length("path"))
    in_path = staged(index.like_hits(spans.select("path").distinct(), "path", ["path"], term("path").select("low"), "low")).join(place.select("span_id", "path", "start_line"), "path")
    fit = F.when(F.lower("path") == F.col("low"), 0).when(F.endswith(F.lower("path"), F.concat(F.lit("/"), F.col("low"))), 1).otherwise(2)
    in_path = best(in_path, "low", F.when(_named_path(F.col("low")), limits.exact_paths).otherwise(limits.paths), fit, F.char_length("path"))
    roles = best(spans.select("span_id", "path", "start_line", F.col("role").alias("term")).join(term("role").select("term"), "term"), "term", limits.roles)
    words = staged(term("word").select("low").distinct())
    # Spans stand in one order for all words, so hits carry their place and are ranked where they are found: a task passes on
    # the first ones of each word alone. A span has one rank, however often it is found. Parts of words are looked up no
    # further than the first ones can lie.
    at = F.col("at") if "at" in spans.columns else F.lit(0).cast("long")
    placed = spans.select(F.struct("path", "start_line", "span_id").alias("spot"), at.alias("at"), *SEARCHED)
    single, several = (words.where(n) for n in (F.size(index.tokens(F.col("low"))) == 1, F.size(index.tokens(F.col("low"))) > 1))
    phrases = index.word_hits(placed, "spot", SEARCHED, single, "low", index.tokens(F.col("low"))[0])
    if several.limit(1).count():
        phrases = phrases.union(index.phrase_hits(index.postings(placed, "spot", SEARCHED), "spot", several, "low", index.tokens(F.col("low"))).select("low", "spot"))
    nth = F.dense_rank().over(Window.partitionBy("low").orderBy("spot.path", "spot.start_line", "spot.span_id"))
    ranked = lambda found: found.withColumn("rank", nth).where(F.col("rank") <= limits.words).select("low", "spot.span_id", "rank").distinct()
    alone = index.tokens(F.col("low"), index.RUN) == F.array("low")
    whole, mixed = words.where(alone), words.where(~alone)
    parts = index.first_like_hits(placed, "spot", "at", F.col("path"), SEARCHED, whole, "low", limits.words).select("low", "spot.span_id", "rank")
    if mixed.limit(1).count():
        parts = parts.union(ranked(index.like_hits(placed, "spot", SEARCHED, mixed, "low", once=False)))
    lexical = [ranked(phrases), parts]
    return (
        routed(symbols, "symbol", "term", 1, 0, "code_symbol_name_signature").union(routed(in_path, "path", "low", 2, 0, "path_role_expansion")).union(routed(roles, "role", "term", 3, 0, "path_role_expansion"))
        .union(routed(lexical[0], "word", "low", 4, 0, "fts_lexical")).union(routed(lexical[1], "word", "low", 4, 1, "fts_lexical")))


def capped(found: DataFrame, key: str, most: DataFrame) -> DataFrame:
    """(key, span_id, place, found): each span of a request once, where it was met first, the first ones up to the request's
    cap (most: key, cap); found holds its routes with the step that met it first. A request has at most the sum of the
    routes' limits, which bounds the window."""
    firsts = found.groupBy(key, "span_id", "route").agg(F.min(F.struct("step", "ordinal", "part", "rank")).alias("first"))
    each = firsts.groupBy(key, "span_id").agg(F.min("first").alias("first"), F.collect_list(F.struct(F.col("first.step").alias("step"), "route")).alias("found"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("first", "span_id"))
    return each.withColumn("place", place).join(most, key).where("place <= cap").select(key, "span_id", "place", "found")


def propagated(spans: DataFrame, edges: DataFrame, key: str, most: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The capped spans of requests, with what the surest edges of the first of them lead to, up to the cap; every end of
    those edges is on the route `cross_reference_edge`."""
    sure = edges.where(F.col("confidence") >= LEAST_CONFIDENCE).select("source_id", "target_id", "confidence")
    ends = sure.select(F.col("source_id").alias("span_id"), "*").union(sure.select(F.col("target_id").alias("span_id"), "*"))
    near = spans.where(F.col("place") <= MOST_SEEDS).select(key, "span_id").join(ends, "span_id").select(key, "source_id", "target_id", "confidence").distinct()
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("confidence"), "source_id", "target_id"))
    near = near.withColumn("rank", rank).where(F.col("rank") <= limits.edges)
    route = F.lit("cross_reference_edge")
    both = near.select(key, F.explode(F.array(F.struct(F.col("source_id").alias("span_id"), F.lit(0).alias("part")), F.struct(F.col("target_id").alias("span_id"), F.lit(1).alias("part")))).alias("end"), "rank")
    reached = both.select(key, "end.span_id", F.lit(5).alias("step"), F.col("rank").alias("ordinal"), "end.part", F.lit(0).alias("rank"), route.alias("route"))
    before = spans.select(key, "span_id", F.lit(0).alias("step"), F.col("place").alias("ordinal"), F.lit(0).alias("part"), F.lit(0).alias("rank"), F.explode("found").alias("f"))
    first = capped(before.select(key, "span_id", "step", "ordinal", "part", "rank", F.lit("").alias("route")).union(reached.select(key, "span_id", "step", "ordinal", "part", "rank", F.lit("").alias("route"))), key, most)
    found = before.select(key, "span_id", "f.step", "f.route").union(reached.select(key, "span_id", "step", "route").distinct())
    return first.select(key, "span_id", "place").join(found.groupBy(key, "span_id").agg(F.collect_list(F.struct("step", "route")).alias("found")), [key, "span_id"])


def own_routes() -> Column:
    """The routes on which a candidate's kind, role and text put it, in order, whatever route found it."""
    low, shown = F.col("_low"), F.col("_shown")
    kind, role, any_of, lowered = F.col("kind"), F.col("role"), ranking.any_of, ranking.lowered
    hit = any_of(lowered(F.concat("exact", "symbol", "feature")), low)
    wanted = F.array_contains("roles", role)
    tests = [
        ("fts_lexical", any_of(lowered(F.col("exact")), low)), ("code_symbol_name_signature", kind.startswith("code.") & any_of(F.col("symbol"), shown)),
        ("markdown_heading_anchor_inline_code", kind.startswith("doc.") & any_of(lowered(F.concat("doc", "symbol", "feature")), low)),
        ("config_cli_env_schema", (kind.startswith("config.") | role.isin("config_file", "schema_file", "package_metadata")) & any_of(F.col("config"), shown)),
        ("test_example_import_call", (kind.startswith("test.") | kind.startswith("example.") | role.isin("test_file", "example_doc")) & hit),
        ("feature_projection", (kind.startswith("feature.") | (role == "feature_plan")) & any_of(lowered(F.col("feature")), low)),
        ("path_role_expansion", (F.size("roles") > 0) & (any_of(F.col("path_terms"), F.col("path")) | (wanted & hit))), ("old_term_sweep", any_of(F.col("old"), shown))]
    return F.array_compact(F.array(*[F.when(holds, name) for name, holds in tests]))


def candidates(spans: DataFrame, edges: DataFrame, requests: DataFrame, key: str, limits: Limits = Limits(), current: DataFrame | None = None) -> DataFrame:
    """The candidate spans of requests (key and their terms), each with its request's terms, routes, evidence, linked (the
    best confidence of an edge), boundary and flags. current: (path, lines, changed) of files as they are now."""
    cap = F.when(F.exists("path", _named_path), limits.spans_of_paths).otherwise(limits.spans)
    most = requests.select(key, cap.alias("cap"))
    taken = staged(capped(staged(routes(spans, searches(requests, key), key, limits)), key, most))
    found = staged(propagated(taken, edges, key, most, limits))
    sure = edges.groupBy(F.col("source_id").alias("span_id")).agg(F.max("confidence").alias("c")).union(edges.groupBy("target_id").agg(F.max("confidence")))
    rows = index.reduced(spans, F.col("span_id"), found, F.col("span_id")).join(found, "span_id")
    # Edges of the candidates alone: the best of all edges is not needed.
    linked = sure.join(found.select("span_id").distinct(), "span_id", "left_semi").groupBy("span_id").agg(F.max("c").alias("linked"))
    rows = rows.join(linked, "span_id", "left").join(requests.withColumnRenamed("path", "path_terms"), key)
    if current is not None:
        rows = rows.join(current, "path", "left")
    few = lambda terms, text: F.least(ranking.hits(ranking.lowered(F.col(terms)), F.col(text)), F.lit(5))
    texts = {"_shown": F.concat_ws("\n", *SEARCHED), "_symbol": F.lower(F.concat_ws("\n", "label", "text", "symbol_path")), "_config": F.lower(F.concat_ws("\n", "label", "text", "metadata"))}
    rows = rows.withColumns(texts | {"_low": F.lower(texts["_shown"])})
    evidence = few("exact", "_low") + few("symbol", "_symbol") + few("config", "_config")
    ordered = F.transform(F.array_sort("found"), lambda f: f["route"])
    rows = rows.withColumns({"routes": F.array_distinct(F.concat(ordered, own_routes())), "evidence": evidence, "covers": F.lit(True)}).drop(*texts, "_low")
    flags = {
        "generated": F.col("role") == "generated_file", "vendor": F.col("role") == "vendor_file", "invalid": (F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")),
        "bare": (F.col("evidence") == 0) & F.col("linked").isNull()}
    if current is not None:
        flags |= {"outside": F.col("end_line") > F.col("lines"), "stale": F.col("changed")}
    rows = rows.withColumn("boundary", boundary(flags))
    return rows.withColumns({"risk": F.col("boundary.risk"), "stale": F.col("boundary.stale")})


def ranked(rows: DataFrame, key: str) -> DataFrame:
    """Candidates with all components of their scores, score, confidence and decision."""
    request = {k: F.col(k) for k in ("raw", "exact", "config", "symbol", "doc", "feature", "roles")} | {"path": F.col("path_terms")}
    return ranking.ranked(rows, request)


def targets(rows: DataFrame, key: str, limits: Limits = Limits()) -> DataFrame:
    """Of ranked candidates the best of each request, with their rank: business paths or those it names; the best span of
    each path, unless the request names a path."""
    request = {"path": F.col("path_terms")}
    usable = rows.where(classify.layer(F.col("path")).isin("business") | ranking.exact_path(F.col("path"), request))
    order = [F.desc("score"), F.desc("kind_precision"), "path", "start_line", "span_id"]
    usable = usable.withColumn("_nth", F.row_number().over(Window.partitionBy(key, "path").orderBy(*order)))
    usable = usable.where((F.col("_nth") == 1) | F.exists("path_terms", _named_path)).drop("_nth")
    best = usable.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return best.where(F.col("rank") <= limits.targets)


def coverage_plan(chosen: DataFrame, requests: DataFrame, key: str, most: int = 50) -> DataFrame:
    """Per request: sweeps (terms to look for once more), roles (of its targets, those it asked for if any is there), docs and
    tests (paths, the first `most`), docs_omitted, tests_omitted, and missing (roles it asked for that no target has)."""
    business = classify.layer(F.col("path")) == "business"
    docs, tests = F.col("role").isin([r for r in paths.ROLE_GROUPS["docs"] if r != "experiment_note_doc"]) & business, (F.col("role") == "test_file") & business
    each = chosen.groupBy(key).agg(
        F.array_sort(F.collect_set("role")).alias("present"), F.array_sort(F.collect_set(F.when(docs, F.col("path")))).alias("every_doc"), F.array_sort(F.collect_set(F.when(tests, F.col("path")))).alias("every_test"))
    none = F.array().cast("array<string>")
    rows = requests.join(each, key, "left").withColumns({c: F.coalesce(c, none) for c in ("present", "every_doc", "every_test")})
    asked = F.array_sort(F.array_intersect("roles", "present"))
    cut = lambda c: F.slice(c, 1, most)
    return rows.select(
        key, F.array_distinct(F.concat("old", "new", "symbol", "config")).alias("sweeps"), F.when(F.size(asked) > 0, asked).otherwise(F.col("present")).alias("roles"), cut("every_doc").alias("docs"), cut("every_test").alias("tests"),
        F.greatest(F.size("every_doc") - most, F.lit(0)).alias("docs_omitted"), F.greatest(F.size("every_test") - most, F.lit(0)).alias("tests_omitted"), F.array_sort(F.array_except("roles", "present")).alias("missing"))


def evidence_bundle(rows: DataFrame, edges: DataFrame, key: str, most: int = 3) -> DataFrame:
    """(key, span_id, routes, evidence, linked, risk, stale, warnings, redacted) of candidates: the first `most` terms that they hold,
    by kind (text, symbol, config), and their surest links. Links are ranked for the candidates alone, and cut before they
    are shuffled."""
    held = lambda kind, terms, text: F.transform(F.slice(F.filter(F.col(terms), lambda t: F.lower(text).contains(F.lower(t))), 1, 5), lambda t: F.concat(F.lit(kind + ":"), t))
    texts = F.concat_ws("\n", *SEARCHED), F.concat_ws("\n", "label", "text", "symbol_path"), F.concat_ws("\n", "label", "text", "metadata")
    found = F.concat(held("direct_text_match", "exact", texts[0]), held("symbol_match", "symbol", texts[1]), held("config_match", "config", texts[2]))
    ids = rows.select(F.col("span_id").alias("node")).distinct()
    ends = edges.select(F.col("source_id").alias("node"), F.col("target_id").alias("other"), "confidence").union(edges.select("target_id", "source_id", "confidence")).join(ids, "node", "left_semi")
    best = ends.distinct().withColumn("_n", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("confidence"), "other"))).where(F.col("_n") <= most)
    linked = best.groupBy(F.col("node").alias("span_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "other"))), lambda x: x["other"]).alias("linked_spans"))
    return rows.join(linked, "span_id", "left").select(
        key, "span_id", "routes", F.slice(found, 1, most).alias("evidence"), F.coalesce("linked_spans", F.array().cast("array<string>")).alias("linked"), "risk", "stale", F.size("boundary.warnings").alias("warnings"), "redacted")


def from_inventory(requests: DataFrame, files: DataFrame, key: str, most: int = 250) -> DataFrame:
    """(key, path, rank): the files (path, role, language) that requests fit by path, role or language: what is left to answer
    with where there are no spans, and what of an inventory has none. Files with a path term come first, then shorter
    paths; `most` of a request."""
    wanted = searches(requests, key).where("field <> 'role'").select(key, F.lower("term").alias("low")).distinct()
    rows = files.withColumn("_where", F.concat_ws("\n", "path", "role", "language"))
    hits = index.like_hits(rows, "path", ["_where"], wanted.select("low").distinct(), "low").join(wanted, "low")
    by_role = searches(requests, key).where("field = 'role'").select(key, F.col("term").alias("role")).join(files.select("path", "role"), "role").select(key, "path")
    each = hits.select(key, "path", F.lower("path").contains(F.col("low")).alias("_in")).union(by_role.select(key, "path", F.lit(False))).groupBy(key, "path").agg(F.max("_in").alias("_in"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_in"), F.char_length("path"), "path"))
    return each.withColumn("rank", rank).where(F.col("rank") <= most).select(key, "path", "rank")
