"""Checks of whether a change is complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import classify, paths
from ..sources.store import staged
from . import index, spans


def old_term_sweep(rows: DataFrame, terms: list[str]) -> DataFrame:
    """Rows (with a text `line`) beside each of a change's old terms that they contain; case matters. One pass, no join."""
    known = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    return rows.select("*", F.explode(F.filter(known, lambda t: F.col("line").contains(t))).alias("term"))


def missing_targets(links: DataFrame, target: str, paths: DataFrame, path: str) -> DataFrame:
    """Links whose target is no path."""
    return links.join(paths.select(F.col(path).alias("_path")).distinct(), F.col(target) == F.col("_path"), "left_anti")


def doc_severity(changed: Column, policy: str) -> Column:
    """What a document that still has an old term means under a policy; null: nothing."""
    if policy == "strict_global":
        return F.lit("fail")
    return F.when(changed, "fail").otherwise("needs_attention" if policy == "changed_paths_plus_advisory_docs" else None)


def status(hard: Column, soft: Column) -> Column:
    return F.when(hard > 0, "fail").when(soft > 0, "needs_attention").otherwise("pass")


def linked_tests(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(test_id, source_id) of unchanged tests of changed sources: `tests` edges, source changed, test not."""
    of = edges.where("relation = 'tests'").select(F.col("source_id").alias("test_id"), F.col("target_id").alias("source_id")).distinct()
    ids = changed.select(F.col("node").alias("_id")).distinct()
    return of.join(ids, of.source_id == ids._id, "left_semi").join(ids, of.test_id == ids._id, "left_anti")


def required_verification(*sources: DataFrame) -> DataFrame:
    """Union of (path, source, severity), one row for each path and source, of the worst severity."""
    every = sources[0]
    for s in sources[1:]:
        every = every.unionByName(s)
    order = F.when(F.col("severity") == "fail", 0).when(F.col("severity") == "needs_attention", 1).otherwise(2)
    return every.groupBy("path", "source").agg(F.min_by("severity", F.struct(order, "severity")).alias("severity"))


#: Stems of fewer characters are looked for as whole names only.
LEAST_STEM = 8


def likely_tests(sources: DataFrame, tests: DataFrame) -> DataFrame:
    """(source, test): paths of tests (column path) whose name speaks of a source's: a stem of both is the same, or a source's
    stem of LEAST_STEM characters or more is part of a test's, or its whole name up to a dot. Equal stems are an equal
    join; parts are found by n-grams, over distinct stems. A path that is on both sides is no test of itself."""
    tests = staged(tests.select("path").distinct())
    of = lambda rows, name, prefixes: rows.select(F.col("path").alias(name), paths.stem_aliases(F.col("path"), prefixes).alias("stems"))
    ours, named = staged(of(sources, "source", paths.SOURCE_PREFIXES).select("source", F.explode("stems").alias("stem"))), staged(of(tests, "test", paths.TEST_PREFIXES))
    theirs = named.select("test", F.explode("stems").alias("stem"))
    # What lies in a stem that is part of another one lies in that one too.
    whole = named.select("test", F.explode(F.filter("stems", lambda x: ~F.exists("stems", lambda y: (y != x) & y.contains(x)))).alias("word"))
    name = F.lower(classify.basename(F.col("path")))
    dotted = F.transform(F.sequence(F.lit(1), F.size(F.split(name, "[.]"))), lambda i: F.array_join(F.slice(F.split(name, "[.]"), F.lit(1), i), "."))
    fronts = tests.where(name.contains(".")).select(F.col("path").alias("test"), F.explode(F.slice(dotted, F.lit(1), F.size(dotted) - 1)).alias("stem"))
    long = ours.where(F.char_length("stem") >= LEAST_STEM)
    parts = index.containing(long.select("stem").distinct(), "stem", whole.select("word").distinct(), "word", LEAST_STEM)
    # Stems of one name compress well, so by its size on disk Spark would send a table to all that is much larger in memory.
    within = long.join(parts.hint("merge"), "stem").join(whole.hint("merge"), "word")
    found = ours.join(theirs.hint("merge"), "stem").select("source", "test").union(within.select("source", "test")).union(long.join(fronts.hint("merge"), "stem").select("source", "test"))
    return found.where("source <> test").distinct()


def stale_anchors(links: DataFrame, headings: DataFrame) -> DataFrame:
    """links (path, target, fragment) of which the target's headings (path, line_no, label) make no such anchor. Anchors are
    the slugs of headings, numbered from the second of a file on. Empty and null fragments, and links to files that have
    no heading and are not known, are not looked at: headings holds a row with a null label for each known file."""
    known = headings.select("path").distinct()
    slugs = spans.duplicate_slugs(headings.where("label is not null").withColumn("_base", classify.slug(F.col("label"))), "path", "_base", "line_no").select(F.col("path").alias("target"), F.lower("anchor").alias("fragment"))
    wanted = links.where("fragment is not null and fragment <> ''").join(known.withColumnRenamed("path", "target"), "target", "left_semi")
    return wanted.withColumn("_as", F.col("fragment")).withColumn("fragment", F.lower("fragment")).join(slugs.distinct(), ["target", "fragment"], "left_anti").select("path", "target", F.col("_as").alias("fragment"))
