"""Bounded traces over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..sources.store import staged


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge seen from either end: node, other, relation, confidence."""
    out = edges.select(F.col("source_id").alias("node"), F.col("target_id").alias("other"), "relation", "confidence")
    return out.unionByName(edges.select(F.col("target_id").alias("node"), F.col("source_id").alias("other"), "relation", "confidence"))


def neighbours(edges: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """The edges that touch a seed (column node), best confidence first, `most` of them."""
    ids = seeds.select("node").distinct()
    touched = edges.join(ids, edges.source_id == ids.node, "left_semi").union(edges.join(ids, edges.target_id == ids.node, "left_semi")).distinct()
    return touched.orderBy(F.desc("confidence"), "source_id", "target_id", "relation").limit(most)


def trace(edges: DataFrame, seeds: DataFrame, depth: int = 2, direction: str = "both", relations: list[str] | None = None, frontier: int | None = 250, most_edges: int | None = 1000, most_nodes: int | None = 500) -> DataFrame:
    """(node, hops): nodes within `depth` hops of the seeds, each at its least distance. direction: out, in or both.
    A hop starts from at most `frontier` nodes and follows at most `most_edges` edges, best confidence first (None: all);
    of the nodes at most `most_nodes` are returned, nearest first. One join a hop, of the frontier with the edges."""
    usable = edges if relations is None else edges.where(F.col("relation").isin(relations))
    out = usable.select(F.col("source_id").alias("node"), F.col("target_id").alias("other"), "confidence")
    back = usable.select(F.col("target_id").alias("node"), F.col("source_id").alias("other"), "confidence")
    steps = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    seen = front = seeds.select("node", F.lit(0).cast("long").alias("hops")).distinct()
    for hop in range(1, depth + 1):
        start = front.select("node")
        start = start.orderBy("node").limit(frontier) if frontier else start
        taken = steps.join(start, "node")
        taken = taken.orderBy(F.desc("confidence"), "node", "other").limit(most_edges) if most_edges else taken
        front = taken.select(F.col("other").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hops", F.lit(hop).cast("long"))
        seen = seen.unionByName(front)
    return seen.orderBy("hops", "node").limit(most_nodes) if most_nodes else seen


def adjacency(edges: DataFrame, most: int) -> DataFrame:
    """(node, linked): the `most` best neighbours of each node as text, sorted by confidence, then name."""
    ranked = both_ways(edges).groupBy("node", "other").agg(F.max("confidence").alias("confidence"))
    ranked = ranked.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("confidence"), "other"))).where(F.col("n") <= most)
    return ranked.groupBy("node").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("n", "other"))), lambda x: x["other"])).alias("linked"))


def impact(nodes: DataFrame) -> DataFrame:
    """One row of the traced nodes (role, kind): counts of the six groups and the risk."""
    has = lambda c: F.count_if(c).cast("long")
    role, kind = F.col("role"), F.col("kind")
    return nodes.agg(
        F.count("*").cast("long").alias("nodes"),
        has((role == "source_file") | kind.startswith("code.")).alias("code"), has(role.endswith("_doc") | kind.startswith("doc.")).alias("docs"),
        has((role == "config_file") | kind.startswith("config.")).alias("config"), has((role == "test_file") | kind.startswith("test.")).alias("tests"),
        has((role == "example_doc") | kind.startswith("example.")).alias("examples"), has(kind.startswith("feature.")).alias("features"),
        F.when(F.count("*") >= 20, "high").when(F.count("*") >= 6, "medium").otherwise("low").alias("risk"))


def impact_paths(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(node, hops, path, strength): how each node within `depth` hops of the seeds (column node) is reached first, edges
    followed both ways. path lists the nodes from a seed on; strength is the product of the confidences. Of ways with the
    fewest hops the strongest last edge wins, then the smaller node before. edges are read once a hop and may repeat: only what
    touches the nodes of the last hop is grouped."""
    steps = both_ways(edges).select("node", "other", "confidence")  # a loop only leads to what is seen
    front = seeds.select("node").distinct().select("node", F.lit(0).cast("long").alias("hops"), F.array("node").alias("path"), F.lit(1.0).alias("strength"))
    seen = front = staged(front)
    for hop in range(1, depth + 1):
        reached = steps.join(front, "node").select(F.col("other").alias("to"), F.struct((-F.col("confidence")).alias("weak"), F.col("node").alias("by"), "path", "strength").alias("way"))
        best = reached.where("to is not null").groupBy("to").agg(F.min("way").alias("way")).join(seen.select(F.col("node").alias("to")), "to", "left_anti")
        front = staged(best.select(F.col("to").alias("node"), F.lit(hop).cast("long").alias("hops"), F.concat("way.path", F.array("to")).alias("path"), (F.col("way.strength") * -F.col("way.weak")).alias("strength")))
        seen = seen.unionByName(front)
    return seen


def resolved_seeds(targets: DataFrame, spans: DataFrame, most: int = 80) -> DataFrame:
    """(target, node) of what requests name (target, type): a span by its id, a file by its path, a symbol by the label of its
    code, `auto` by any of these; the first `most` of each, a file's spans by line. One equal join a kind of name."""
    names = [("span", "span_id", F.lit(True)), ("file", "path", F.lit(True)), ("symbol", "label", F.col("kind").startswith("code."))]
    found = None
    for order, (kind, column, holds) in enumerate(names):
        rows = targets.where(F.col("type").isin(kind, "auto")).join(spans.where(holds), F.col("target") == F.col(column)).select("target", F.col("span_id").alias("node"), F.lit(order).alias("_order"), "path", "start_line")
        found = rows if found is None else found.union(rows)
    rank = F.row_number().over(Window.partitionBy("target").orderBy("_order", "path", "start_line", "node"))
    firsts = found.groupBy("target", "node").agg(*[F.min(c).alias(c) for c in ("_order", "path", "start_line")])
    return firsts.withColumn("_n", rank).where(F.col("_n") <= most).select("target", "node")


def grouped_impact(reached: DataFrame, group: str, most: int = 25) -> DataFrame:
    """The `most` nearest nodes of each group, by hops, strength and name, with their place in it."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy("hops", F.desc("strength"), "node"))
    return reached.withColumn("place", rank.cast("long")).where(F.col("place") <= most)
