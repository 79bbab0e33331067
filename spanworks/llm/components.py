"""Distributed connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, staged


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node that has an edge to another node; component is the smallest node reachable.

    Alternates large-star and small-star steps, each a grouped minimum (combined before the shuffle) and a join by node
    (which AQE splits where a hub is hot), until the edge set stops changing: some ten rounds even for long chains.
    Each round is written to the shared folder. Null ends, loops and repeated edges are ignored; no edges: no rows.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("_a"), F.col(b).alias("_b"))
    now = staged(now.where("_a is not null and _b is not null and u <> v").select("u", "v").distinct())
    state = _state(now)
    while state[0]:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        last, now = now, staged(small.distinct())
        discard(last, large)
        before, state = state, _state(now)
        if before == state:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
