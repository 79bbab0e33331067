"""Approximate nearest neighbours by stable projections and kd-trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import discard, staged

#: Projected dimensions at most (at most half of the vectors', and even, for the closed form of the chi-square law), rows
#: of a cell, rows of a tree's leaf, rows the planes are cut by, queries that are searched together.
PROJECTED, CELL_ROWS, LEAF_ROWS, SAMPLE_ROWS, QUERY_ROWS = 32, 8192, 256, 20_000, 8192
#: Norm classes of an octave.
NORM_CLASSES = 4


def chi_square(x: np.ndarray, degrees: int) -> np.ndarray:
    """The chi-square distribution function for an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 0.0
    for i in range(degrees // 2):
        total = total + term
        term = term * half / (i + 1)
    return 1.0 - np.exp(-half) * total


def chi_square_bound(sure: float, degrees: int) -> float:
    """Where the chi-square distribution function reaches `sure`."""
    low, high = 0.0, 10.0 * degrees + 200
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < sure else (low, middle)
    return high


def projection(dims: int, seed: int = 7) -> np.ndarray:
    """A 2-stable projection to m dimensions: a Gaussian one, made orthogonal and as long as before, so that the squared
    projected distance over the squared distance has a mean of m and less spread than chi-square of m degrees. The test
    that reads it as chi-square errs on the safe side."""
    m = max(2, min(PROJECTED, dims // 2) // 2 * 2)
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((max(dims, m), m)))[0][:dims] * np.sqrt(dims)


def lifted(vectors: np.ndarray, norm: float | np.ndarray) -> np.ndarray:
    """Vectors over `norm`, with one more component that brings each to length 1: nearest in distance is then largest in
    inner product, for any query of length 1 whose own further component is 0."""
    scaled = vectors / np.reshape(norm, (-1, 1))
    rest = np.sqrt(np.maximum(1.0 - np.einsum("ij,ij->i", scaled, scaled), 0.0))
    return np.column_stack((scaled, rest))


def asked_points(vectors: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Projections of queries at length 1, and their lengths."""
    length = np.linalg.norm(vectors, axis=1)
    return np.column_stack((vectors / length[:, None], np.zeros(len(vectors)))) @ basis, length


def split_leaves(points: np.ndarray, rows: int) -> list[np.ndarray]:
    """Row numbers of the leaves of a kd-tree: halves at the median of the widest axis down to `rows` rows."""
    leaves, open_ = [], [np.arange(len(points))]
    while open_:
        at = open_.pop()
        if len(at) <= rows:
            leaves.append(at)
            continue
        axis = int(np.argmax(np.ptp(points[at], axis=0)))
        half = len(at) // 2
        order = np.argpartition(points[at, axis], half)
        open_ += [at[order[:half]], at[order[half:]]]
    return leaves


def planes(sample: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
    """The top of the kd-tree, from a bounded sample: (axis, value, low, high) by node, children -1 - c for cell c."""
    nodes: list = []
    cell = [0]

    def grow(at: np.ndarray, n: int) -> int:
        axis = int(np.argmax(np.ptp(sample[at], axis=0))) if len(at) else 0
        value = float(np.median(sample[at, axis])) if len(at) else 0.0
        low = sample[at, axis] < value if len(at) else np.zeros(0, bool)
        if n <= 1 or not low.any() or low.all():
            cell[0] += 1
            return -cell[0]
        me = len(nodes)
        nodes.append(None)
        nodes[me] = (axis, value, grow(at[low], n // 2), grow(at[~low], n - n // 2))
        return me

    grow(np.arange(len(sample)), cells)
    return nodes


def cell_of(points: np.ndarray, nodes: list) -> np.ndarray:
    out = np.zeros(len(points), np.int64)
    if nodes:
        stack = [(0, np.arange(len(points)))]
        while stack:
            node, at = stack.pop()
            if node < 0:
                out[at] = -1 - node
            elif len(at):
                axis, value, low, high = nodes[node]
                below = points[at, axis] < value
                stack += [(low, at[below]), (high, at[~below])]
    return out


def cell_boxes(nodes: list, dims: int) -> np.ndarray:
    """(cells, 2, dims): the half-open boxes that the planes cut, so that the bounds hold for every row."""
    whole = np.stack((np.full(dims, -np.inf), np.full(dims, np.inf)))
    if not nodes:
        return whole[None]
    boxes, stack = {}, [(0, whole)]
    while stack:
        node, box = stack.pop()
        if node < 0:
            boxes[-1 - node] = box
            continue
        axis, value, low, high = nodes[node]
        under, over = box.copy(), box.copy()
        under[1, axis] = over[0, axis] = value
        stack += [(low, under), (high, over)]
    return np.stack([boxes[i] for i in range(len(boxes))])


def box_distance(points: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes (rows, boxes)."""
    out = np.zeros((len(points), len(boxes)))
    for d in range(points.shape[1]):
        x = points[:, d, None]
        gap = np.maximum(np.maximum(boxes[None, :, 0, d] - x, x - boxes[None, :, 1, d]), 0.0)
        out += gap * gap
    return out


def reach(floor: np.ndarray, length: np.ndarray, norm: float | np.ndarray, bound: float) -> np.ndarray:
    """The stopping test: a candidate of an inner product of `floor` or more is within a squared distance r of the query,
    both at length 1, so with the probability of `bound` its squared projected distance is at most bound * r. Below 0 if
    no candidate of that norm can have such a product; infinite for a floor of minus infinity."""
    return bound * (2.0 - 2.0 * floor / (length * norm))


def search_cell(asked: np.ndarray, floor: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, norm: float, bound: float, basis: np.ndarray):
    """(query, class_id, score, verified) of the best k of a cell for each query: candidates are verified on the original
    vectors by projected distance, some and then more, until the stopping test holds for the next one and the k-th product
    so far (or `floor`, one known before). Leaves of the cell's kd-tree that the test rules out are not looked at."""
    points = lifted(vectors, norm) @ basis
    squares = np.einsum("ij,ij->i", points, points)
    leaves = split_leaves(points, LEAF_ROWS)
    boxes = np.stack([np.stack((points[x].min(axis=0), points[x].max(axis=0))) for x in leaves])
    at_query, length = asked_points(asked, basis)
    out = []
    for q0 in range(0, len(asked), 128):
        q = slice(q0, q0 + 128)
        mine, most = asked[q], reach(floor[q], length[q], norm, bound)
        open_ = np.flatnonzero((box_distance(at_query[q], boxes) <= most[:, None]).any(axis=0))
        if not len(open_):
            continue
        rows = np.concatenate([leaves[i] for i in open_])
        far = squares[rows] + np.einsum("ij,ij->i", at_query[q], at_query[q])[:, None] - 2.0 * (at_query[q] @ points[rows].T)
        best_score, best_id = np.full((len(mine), k), -np.inf), np.full((len(mine), k), np.iinfo(np.int64).max)
        seen, verified = np.full(len(mine), -np.inf), np.zeros(len(mine), np.int64)
        for step in (4 * k, 12 * k, 36 * k, len(rows)):
            step = min(step, len(rows))
            until = np.partition(far, step - 1, axis=1)[:, step - 1] if step < len(rows) else np.full(len(mine), np.inf)
            until = np.maximum(np.minimum(until, most), seen)
            who, which = np.nonzero((far > seen[:, None]) & (far <= until[:, None]))
            verified += np.bincount(who, minlength=len(mine))
            for part in range(0, len(who), 200_000):
                w, c = who[part : part + 200_000], rows[which[part : part + 200_000]]
                score = np.einsum("ij,ij->i", vectors[c], mine[w])
                better = score >= best_score[w, -1]
                w, c, score = w[better], c[better], score[better]
                touched = np.unique(w)
                all_w, all_s, all_i = np.r_[np.repeat(touched, k), w], np.r_[best_score[touched].ravel(), score], np.r_[best_id[touched].ravel(), ids[c]]
                order = np.lexsort((all_i, -all_s, all_w))
                all_w, all_s, all_i = all_w[order], all_s[order], all_i[order]
                place = np.arange(len(all_w)) - np.searchsorted(all_w, all_w)
                top = place < k
                best_score[all_w[top], place[top]], best_id[all_w[top], place[top]] = all_s[top], all_i[top]
            seen = until
            most = np.minimum(most, reach(best_score[:, -1], length[q], norm, bound))
            if step == len(rows):
                break
        found = np.isfinite(best_score)
        who = np.nonzero(found)[0]
        count = np.zeros(len(who), np.int64)
        count[np.r_[True, who[1:] != who[:-1]]] = verified[np.unique(who)] if len(who) else 0  # once for each query
        out.append((who + q0, best_id[found], best_score[found], count))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))


def searchable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector double array) of the rows that take part: a vec_id and a vector, finite and not all zero."""
    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector")).where(
        "vec_id is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x <> 0)")


RESULT = "query_id long, rank int, vec_id long, score double, verified long"


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, sure: float = 0.78, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score, verified): the k nearest by inner product of each vector whose vec_id is divisible
    by `every`, against all rows but its own; ties go to the smaller vec_id. verified is how many different vectors were
    compared with the query in full.

    Equal vectors form a class: a class is searched and found once, and at most its k + 1 smallest vec_ids can be among
    anyone's k nearest, so no group of equal vectors weighs on a task. Classes are sorted by norm (four to an octave) and,
    at length 1, projected and dealt to the cells of a kd-tree whose planes come from a sample of at most SAMPLE_ROWS
    classes; a cell of more rows than meant is dealt on by hash, and so are its queries. A query first searches its own
    cell, then with that k-th product every other cell that the chi-square test doesn't rule out. `sure` is the
    probability with which the test lets a candidate in that belongs among the k.
    Vectors null, zero, or with null or non-finite components take no part. Vectors of different lengths are not compared:
    each length is a search of its own. Rows that repeat a vec_id are rows of their own, as queries and as candidates. No
    query or one row: no rows. Other columns are not read.
    """
    clean = staged(searchable(vectors))
    found = clean.sparkSession.createDataFrame([], RESULT)
    for row in clean.select(F.size("vector").alias("n")).distinct().orderBy("n").collect():
        found = found.union(_nearest(clean.where(F.size("vector") == row.n), row.n, k, every, sure, cell_rows))
    return found


def _nearest(clean: DataFrame, dims: int, k: int, every: int, sure: float, cell_rows: int) -> DataFrame:
    ranked = clean.withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    smallest = ranked.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    classes = staged(smallest.select(F.xxhash64("vector").alias("class_id"), "vector", "ids", F.floor(F.log2(norm) * NORM_CLASSES + 0.5).cast("int").alias("band"), norm.alias("norm")))
    norms = {r.band: float(r.norm) for r in classes.groupBy("band").agg(F.max("norm").alias("norm")).collect()}  # bounded: bands of all doubles
    total, bands = classes.count(), sorted(norms)
    basis, band_norms = projection(dims + 1), np.array([norms[b] for b in bands])
    bound = chi_square_bound(sure, basis.shape[1])
    sample = classes.select("vector", "norm").orderBy("class_id").limit(SAMPLE_ROWS).collect()
    nodes = planes(lifted(np.array([r.vector for r in sample]), np.array([r.norm for r in sample])) @ basis, max(1, -(-total // cell_rows)))
    boxes = cell_boxes(nodes, basis.shape[1])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                of = np.array([norms[x] for x in b["band"]])
                yield b.assign(cell=cell_of(lifted(np.stack(b["vector"].to_list()), of) @ basis, nodes)).drop(columns="norm")

    placed = classes.select("class_id", "vector", "band", "norm").mapInPandas(place, "class_id long, vector array<double>, band int, cell long")
    held = staged(placed)
    parts = held.groupBy("band", "cell").agg(F.ceil(F.count("*") / (2 * cell_rows)).cast("int").alias("parts"))
    placed = staged(held.join(parts, ["band", "cell"]).withColumn("part", F.pmod(F.xxhash64("class_id", F.lit(1)), "parts").cast("int")))
    queries = staged(clean.where(F.col("vec_id") % every == 0).join(classes.select("class_id", "vector"), "vector").select(F.col("class_id").alias("query_class"), "vec_id"))
    searched = staged(held.join(queries.select(F.col("query_class").alias("class_id")).distinct(), "class_id", "left_semi"))
    schema = "query_class long, class_id long, score double, verified long"

    def search(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_class": [], "class_id": [], "score": [], "verified": []}).astype({"query_class": "int64", "class_id": "int64", "score": "float64", "verified": "int64"})
        if not len(left) or not len(right):
            return empty
        asked, rows = np.stack(left["vector"].to_list()).astype(float), np.stack(right["vector"].to_list()).astype(float)
        q, c, s, v = search_cell(asked, left["floor"].to_numpy(dtype=float), rows, right["class_id"].to_numpy(), k + 1, norms[key[0]], bound, basis)
        return pd.DataFrame({"query_class": left["query_class"].to_numpy()[q], "class_id": c, "score": s, "verified": v})

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Further cells of each query, those that the test does not rule out."""
        for b in (b.iloc[i : i + 256] for b in batches for i in range(0, len(b), 256)):
            asked, length = asked_points(np.stack(b["vector"].to_list()), basis)
            far, floor = box_distance(asked, boxes), b["floor"].to_numpy(dtype=float)
            for band, norm_ in zip(bands, band_norms):
                row, cell = np.nonzero(far <= reach(floor, length, norm_, bound)[:, None])
                to = pd.DataFrame({"query_class": b["query_class"].to_numpy()[row], "vector": [b["vector"].iloc[i] for i in row], "floor": floor[row], "band": band, "cell": cell})
                yield to[(b["band"].to_numpy()[row] != band) | (b["cell"].to_numpy()[row] != cell)]

    def found(sent: DataFrame) -> DataFrame:
        """Searches the cells that queries (query_class, vector, floor, band, cell) are sent to, all parts of each; a task
        has a part of a cell's rows and a block of its queries."""
        blocks = sent.groupBy("band", "cell").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks")).join(parts, ["band", "cell"])
        asked = sent.join(blocks, ["band", "cell"]).withColumn("block", F.pmod(F.xxhash64("query_class", F.lit(2)), "blocks").cast("int"))
        asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("query_class", "vector", "floor", "band", "cell", "part", "block")
        rows = placed.select("class_id", "vector", "band", "cell", "part").join(blocks.select("band", "cell", "blocks"), ["band", "cell"])
        rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("class_id", "vector", "band", "cell", "part", "block")
        return asked.groupBy("band", "cell", "part", "block").cogroup(rows.groupBy("band", "cell", "part", "block")).applyInPandas(search, schema)

    home = staged(found(searched.select(F.col("class_id").alias("query_class"), "vector", F.lit(float("-inf")).alias("floor"), "band", "cell")))
    order = Window.partitionBy("query_class").orderBy(F.desc("score"), "class_id")
    best = home.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    floor = best.groupBy("query_class").agg(F.count("*").alias("m"), F.min("score").alias("least")).select("query_class", F.when(F.col("m") == k + 1, F.col("least")).otherwise(F.lit(float("-inf"))).alias("floor"))
    on = searched.select(F.col("class_id").alias("query_class"), "vector", "band", "cell").join(floor, "query_class").select("query_class", "vector", "floor", "band", "cell")
    sent = staged(on.mapInPandas(visits, "query_class long, vector array<double>, floor double, band int, cell long"))
    away = staged(found(sent))
    discard(held, sent)
    both = home.union(away)
    verified = both.groupBy("query_class").agg(F.sum("verified").alias("verified"))
    every_one = both.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    # The k + 1 best classes hold the k best vectors other than the query's own; a class shows its smallest ids.
    shown = every_one.join(classes.select("class_id", "ids"), "class_id").select("query_class", "class_id", "score", F.explode("ids").alias("vec_id"))
    first = shown.withColumn("n", F.row_number().over(Window.partitionBy("query_class").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1)
    lists = first.groupBy("query_class").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "vec_id", "score", "class_id"))).alias("all"))
    own = F.array_position(F.transform("all", lambda x: (x.vec_id == F.col("query_id")) & (x.class_id == F.col("query_class"))), True).cast("int")
    rest = F.when(own > 0, F.concat(F.slice("all", F.lit(1), own - 1), F.slice("all", own + 1, F.size("all")))).otherwise(F.col("all"))
    return (
        queries.select("query_class", F.col("vec_id").alias("query_id")).join(lists, "query_class").join(verified, "query_class")
        .select("query_id", "verified", F.posexplode(F.slice(rest, 1, k)).alias("at", "x"))
        .select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score", "verified"))
