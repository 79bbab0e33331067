"""Near copies by exact Jaccard similarity of five-word shingles; SimHash finds what to compare.

A similarity of 0.8 leaves some 10 of the 64 bits of two SimHashes different, where covering masks guarantee nothing at a
useful width; so the pipeline's stage, which is held to that similarity, takes wide fingerprints, whose blocks have covering
masks of their own (simhash.wide_links), and compares the sets of each family of fingerprints that these join."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from . import simhash
from .common import columns_of, discard, row_hash, staged, text_mark
from .components import connected_components

WIDTH, SIMILARITY, SEED = 5, 0.8, 42
PRINT = [f"f{i}" for i in range(simhash.WIDE)]

#: Bytes of sets that one task compares at once, about.
MOST_BYTES = 256 << 20


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct XXH64 of a text's `width`-word shingles; a shorter text is one shingle, one without a word none."""
    words = (text or b"").lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([hashed(joined, SEED)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    return np.unique(np.fromiter((hashed(joined[s : e - 1], SEED) for s, e in zip(chain((0,), ends), ends[width - 1 :])), np.uint64))


def _node(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view(np.int64))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, prints, sizes = [], [], []
        for t in batch.column(1).cast(pa.binary()):
            found = shingles(t.as_py())
            nodes.append(_node(found))
            prints.append(simhash.wide_fingerprint(found))
            sizes.append(found.nbytes)
        longs = [pa.array(x) for x in np.array(prints, np.uint64).reshape(-1, simhash.WIDE).T.copy().view(np.int64)]
        marks = [simhash.mark_of(x) for x in prints]
        columns = [batch.column(0), batch.column(2), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(marks, pa.int64()), *longs]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "node", "bytes", "print", *PRINT])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):  # bounded memory
            found = [shingles(t.as_py()) for t in batch.column(0)[at : at + 1000].cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([_node(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["node", "set"])


def _shared(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many members of `one` each of the others has; none is empty."""
    counts = []
    for at in range(0, len(others), 500):
        part = others[at : at + 500]
        flat = np.concatenate(part)
        hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
        counts.append(np.add.reduceat(hit, np.r_[0, np.cumsum([len(x) for x in part])[:-1]], dtype=np.int64))
    return np.concatenate(counts)


def _stars(nodes: list[int], sets: list[np.ndarray], similarity: float) -> tuple[list, list]:
    """Links (head, member) that join the sets of one bucket into their components."""
    sizes, left = np.array([len(x) for x in sets]), np.arange(len(sets))
    heads, members = [], []
    while len(left) > 1:
        head, stack, left = left[0], [left[0]], left[1:]
        while stack and len(left):
            one = stack.pop()
            n, near = sizes[left], np.zeros(len(left), bool)
            able = np.flatnonzero(np.minimum(n, sizes[one]) >= similarity * np.maximum(n, sizes[one]) - 1e-9)
            if len(able):
                shared = _shared(sets[one], [sets[i] for i in left[able]])
                near[able] = shared >= similarity * (n[able] + sizes[one] - shared) - 1e-9
            stack.extend(left[near])
            members += [nodes[i] for i in left[near]]
            heads += [nodes[head]] * int(near.sum())
            left = left[~near]
    return heads, members


def _bucket_links(similarity: float):
    """Over rows (bucket, node, set) sorted by bucket: links within each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, nodes, sets = None, [], []

        def close():
            heads, members = _stars(nodes, sets, similarity)
            return pa.RecordBatch.from_arrays([pa.array(heads, pa.int64()), pa.array(members, pa.int64())], ["a", "b"])

        for batch in batches:
            for key, node, found in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if key != bucket:
                    yield close()
                    bucket, nodes, sets = key, [], []
                nodes.append(node)
                sets.append(np.frombuffer(found, np.uint64))
        yield close()

    return run


def links(docs: DataFrame, words: DataFrame, similarity: float = SIMILARITY, most: int = 20_000, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(a, b): links that connect the components of the graph that joins shingle sets of at least `similarity`.

    docs: (doc_id, mark, text). words: distinct sets, as (node, first, bytes, print, f0, ...), where first is the (doc_id,
    mark) of a row that has the set, f0, ... its wide fingerprint and print the hash of that. The sets of a family, whose
    fingerprints links join, are compared as one bucket. A bucket yields a star for each component within it, never all
    pairs; one of over `most` sets, or of sets of over `most_bytes` bytes together, is dealt in blocks, each pair of which
    is a bucket of its own.
    """
    near = staged(simhash.wide_links(words.select("print", *PRINT)))
    joined = staged(connected_components(near, "a", "b"))
    discard(near)
    rows = words.select("node", "bytes", "print").join(joined.select(F.col("node").alias("print"), "component"), "print", "left")
    rows = staged(rows.select("node", "bytes", F.coalesce("component", "print").alias("family")))
    discard(joined)
    groups = rows.groupBy("family").agg(F.count("*").alias("n"), F.sum("bytes").alias("held")).where("n > 1")
    dealt = rows.join(groups, "family").withColumn("blocks", F.when((F.col("n") <= most) & (F.col("held") <= most_bytes), 1).otherwise(F.ceil(2 * F.greatest(F.col("n") / most, F.col("held") / most_bytes))).cast("int"))
    dealt = dealt.withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = staged(dealt.select(F.xxhash64("family", F.least("i", "j"), F.greatest("i", "j")).alias("bucket"), "node"))
    discard(rows)
    wanted = words.join(dealt.select("node").distinct(), "node").select(F.col("first.doc_id").alias("__sw_id"), F.col("first.mark").alias("__sw_mark")).distinct()
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("__sw_id")) & (F.col("mark") == F.col("__sw_mark")), "left_semi").select("text")
    sets = staged(texts.mapInArrow(_sets, "node long, set binary").groupBy("node").agg(F.first("set").alias("set")))
    full = dealt.join(sets, "node").select("bucket", "node", "set")
    found = staged(full.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_bucket_links(similarity), "a long, b long"))
    discard(dealt, sets)
    return found


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, most: int = 20_000) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, mark (a hash of the text), node, component_id, component_mark.

    node is a hash of the text's set of shingles; links join texts whose sets have a Jaccard similarity of at least
    `similarity`; component_id and component_mark are those of the first row that links reach, by doc_id (null last) and
    mark. Null and empty texts have the empty set and are copies of each other; rows that repeat a doc_id each keep their
    own set; an empty table gives no rows; other columns are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_mark().alias("mark"), "text")
    marked = staged(texts.select("doc_id", "text", "mark").mapInArrow(_signatures, "doc_id long, mark long, node long, bytes long, print long, " + ", ".join(f"{x} long" for x in PRINT)))
    row = F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "mark")
    words = staged(marked.groupBy("node").agg(F.min(row).alias("first"), *[F.first(x).alias(x) for x in ("bytes", "print", *PRINT)]))
    joined = links(texts, words, similarity, most)
    found = staged(connected_components(joined, "a", "b"))
    roots = found.select(F.col("node").alias("__sw_node"), "component")
    rooted = words.join(roots, F.col("node") == F.col("__sw_node"), "left").select("node", "first", F.coalesce("component", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = rooted.join(least, "root").select("node", F.col("component.doc_id").alias("component_id"), F.col("component.mark").alias("component_mark"))
    return marked.select("doc_id", "mark", "node").join(named, "node").select("doc_id", "mark", "node", "component_id", "component_mark")


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each component of near copies: the one of the smallest doc_id (null last), of those with one doc_id the
    one of the smallest hash of the text, of rows equal in both the one of the smallest hash of its columns. Null and
    empty texts are one component. Other columns pass through. An empty table gives no rows."""
    kept = near_copies(docs, similarity).where((F.col("doc_id").eqNullSafe(F.col("component_id"))) & (F.col("mark") == F.col("component_mark")))
    kept = kept.select(F.col("doc_id").alias("__sw_id"), F.col("mark").alias("__sw_of")).distinct()
    marked = docs.withColumns({"__sw_mark": text_mark(), "__sw_doc": F.col("doc_id").cast("long"), "__sw_row": row_hash(docs)})
    first = marked.join(kept, F.col("__sw_doc").eqNullSafe(F.col("__sw_id")) & (F.col("__sw_mark") == F.col("__sw_of")), "left_semi")
    once = Window.partitionBy("__sw_doc", "__sw_mark").orderBy("__sw_row")
    return first.withColumn("__sw_n", F.row_number().over(once)).where("__sw_n = 1").select(*columns_of(docs))
