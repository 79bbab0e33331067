"""SimHash near-duplicates with a covering locality-sensitive hash: within a radius of 64 bits, or, for the pipeline, wide
fingerprints whose blocks have covering masks of their own."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import discard, staged
from .components import connected_components

BITS, SEED = 64, 42

#: Wide fingerprints: longs, those of them that distances are taken over, bits of a block, blocks of a long, and the radius
#: that a block's masks cover. Two sets of similarity 0.8 differ in 0.152 of the bits, so in at most one bit of a block with
#: a chance of 0.438: they share no bucket of the 30 blocks with a chance of 3e-8, less above 0.8.
WIDE, HELD, BLOCK, BLOCKS, COVERED = 6, 4, 12, 5, 1
#: Most bits of 256 in which candidates differ: 5.8 deviations above the mean at 0.8, 7 below that of unlike texts.
NEAR = 72
#: Tables that are looked up before the others, those of three blocks.
FIRST = 9
#: Blocks by which a bucket of many fingerprints is told apart within its task: a pair is lost to it with a chance of 0.001.
DEEPER = 12

_STEPS = np.arange(1, 9 * WIDE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """The 64-bit SimHash of a text's `width`-word shingles, repeats included; 0 if it has no word."""
    words = (text or b"").lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    hashed = xxhash.xxh64_intdigest
    if len(words) <= width:
        return hashed(joined, SEED)
    starts = chain((0,), ends)
    hashes = np.fromiter((hashed(joined[s : e - 1], SEED) for s, e in zip(starts, ends[width - 1 :])), np.uint64)
    return int(voted(hashes))


def voted(hashes: np.ndarray) -> np.uint64:
    """Each bit that over half of the hashes have; 0 of none."""
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):  # bounded memory for very long texts
        part = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0]


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp) per row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.fromiter((fingerprint(t.as_py(), width) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """2**(radius+1) - 1 masks such that any two words of `bits` that differ in at most `radius` bits agree under one of them.

    Bit i carries a non-zero vector over GF(2) of radius + 1 bits; mask v takes the bits whose vector has an odd product
    with v. At most `radius` differing bits leave a non-zero v orthogonal to all of their vectors, so mask v skips them.
    """
    size = 1 << (radius + 1)
    of_bit = [i % (size - 1) + 1 for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (of_bit[i] & v).bit_count() % 2) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _stars(words: np.ndarray, radius: int) -> tuple[list, list]:
    """Links (head, member) that join the words of one bucket into their components."""
    heads, members = [], []
    while len(words) > 1:
        head, stack, words = words[0], [words[0]], words[1:]
        while stack and len(words):
            near = np.bitwise_count(words ^ stack.pop()) <= radius
            if near.any():
                got = words[near]
                stack.extend(got)
                words = words[~near]
                members.append(got)
                heads.append(np.full(len(got), head))
    return heads, members


def _bucket_links(radius: int, most: int | None):
    """Over rows (t, key, fp) sorted by t and key: links within each bucket; a bucket of over `most` comes back as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, whole = 0, True  # rows held; whether the bucket that is open is still held in full

        def give(t, key, a, b=None):
            nulls = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(key, pa.int64()), pa.array(a.view(np.int64)), nulls], ["t", "key", "a", "b"])

        def close(t, key, fp):
            cut = np.flatnonzero((np.diff(t) != 0) | (np.diff(key) != 0)) + 1
            starts, ends = np.r_[0, cut], np.r_[cut, len(t)]
            several = ends - starts > 1
            heads, members = [], []
            for s, e in zip(starts[several], ends[several]):
                h, m = _stars(fp[s:e], radius)
                heads += h
                members += m
            if heads:
                a = np.concatenate(heads)
                yield give(np.full(len(a), -1), np.zeros(len(a)), a, np.concatenate(members))

        for batch in batches:
            if not batch.num_rows:
                continue
            t, key, fp = (batch.column(i).to_numpy() for i in range(3))
            fp = fp.view(np.uint64)
            if held:
                same = (t == held[-1][0][-1]) & (key == held[-1][1][-1])
                n = len(t) if same.all() else int(np.argmin(same))
                if not whole:
                    if n:
                        yield give(t[:n], key[:n], fp[:n])
                elif n:
                    held.append((t[:n], key[:n], fp[:n]))
                    size += n
                t, key, fp = t[n:], key[n:], fp[n:]
                if whole and most and size > most:
                    for part in held:
                        yield give(*part)
                    held, whole = held[-1:], False
                if not len(t):
                    continue
                if whole:
                    yield from close(*map(np.concatenate, zip(*held)))
            last = np.flatnonzero((t != t[-1]) | (key != key[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from close(t[:cut], key[:cut], fp[:cut])
            held, size, whole = [(t[cut:], key[cut:], fp[cut:])], len(t) - cut, True
        if held and whole:
            yield from close(*map(np.concatenate, zip(*held)))

    return run


def links(words: DataFrame, radius: int = 4, most: int = 20_000) -> DataFrame:
    """(a, b): links that connect exactly the components of the graph that joins fingerprints within `radius` bits.

    words: distinct fingerprints, column fp. Each goes to the bucket of every covering mask; buckets are read as sorted
    runs. A bucket yields a star for each component within it, never all pairs. A bucket of over `most` fingerprints is
    dealt anew in blocks whose pairs go to different tasks, so that no task holds it whole and no link is lost.
    """
    schema, masks = "t int, key long, a long, b long", covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])
    rows = words.select("fp", F.explode(tables).alias("x")).select("x.t", "x.key", "fp")
    found = staged(rows.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(_bucket_links(radius, most), schema))
    large = found.where("t >= 0").select("t", "key", F.col("a").alias("fp"))
    if large.isEmpty():
        return found.select("a", "b")
    blocks = large.groupBy("t", "key").agg(F.ceil(2 * F.count("*") / most).cast("int").alias("n"))
    dealt = large.join(blocks, ["t", "key"]).withColumn("i", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select("t", F.xxhash64("key", "n", F.least("i", "j"), F.greatest("i", "j")).alias("key"), "fp")
    more = dealt.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(_bucket_links(radius, None), schema)
    return found.where("t < 0").select("a", "b").union(more.select("a", "b"))


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, fp, component_id.

    component_id is the smallest doc_id that links of at most `radius` differing bits reach. Null and empty texts have
    fingerprint 0 and link like any other; rows that repeat a doc_id each keep their own fingerprint; a component whose
    doc_ids are all null has a null component_id; an empty table gives no rows; other columns are not read.
    """
    marked = staged(fingerprints(docs, width))
    words = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    joined = staged(links(words.select("fp"), radius))
    roots = staged(connected_components(joined, "a", "b"))
    discard(joined)
    rooted = words.join(roots, words.fp == roots.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def _drawn(hashes: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Each 64-bit hash drawn out to as many longs as there are steps (SplitMix64), as rows of bytes."""
    x = hashes[:, None] + steps
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.uint8)


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of a set of 64-bit hashes in WIDE longs; each hash is drawn out to as many. 0 of none. A tie goes by one of
    the hashes, drawn for each bit, so that small sets are as unlike as large ones; of over 64 hashes, where few tie, it is 0."""
    votes = np.zeros(WIDE * 64, np.int64)
    for at in range(0, len(hashes), 255):  # votes of a part fit a byte
        bits = np.unpackbits(_drawn(hashes[at : at + 255], _STEPS[:WIDE]), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.uint8)
    if 0 < len(hashes) <= 64 and len(hashes) % 2 == 0:
        tie = _drawn(hashes, _STEPS[WIDE:]).argmin(axis=0)
        return np.packbits(2 * votes + bits[tie, np.arange(len(votes))] > len(hashes), bitorder="little").view(np.uint64)
    return np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)


def wide_masks() -> list[tuple[int, int]]:
    """(long, mask) of each table of wide fingerprints; a block's tables follow each other."""
    masks = covering_masks(COVERED, BLOCK)
    return [(w, m << BLOCK * b) for w in range(WIDE) for b in range(BLOCKS) for m in masks]


def _near(words: np.ndarray, some: np.ndarray, others: np.ndarray) -> np.ndarray:
    differ = np.zeros((len(some), len(others)), np.uint16)
    for one, other in zip(words[some].T, words[others].T):
        differ += np.bitwise_count(one[:, None] ^ other)
    return differ <= NEAR


def _near_pairs(words: np.ndarray, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that join the components of the rows `left` at NEAR bits. A row of many neighbours gives a star of its
    component, which then is done with; the others give all their pairs."""
    while len(left) > 1:
        batch = left[: max(1, min(256, (1 << 22) // len(left)))]  # bounded memory
        near = _near(words, batch, left)
        most = near.sum(axis=1)
        if most.max() <= 256:
            i, j = np.nonzero(near)
            yield batch[i[i < j]], left[j[i < j]]
            left = left[len(batch) :]
            continue
        head = stack = left[[most.argmax()]]
        left = left[left != head]
        while len(stack) and len(left):
            size = max(1, min(256, (1 << 22) // len(left)))
            hit = _near(words, stack[:size], left).any(axis=0)
            yield np.repeat(head, hit.sum()), left[hit]
            stack, left = np.concatenate([stack[size:], left[hit]]), left[~hit]


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of rows a and b. root leads from a row to smaller rows of its component, the smallest to itself."""
    while len(a):
        both = np.concatenate([a, b])
        while (root[root[both]] != root[both]).any():
            root[both] = root[root[both]]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))


def _wide_bucket(words: np.ndarray, table: int, most: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (head, member) of rows: a star for each component of one bucket, from its first row. Rows of one `known` value
    are linked already and count as one, by the first of them; so links are fewer than these. A bucket of over `most` rows is
    told apart by the masks of further blocks."""
    rows = np.arange(len(words))
    runs, root = [rows], rows.copy()
    if known is not None:
        _, first, at = np.unique(known, return_index=True, return_inverse=True)
        root = first[at]
        if len(first) == 1:
            return rows[:0], rows[:0]
    ends = np.flatnonzero(root == rows)
    if len(words) > most:
        masks = covering_masks(COVERED, BLOCK)
        runs = []
        for b in range(1, DEEPER + 1):
            w, b = divmod((table // len(masks) + b) % (HELD * BLOCKS), BLOCKS)
            for m in masks:
                key = words[:, w] & np.uint64(m << BLOCK * b)
                order = np.argsort(key, kind="stable")
                runs += [x for x in np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(x) > 1]
    for run in runs:
        for a, b in _near_pairs(words, run):
            _join(root, a, b)
    while (root[root] != root).any():
        root = root[root]
    members = ends[root[ends] != ends]
    return root[members], members


def _wide_bucket_links(most: int):
    """Over rows (bucket, known, HELD longs) sorted by bucket and known: links within each bucket, by known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []

        def close():
            known, words = (np.concatenate(x) for x in zip(*held))
            ends = _wide_bucket(words, bucket & 127, most, known) if len(words) > 1 else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(known[x]) for x in ends], ["a", "b"]) if len(ends[0]) else None

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, known = (batch.column(i).to_numpy() for i in range(2))
            words = np.stack([batch.column(2 + i).to_numpy() for i in range(HELD)], axis=1).view(np.uint64)
            cuts = np.r_[0, np.flatnonzero(np.diff(keys)) + 1, len(keys)]
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if held and keys[s] != bucket:
                    if (links := close()) is not None:
                        yield links
                    held = []
                bucket = int(keys[s])
                held.append((known[s:e], words[s:e]))
        if held and (links := close()) is not None:
            yield links

    return run


def mark_of(words: np.ndarray) -> int:
    """A hash of the longs of a wide fingerprint that distances are taken over, as a signed long."""
    return _signed(xxhash.xxh64_intdigest(np.ascontiguousarray(words[:HELD]).tobytes(), SEED))


def wide_links(words: DataFrame, most: int = 2_000) -> DataFrame:
    """(a, b): links, by `mark_of`, that connect the components of the graph that joins wide fingerprints within NEAR bits.

    words: wide fingerprints, columns f0, f1, ... and print, their `mark_of`. A fingerprint goes to the bucket of each mask of
    each block; fingerprints of which some block differs in at most COVERED bits share one for certain. A bucket holds 40
    bytes a fingerprint and yields a star for each component within it, never all pairs; one of over `most` is told apart by
    further blocks in its task. The first tables' links tell what is linked already: such fingerprints go on by one name, the
    least head, and the other tables only link names, so that a group's links don't repeat in each table.
    """
    held, masks = [f"f{i}" for i in range(HELD)], list(enumerate(wide_masks()))

    def linked(rows: DataFrame, some: list) -> DataFrame:
        buckets = [F.xxhash64(F.lit(t), F.col(f"f{w}").bitwiseAND(F.lit(_signed(m)))).bitwiseAND(F.lit(-128)).bitwiseOR(F.lit(t)) for t, (w, m) in some]
        rows = rows.select(F.explode(F.array(*buckets)).alias("bucket"), "known", *held)
        return rows.repartition("bucket").sortWithinPartitions("bucket", "known").mapInArrow(_wide_bucket_links(most), "a long, b long")

    first = staged(linked(words.withColumn("known", F.col("print")), masks[:FIRST]))
    heads = first.groupBy(F.col("b").alias("print")).agg(F.min("a").alias("head"))
    named = words.join(heads, "print", "left").withColumn("known", F.coalesce("head", "print"))
    return first.union(linked(named, masks[FIRST:]))
