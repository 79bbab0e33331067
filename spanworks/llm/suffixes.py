"""Repeated passages by a sparse suffix array."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import columns_of, row_hash, staged, text_mark

#: Words that suffixes must share to be compared, and words of a passage at the least. A passage of LEAST words has
#: STARTS suffixes of DEPTH words; the minimiser of each such window is retained, so one of them is.
DEPTH, LEAST = 32, 50
STARTS = LEAST - DEPTH + 1
#: Bytes kept of the hash of a window. It is compared only among suffixes that agree in 64 bits of another hash.
KEPT = 6
#: Texts of a batch that are taken at a time, for bounded memory.
TEXTS = 2500
#: Stands for a null doc_id, and so comes last.
NO_DOC = (1 << 63) - 1

_ODD = 0x9E3779B97F4A7C15
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _stirred(out: np.ndarray) -> np.ndarray:
    out = out ^ (out >> np.uint64(31))
    out = out * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def gram_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` (a power of 2) words, by doubling."""
    out, factor = words, _ODD
    while width > 1:
        half = (len(words) - len(out)) + 1
        out = (out[:-half] if half else out) * np.uint64(factor) + out[half:] if len(out) > half else out[:0]
        factor = factor * factor % (1 << 64)
        width //= 2
    return _stirred(out)


def suffixes_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Of a text's word hashes: the hashes of all its windows of LEAST words, and of each retained suffix its key (the
    hash of its DEPTH words) and the first and the number of the windows of which it is the minimiser. Those follow each
    other: they are the suffix extended to the left by fewer and fewer words and to the right by more and more."""
    grams = gram_hashes(words, DEPTH)
    if len(grams) < STARTS:
        return None
    windows = _stirred(grams[: len(grams) - STARTS + 1] * np.uint64(_ODD) + grams[STARTS - 1 :])
    chosen = np.lib.stride_tricks.sliding_window_view(grams, STARTS).argmin(axis=1) + np.arange(len(windows))
    first = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    return windows, grams[chosen[first]], first, np.diff(np.r_[first, len(windows)])


def _suffixes(batch: pa.RecordBatch) -> tuple[np.ndarray, ...] | None:
    """(key, doc, mark, at, n) of the retained suffixes of a batch of (doc, mark, text), and their windows, flat."""
    parts, flat = [], []
    for doc, mark, text in zip(batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).cast(pa.binary())):
        found = suffixes_of(word_hashes((text.as_py() or b"").split()))
        if found is not None:
            windows, key, first, n = found
            flat.append(windows)
            parts.append((key, np.full(len(key), doc), np.full(len(key), mark), first, n))
    return (*(np.concatenate(x) for x in zip(*parts)), np.concatenate(flat)) if parts else None


NAMES = ["key", "doc", "mark", "at", "stop", "first", "windows"]
SCHEMA = "key long, doc long, mark long, at int, stop int, first long, windows binary"


def _blob(windows: np.ndarray, n: np.ndarray) -> pa.Array:
    """Rows of n windows each, KEPT bytes of each window."""
    raw = np.ascontiguousarray(windows.view(np.uint8).reshape(-1, 8)[:, :KEPT])
    ends = np.concatenate(([0], np.cumsum(n * KEPT))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(raw.tobytes())])


def _windows(blob: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The windows of rows, flat, and how many each row has."""
    raw = blob.to_pylist()
    n = np.fromiter(map(len, raw), np.int64, len(raw)) // KEPT
    wide = np.zeros((int(n.sum()), 8), np.uint8)
    wide[:, :KEPT] = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, KEPT)
    return wide.reshape(-1).view(np.uint64), n


def _first_of(group: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """For each row the row of its group that comes first by `order`."""
    by = np.lexsort((*order[::-1], group))
    again = np.zeros(len(group), bool)
    again[1:] = group[by[1:]] == group[by[:-1]]
    lead = np.empty(len(group), np.int64)
    lead[by] = by[np.maximum.accumulate(np.where(again, 0, np.arange(len(group))))]
    return lead


def _batch(key, doc, mark, at, stop=None, first=None, windows=None) -> pa.RecordBatch:
    n = len(doc)
    long, int_ = pa.int64(), pa.int32()
    return pa.RecordBatch.from_arrays([
        pa.nulls(n, long) if key is None else pa.array(key.view(np.int64)), pa.array(doc, long), pa.array(mark, long), pa.array(at, int_),
        pa.nulls(n, int_) if stop is None else pa.array(stop, int_), pa.nulls(n, long) if first is None else pa.array(first, long),
        pa.nulls(n, pa.binary()) if windows is None else windows], NAMES)


def _ranges(row, doc, mark, at, first) -> tuple[np.ndarray, ...]:
    """(doc, mark, begin, stop, first) of repeated windows, in order; windows of a row that follow each other are one."""
    opens = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)])
    last = np.r_[opens[1:], len(at)] - 1
    return doc[opens], mark[opens], at[opens], at[last] + LEAST, first[opens]


def _suffix_rows(batches: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of (doc, mark, text): a row for each retained suffix, with its windows. A suffix of a hot key gives a row for each
    of its windows instead, whose key is the window's. Of equal rows of a batch only the first by (doc, mark, at) goes
    on; of the others the range that repeats is settled here."""

    def settled(doc, mark, begin, stop, first):  # goes anywhere, but for the key's own task
        return _batch(_stirred(doc.view(np.uint64) * np.uint64(_ODD) + begin.astype(np.uint64)), doc, mark, begin, stop, first)

    for batch in (b.slice(i, TEXTS) for b in batches for i in range(0, b.num_rows, TEXTS)):
        found = _suffixes(batch)
        if found is None:
            continue
        key, doc, mark, at, n, windows = found
        of = np.repeat(np.arange(len(key)), n)
        is_hot = np.isin(key, hot)
        for split in (False, True):
            rows = np.flatnonzero(is_hot == split)
            if not len(rows):
                continue
            if split:
                flat = np.flatnonzero(is_hot[of])
                r = of[flat]
                place = (flat - np.concatenate(([0], np.cumsum(n)))[r] + at[r]).astype(np.int64)
                k, d, m, a, w, count = _stirred(key[r] * np.uint64(_ODD) + windows[flat]), doc[r], mark[r], place, windows[flat], np.ones(len(flat), np.int64)
                whole = k
            else:
                k, d, m, a, count, w = key[rows], doc[rows], mark[rows], at[rows], n[rows], windows[~is_hot[of]]
                r = rows
                starts = np.concatenate(([0], np.cumsum(count)[:-1]))
                rank = np.arange(len(w)) - np.repeat(starts, count)
                whole = _stirred(k * np.uint64(_ODD) + np.add.reduceat(_stirred(w + rank.astype(np.uint64) * np.uint64(_ODD)), starts))
            lead = _first_of(whole, d, m, a)
            later = (d != d[lead]) | (m != m[lead]) | (a != a[lead])
            if later.any():
                x = np.flatnonzero(later)
                if split:
                    yield settled(*_ranges(r[x], d[x], m[x], a[x], d[lead[x]]))
                else:
                    yield settled(d[x], m[x], a[x], a[x] + count[x] - 1 + LEAST, d[lead[x]])
            go = lead == np.arange(len(k))
            yield _batch(k[go], d[go], m[go], a[go], windows=_blob(w[np.repeat(go, count)], count[go]))


def hot_keys(rows: DataFrame, sample: int = 4000, share: float = 0.003, most: int = 20_000) -> np.ndarray:
    """Keys that at least `share` of a sample of some `sample` texts (by a hash) have, at most `most`: these are dealt out
    by their windows. The list decides on the way of their suffixes only, not on what is found."""
    n = rows.count()
    part = rows.where(F.pmod(F.xxhash64("doc", "mark"), F.lit(1_000_000)) < int(min(1.0, sample / max(1, n)) * 1_000_000) + 1)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, TEXTS) for b in batches for i in range(0, b.num_rows, TEXTS)):
            found = _suffixes(batch)
            if found is not None:
                yield pa.RecordBatch.from_arrays([pa.array(found[0].view(np.int64))], ["key"])

    counts = part.mapInArrow(keys, "key long").groupBy("key").count()
    found = counts.where(F.col("count") >= max(10, int(share * min(n, sample)))).orderBy(F.desc("count"), "key").limit(most).collect()
    return np.array([r["key"] for r in found], np.int64).view(np.uint64)


def _repeats(batches: Iterator[pa.RecordBatch], most: int, watch=None) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (key, doc, mark, at): the ranges that occur earlier (key null). Of the key that is open the
    windows met so far are held, each with the place it was first at: at most `most` of them. Windows of that key beyond
    those come back unsettled, a row each, with the window's own key. watch(n) is told how many are held."""
    open_key, held = None, {}
    for batch in batches:
        done = ~batch.column(4).is_null().to_numpy(zero_copy_only=False)
        if done.any():
            ready = batch.filter(pa.array(done))
            yield _batch(None, *(ready.column(i).to_numpy() for i in (1, 2, 3, 4, 5)))
            batch = batch.filter(pa.array(~done))
        if not batch.num_rows:
            continue
        row_key, row_doc, row_mark, row_at = (batch.column(i).to_numpy() for i in range(4))
        w, n = _windows(batch.column(6))
        row = np.repeat(np.arange(len(n)), n)
        key, doc, mark = row_key.view(np.uint64)[row], row_doc[row], row_mark[row]
        at = (np.arange(len(w)) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n) + row_at[row]).astype(np.int64)
        _, lead, of = np.unique(_stirred(key * np.uint64(_ODD) + w), return_index=True, return_inverse=True)
        lead = lead[of]
        own = lead == np.arange(len(w))
        known_doc, known_mark, known_at, beyond = doc.copy(), mark.copy(), at.copy(), np.zeros(len(w), bool)
        if key[0] != open_key:
            held = {}
        elif held:  # windows that earlier batches have met
            for i in np.flatnonzero((key == open_key) & own):
                known = held.get(int(w[i]))
                if known is not None:
                    known_doc[i], known_mark[i], known_at[i] = known
        if key[-1] != open_key:
            open_key, held = key[-1], {}
        for i in np.flatnonzero((key == open_key) & own):
            code = int(w[i])
            if code not in held:
                if len(held) < most:
                    held[code] = (doc[i], mark[i], at[i])
                else:
                    beyond[i] = True
        first_doc, first_mark, first_at, loose = known_doc[lead], known_mark[lead], known_at[lead], beyond[lead]
        if watch is not None:
            watch(len(held))
        if loose.any():
            x = np.flatnonzero(loose)
            yield _batch(_stirred(key[x] * np.uint64(_ODD) + w[x]), doc[x], mark[x], at[x])
        again = ~loose & ((doc != first_doc) | (mark != first_mark) | (at != first_at))
        if again.any():
            x = np.flatnonzero(again)
            d, m, begin, stop, first = _ranges(row[x], doc[x], mark[x], at[x], first_doc[x])
            yield _batch(None, d, m, begin, stop, first)


def _spans(docs: DataFrame, most: int) -> DataFrame:
    """(doc, mark, begin, stop, earlier), doc NO_DOC for null: see repeated_spans."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)).alias("doc"), text_mark().alias("mark"), "text").where("text is not null")
    made = rows.mapInArrow(partial(_suffix_rows, hot=hot_keys(rows)), SCHEMA)
    found = staged(made.repartition("key").sortWithinPartitions("key", "doc", "mark", "at").mapInArrow(partial(_repeats, most=most), SCHEMA))
    spans = found.where("key is null").select("doc", "mark", F.col("at").alias("begin"), "stop", "first")
    loose = found.where("key is not null").select("key", "doc", "mark", "at")
    lead = loose.groupBy("key").agg(F.min(F.struct("doc", "mark", "at")).alias("lead"))
    again = loose.join(lead, "key").where(F.struct("doc", "mark", "at") > F.col("lead"))
    spans = spans.union(again.select("doc", "mark", F.col("at").alias("begin"), (F.col("at") + LEAST).alias("stop"), F.col("lead.doc").alias("first")))
    line = Window.partitionBy("doc", "mark").orderBy("begin", "stop")
    reached = F.max("stop").over(line.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("begin") > reached, F.lit(True)).cast("int")
    joined = spans.withColumn("opens", opens).withColumn("part", F.sum("opens").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return joined.groupBy("doc", "mark", "part").agg(F.min("begin").alias("begin"), F.max("stop").alias("stop"), F.array_sort(F.collect_set(F.nullif("first", F.lit(NO_DOC)))).alias("earlier")).drop("part")


def repeated_spans(docs: DataFrame, most: int = 200_000) -> DataFrame:
    """(doc_id, begin, stop, earlier, text_mark): word ranges of passages of at least LEAST words that occur earlier, by
    (doc_id, text_mark, place), in another row or in the same one, and the documents where parts of them occur first. The
    ranges of a row are maximal and disjoint.

    Retained are the suffixes at the minimisers of all windows of LEAST words. They are shuffled and sorted by the hash of
    their first DEPTH words, which brings equal prefixes together as in a suffix array cut at that depth; suffixes of one
    prefix are then extended to the left and right, up to the windows of LEAST words that they stand for, and compared.
    Prefixes count as equal by 64 bits, extended ones by 48 bits more. Every passage of LEAST words that repeats is found.
    A mapper settles equal suffixes of its own batch, so exact copies hardly travel. Prefixes that a bounded sample shows
    to be hot are dealt out by their windows; of any other a task holds `most` windows, and what is beyond is settled by a
    grouped minimum.

    Null and empty texts and those below LEAST words have no range. Rows that repeat a doc_id with different texts are
    rows of their own, told apart by text_mark (hexadecimal); rows that repeat both have the same ranges once, and their
    equal places are no repeats of each other. A null doc_id comes last and is not told in `earlier`; the largest long
    counts as null. An empty table gives no rows. Other columns are not read.
    """
    found = _spans(docs, most)
    return found.select(F.nullif("doc", F.lit(NO_DOC)).alias("doc_id"), "begin", "stop", "earlier", F.hex("mark").alias("text_mark"))


def _cut(batches: Iterator[pa.RecordBatch], at: int, spans_at: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, spans in zip(batch.column(at), batch.column(spans_at)):
            text, spans = text.as_py(), spans.as_py()
            if spans:
                raw = text.encode()
                places = [m.span() for m in _WORD.finditer(raw)]
                parts, last = [], 0
                for s in spans:
                    parts.append(raw[last : places[s["begin"]][0]])
                    last = places[s["stop"]][0] if s["stop"] < len(places) else len(raw)
                text = b"".join([*parts, raw[last:]]).decode()
            texts.append(text)
        columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns) if i != spans_at]
        yield pa.RecordBatch.from_arrays(columns, names)


def without_repeats(docs: DataFrame, most: int = 200_000) -> DataFrame:
    """The rows of docs without the passages that occur earlier; rows of which nothing but white space is left go.

    The first occurrence of a passage stays; of a run that repeats itself, overlapping, what comes before its first
    repeat. A column n_chars follows the text. Each row is cut by its own ranges: rows that repeat a doc_id with other
    texts are judged as documents of their own; of rows equal in doc_id and text one stays, by the smallest hash of its
    columns. Rows with a null text stay; those with a null doc_id are cut like any other, and come last. Other columns
    pass through, whatever their names. An empty table gives no rows.
    """
    doc, mark = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)), text_mark()
    spans = _spans(docs, most).groupBy(F.col("doc").alias("__sw_doc"), F.col("mark").alias("__sw_mark")).agg(F.array_sort(F.collect_list(F.struct("begin", "stop"))).alias("__sw_spans"))
    once = Window.partitionBy("__sw_doc", "__sw_mark").orderBy("__sw_row")
    single = docs.withColumns({"__sw_doc": doc, "__sw_mark": mark, "__sw_row": row_hash(docs)}).withColumn("__sw_n", F.row_number().over(once)).where("__sw_n = 1").drop("__sw_n", "__sw_row")
    both = single.join(spans, ["__sw_doc", "__sw_mark"], "left").select(*columns_of(docs), "__sw_spans")
    columns = both.columns
    plain = both.toDF(*[f"c{i}" for i in range(len(columns))])  # mapInArrow reads a dot in a name as a field
    cut = plain.mapInArrow(partial(_cut, at=columns.index("text"), spans_at=columns.index("__sw_spans"), names=docs.columns), docs.schema)
    if "n_chars" in columns:
        cut = cut.withColumn("n_chars", F.when(F.col("n_chars").isNotNull() & F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cut.where(F.col("text").rlike(r"[^\x20\x09-\x0D]") | F.col("text").isNull())
