"""Packing against the tokenizer's own library, and its planner on multisets made to be awkward."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanworks.llm import packing

ODD = [
    (1, None, "a"), (2, "", "a"), (3, "same", "a"), (3, "same", None), (None, "no id", None), (4, "word " * 30_000, "b"),
    (5, "Ünïcode 日本語 🎉 <|endoftext|> \u0000\u0085 x", "b"), (6, " " * 5_000 + "x" * 5_000, "c"), (7, "tail <|endoftext|>", "c"),
]


def check(rows, texts):
    """Whole documents, gapless sequences without padding, and the ids of the tokenizer's library."""
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = lambda t: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == packing.CAPACITY or at < packing.CAPACITY and at & (at - 1) == 0
    own = defaultdict(list)
    for doc_id, text in texts:
        own[doc_id].append(encode(text))
    assert set(own) == set(pieces)
    for doc_id, all_ids in own.items():
        assert sum(map(len, all_ids)) == sum(n for _, n, _, _ in pieces[doc_id])
        fits = lambda p: any(len(ids) == p[3] and zlib.crc32(ids[p[0] : p[0] + p[1]].tobytes()) == p[2] for ids in all_ids)
        assert all(map(fits, pieces[doc_id]))
        if len(all_ids) == 1:
            at = 0
            for start, length, _, _ in sorted(pieces[doc_id]):
                assert start == at
                at += length


@pytest.mark.parametrize("block", [packing.BLOCK, 5_000])
def test_given_documents(spark, sf, block):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(packing.packed(docs, block=block).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_odd_documents(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, start string")
    check(packing.packed(docs).collect(), [(r[0], r[1]) for r in ODD])
    assert packing.packed(docs.limit(0)).collect() == []


def test_libraries_agree():
    encoder = packing.Encoder("byte_bpe_50k")
    for c in map(chr, range(0x250)):
        text = f"a{c}b {c}{c} 1{c}2 {c}!{c}? x  {c}\n{c} '{c}s don{c}t {c}"
        assert encoder.encode(text)[:-1].tolist() == encoder.whole.encode(text, add_special_tokens=False).ids


def best_fill(window, lengths):
    sums = {0}
    for n in lengths:
        sums |= {s + n for s in sums if s + n <= window}
    return max(sums)


@pytest.mark.parametrize("seed", range(30))
def test_least_slack(seed):
    """The chosen multiset exists and no other one leaves less slack."""
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randint(1, 2047), rng.randint(1, 40), 512, 700]) for _ in range(rng.randint(0, 12))]
    pool = packing.Pool()
    for doc, n in enumerate(lengths):
        pool.add(n, doc, 0)
    window = rng.randint(1, 2048)
    counts, slack = pool.closest(window, [n for n in pool.lengths() if n <= window])
    assert sum(n * k for n, k in counts.items()) + slack == window and window - slack == best_fill(window, lengths)
    assert all(k <= lengths.count(n) for n, k in counts.items())


def test_few_cuts():
    """Rests of many lengths, mostly short, are hardly cut; rests that never fit together are cut, and still nothing is padded."""
    rng = random.Random(5)
    docs = [(i, np.ones(min(2047, int(rng.lognormvariate(5.5, 1))), "<u4")) for i in range(3000)]
    rows = packing._rows(docs, 0)[0]
    assert rows.num_rows - len(docs) < 100
    alike = packing._rows([(i, np.ones(1100, "<u4")) for i in range(1000)], 7)
    assert alike[1] - 7 <= 1000 * 1100 // 2048 + 11 and sum(alike[0].column(2).to_pylist()) == 1_100_000


def test_sequences_are_numbered_apart(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    over = packing.packed(docs).groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048")
    assert over.count() == 0
