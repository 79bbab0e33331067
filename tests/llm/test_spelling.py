"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spanworks.llm import spelling


def counted(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            out[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(count):
    near = defaultdict(set)
    deleted = defaultdict(set)
    for w in count:
        for i in range(len(w)):
            deleted[w[:i] + w[i + 1 :]].add(w)
            deleted[w].add(w)
    for group in deleted.values():
        for a in group:
            near[a] |= {b for b in group if b != a and one_edit(a, b)}
    form = {}
    for w, n in count.items():
        best = min(near[w], key=lambda x: (-count[x], x), default=None)
        form[w] = best if best is not None and count[best] >= 2 * n else None
    out = []
    for w, n in count.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), count.get(form[w])))
    return sorted(out)


def rows_of(table, **how):
    return sorted(tuple(r) for r in spelling.variants(table, **how).select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("bucket", [spelling.BUCKET, 0, 3])
def test_given_documents(spark, sf, bucket):
    """All halves as they are, all told apart, and some."""
    table = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01') if bucket == 3 else sf}/documents.parquet")
    assert rows_of(table, bucket=bucket) == brute(counted([tuple(r) for r in table.select("doc_id", "text").collect()]))


@pytest.mark.parametrize("seed", range(4))
def test_near_words(spark, seed):
    """Few letters, so that words repeat letters and lie close; chains of forms."""
    rng = random.Random(seed)
    count = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 9))): rng.choice([3, 7, 20, 50, 200]) for _ in range(400)}
    table = spark.createDataFrame(list(count.items()), "word string, n long")
    for bucket in (0, 4, 64):
        found = [tuple(r) for r in spelling.links(table, bucket).select("a", "b").collect()]
        assert len(found) == len(set(found))
        assert {frozenset(p) for p in found} == {frozenset((a, b)) for a in count for b in count if a != b and one_edit(a, b)}
        assert all(len(a) < len(b) or len(a) == len(b) and a < b for a, b in found)


def test_chain_of_forms(spark):
    words = [("a" * (6 + k), 3 * 2**k) for k in range(12)]
    table = spark.createDataFrame([(k, " ".join([w] * n)) for k, (w, n) in enumerate(words)], "doc_id long, text string")
    assert rows_of(table) == brute(counted([(r.doc_id, r.text) for r in table.collect()]))
    forms = spark.createDataFrame([(f"w{k:03}", f"w{k + 1:03}") for k in range(100)], "word string, form string")
    assert {r.root for r in spelling.roots(forms).collect()} == {"w100"}


def test_odd_rows(spark):
    rows = [
        (1, None, "a"), (2, "", "b"), (None, "Größe größe GRÖSSE grösse Grösse grösse", None), (3, "word " * 30_000 + "words " * 9 + "wörds " * 4, "c"),
        (3, "word " * 9, "c"), (3, "word " * 9, "c"), (4, "日本語 ÷× naïve×naïve÷naïve ABCDEé abcdeé Abcdeé ABCDEÉ", "d"), (5, "abcde " * 2 + "x1abcde2", "d"), (6, "z" * 200_000, "e"),
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string, word string").withColumns({"n": F.lit(1), "a.b": F.create_map(F.lit(1), F.lit(2))})
    assert rows_of(table) == brute(counted([r[:2] for r in rows]))
    assert rows_of(table.limit(0)) == []
