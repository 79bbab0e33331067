"""Toxicity by the nearest labelled examples."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import discard, join_sized, staged

#: Bound of what is learned: labelled examples of each class. Neighbours that vote, examples in a block of the index.
PER_CLASS, NEIGHBOURS, BLOCK = 1000, 25, 32
#: Texts that are compared together.
TOGETHER = 64
#: The weight of the share of all labels beside the votes.
PRIOR = 0.01

_WORD = re.compile(r"[^\W\d_]+")
_PREFIXES = (4, 6)


def terms_of(text: str | None) -> Counter:
    """Counts of the terms of a whole text: words in lower case, and prefixes of longer words, marked by `*`."""
    words = Counter(_WORD.findall((text or "").lower()))
    terms = Counter(words)
    for word, n in words.items():
        for size in _PREFIXES:
            if len(word) > size:
                terms[word[:size] + "*"] += n
    return terms


def held_out(doc_id: str = "doc_id"):
    """Whether crc32(doc_id as text) mod 3 is 1 (a null doc_id: false, yet never learned from)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


class BlockMaxIndex:
    """Postings of weighted examples by term; terms that many examples have as whole rows, with the largest weight in each
    block of examples. Examples that weigh the same such term most share blocks."""

    def __init__(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray, n_examples: int, n_terms: int):
        order = np.lexsort((example, term))
        example, term, weight = example[order], term[order], weight[order]
        common = np.flatnonzero(np.bincount(term, minlength=n_terms) > n_examples // 16)
        self.row = np.full(n_terms, -1)
        self.row[common] = np.arange(len(common))
        often = self.row[term] >= 0
        self.whole = np.zeros((len(common), n_examples))
        self.whole[self.row[term[often]], example[often]] = weight[often]
        self.example, self.weight = example[~often], weight[~often]
        self.start = np.searchsorted(term[~often], np.arange(n_terms + 1))
        line = np.argsort(self.whole.argmax(axis=0) if len(common) else np.zeros(n_examples), kind="stable")
        opens = np.arange(0, n_examples, BLOCK)
        self.most = np.maximum.reduceat(self.whole[:, line], opens, axis=1) if n_examples else np.zeros((len(common), 0))
        self.block = np.empty(n_examples, np.int64)
        self.block[line] = np.arange(n_examples) // BLOCK
        self.n_examples = n_examples
        self.line, self.ends = line, np.minimum(opens + BLOCK, n_examples)
        self.sorted = np.ascontiguousarray(self.whole[:, line])  # the same, block by block

    def nearest_many(self, texts: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """`nearest` of some texts together: two blocks of the largest bounds give each text a k-th product, and blocks
        that reach that of any text are multiplied with all of them."""
        if not self.n_examples or not texts:
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(texts)
        n, starts = len(texts), np.arange(0, self.n_examples, BLOCK)
        whole, partly, least = np.zeros((n, len(self.sorted))), np.zeros((n, self.n_examples)), np.full(n, -np.inf)
        for i, (terms, weights) in enumerate(texts):
            rows = self.row[terms]
            often = rows >= 0
            whole[i, rows[often]] = weights[often]
            rare, count = terms[~often], self.start[terms[~often] + 1] - self.start[terms[~often]]
            if count.sum():
                places = np.repeat(self.start[rare] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
                partly[i] = np.bincount(self.example[places], weights=self.weight[places] * np.repeat(weights[~often], count), minlength=self.n_examples)
        partly = partly[:, self.line]
        bound = np.maximum.reduceat(partly, starts, axis=1) + whole @ self.most
        for i, (terms, _) in enumerate(texts):
            best = np.argsort(-bound[i], kind="stable")[: 1 + -(-k // BLOCK)]
            columns = np.concatenate([np.arange(starts[b], self.ends[b]) for b in best])
            rows = self.row[terms][self.row[terms] >= 0]
            products = partly[i, columns] + whole[i, rows] @ self.sorted[rows[:, None], columns]
            if len(products) >= k:
                least[i] = np.partition(products, -k)[-k]
        blocks = np.flatnonzero((bound >= least[:, None] - 1e-12).any(axis=0))
        columns = np.concatenate([np.arange(starts[b], self.ends[b]) for b in blocks])
        all_ = len(columns) == self.n_examples
        products = partly[:, columns] + whole @ (self.sorted if all_ else self.sorted[:, columns])
        names, out = self.line[columns], []
        for row in products:
            rounded = np.round(row, 12)
            floor = np.partition(rounded, -k)[-k] if len(row) >= k else -np.inf
            hit = np.flatnonzero((row > 0) & (rounded >= floor))
            hit = hit[np.lexsort((names[hit], -rounded[hit]))[:k]]
            out.append((names[hit], row[hit]))
        return out

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest products above 0 and the products (ties: the smaller number), exactly: the
        examples of the largest bounds are compared in full, then those whose bound reaches the k-th product. A bound is
        the product over the rarer terms and what the example's block can add at most over the others."""
        if not self.n_examples:
            return np.zeros(0, np.int64), np.zeros(0)
        rows = self.row[terms]
        often = rows >= 0
        rows, whole_weights, rare, rare_weights = rows[often], weights[often], terms[~often], weights[~often]
        count = self.start[rare + 1] - self.start[rare]
        places = np.repeat(self.start[rare] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum()) if len(rare) else np.zeros(0, np.int64)
        partly = np.bincount(self.example[places], weights=self.weight[places] * np.repeat(rare_weights, count), minlength=self.n_examples)
        bound = partly + (whole_weights @ self.most[rows])[self.block]
        if skip >= 0:
            bound[skip] = -1.0
        first = min(4 * k, self.n_examples)
        some = np.argpartition(-bound, first - 1)[:first]
        products = np.zeros(self.n_examples)
        products[some] = partly[some] + whole_weights @ self.whole[rows[:, None], some]
        least = np.sort(products[some])[-k] if first >= k else 0.0
        rest = bound >= least - 1e-12
        rest[some] = False
        if rest.any():
            if rest.sum() * 4 > self.n_examples:
                products[rest] = (partly + whole_weights @ self.whole[rows])[rest]
            else:
                more = np.flatnonzero(rest)
                products[more] = partly[more] + whole_weights @ self.whole[rows[:, None], more]
        if skip >= 0:
            products[skip] = 0.0
        hit = np.flatnonzero(products > 0)
        near = hit[np.lexsort((hit, -np.round(products[hit], 12)))[:k]]
        return near, products[near]


def weighted(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The weights of a text's terms, of length 1, by their counts and the terms' weights."""
    raw = (1 + np.log(counts)) * weight
    return raw / np.sqrt((raw * raw).sum()) if len(raw) else raw


def relevance(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    """What a term's inverse document frequency is multiplied by: log2(2 + examples of the one class over those of the
    other that have it, as if the classes were of one size); 1 for a term that no toxic example has."""
    return np.log2(2 + toxic * (n_other / max(1, n_toxic)) / np.maximum(1, other))


def votes(products: np.ndarray, toxic: np.ndarray, prior: float) -> float:
    """The toxic share of the neighbours, each with the square of its cosine as weight, with the prior for a little more."""
    weight = products * products
    return float(((weight * toxic).sum() + PRIOR * prior) / (weight.sum() + PRIOR))


def sample_labels(labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, toxic) of at most `per_class` labelled documents of each class that are not held out, by a hash."""
    usable = labels.where(~held_out() & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    counts = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = usable.limit(0)
    for toxic, n in counts.items():
        # A threshold on the hash leaves a class about twice the rows it needs, before any are sorted.
        near = usable.where((F.col("toxic") == toxic) & (place < int(min(1.0, 2 * per_class / n) * 1_000_000) + 1))
        chosen = chosen.union(near.orderBy(place, "doc_id").limit(per_class))
    return chosen


def _examples(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, toxic, text) of the sampled documents, one text each (of several the first)."""
    texts = join_sized(docs.select("doc_id", "text").where("text is not null"), staged(sample), "doc_id")
    return texts.groupBy(F.col("doc_id").cast("long").alias("doc_id"), "toxic").agg(F.min("text").alias("text"))


def packed(terms: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Terms in three bytes each; counts in one, and those of 255 and more in four more each at the end."""
    large = counts[counts >= 255].astype("<u4").tobytes()
    return np.ascontiguousarray(terms.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes(), np.minimum(counts, 255).astype(np.uint8).tobytes() + large


def unpacked_terms(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 3, 4), np.uint8)
    wide[:, :3] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
    return wide.reshape(-1).view("<u4").astype(np.int64)


def unpacked_counts(raw: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    if len(raw) > n:
        counts[counts == 255] = np.frombuffer(raw, np.uint8, offset=n).view("<u4")
    return counts


def _vectors(docs: DataFrame, number) -> DataFrame:
    """docs (doc_id, mark, text) with terms and counts in place of text, packed, in the order of terms; terms that number
    (a broadcast of term to number, fewer than 2**24) lacks are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number_ = number.value
        known: dict[str, tuple[int, ...]] = {}

        def numbers(word: str) -> tuple[int, ...]:
            names = [word, *(word[:s] + "*" for s in _PREFIXES if len(word) > s)]
            return tuple(number_[x] for x in names if x in number_)

        for batch in batches:
            terms, counts = [], []
            for text in batch.column(2).to_pylist():
                own: dict[int, int] = {}
                for word, n in Counter(_WORD.findall((text or "").lower())).items():
                    found = known.get(word)
                    if found is None:
                        if len(known) > 300_000:
                            known.clear()
                        found = known[word] = numbers(word)
                    for t in found:
                        own[t] = own.get(t, 0) + n
                ids, n = np.fromiter(own.keys(), np.int32, len(own)), np.fromiter(own.values(), np.int32, len(own))
                order = np.argsort(ids)
                of, many = packed(ids[order], n[order])
                terms.append(of)
                counts.append(many)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "mark", "terms", "counts"])

    return docs.mapInArrow(run, "doc_id long, mark int, terms binary, counts binary")


def _frequencies(vectors: DataFrame) -> DataFrame:
    """(term, n): in how many rows of vectors each term is; added up in the task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            part = np.bincount(unpacked_terms(b"".join(batch.column(0).to_pylist())))
            if len(part) > len(total):
                part, total = total, part
            total[: len(part)] += part
        seen = np.flatnonzero(total)
        for at in range(0, len(seen), 50_000):
            some = seen[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["term", "n"])

    return vectors.select("terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, labels: DataFrame, k: int = NEIGHBOURS, threshold: float = 0.7, per_class: int = PER_CLASS) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, score, predicted, evidence (the nearest examples' doc_ids).

    The examples are a bounded sample of the labelled documents that are not held out, `per_class` of each class at most;
    the vocabulary is all of their terms. Document frequencies are counted over all documents; the inverse is multiplied
    by the term's relevance among the examples. Each text's TF-IDF vector meets the examples in a block-max inverted
    index, which finds the k of the largest cosines exactly (terms that no example has are left out; they would lower all
    cosines of a text alike); those vote, weighted by the square of the cosine; a logistic fit on the examples (each
    scored without itself) calibrates the share for the classes as all labels have them.
    A text that shares no term with an example, such as a null or empty one, has the toxic share of the labels as score.
    Without labels of both classes every score is that share, 0 if there are none. Rows that repeat a doc_id each get a
    score; repeated labels count once, toxic if one is; of an example's texts the first counts. Empty tables give no rows.
    Other columns are not read. What goes to the driver and the workers is bounded by the examples' texts. Texts are not
    shuffled; the vectors are written once.
    """
    sc = docs.sparkSession.sparkContext
    share = labels.where(~held_out() & F.col("toxic").isin(0, 1)).agg(F.avg(F.col("toxic").cast("double")).alias("p")).first()["p"] or 0.0
    chosen = staged(_examples(docs, sample_labels(labels, per_class)))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(terms_of(t)) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], ["toxic", "terms"])

    known = chosen.select("toxic", "text").mapInArrow(terms, "toxic int, terms array<string>").select("toxic", F.explode("terms").alias("term"))
    known = known.groupBy("term").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).orderBy("term").toArrow()
    number = sc.broadcast({t: i for i, t in enumerate(known.column(0).to_pylist())})
    marked = staged(_vectors(docs.select(F.col("doc_id").cast("long"), held_out().cast("int").alias("mark"), "text"), number))
    if known.num_rows >= 1 << 24:
        raise ValueError("the examples have too many terms: take fewer of each class")
    total, seen = marked.count(), _frequencies(marked).toArrow()
    frequency = np.zeros(known.num_rows)
    frequency[seen.column(0).to_numpy()] = seen.column(1).to_numpy()
    examples = _vectors(chosen.select("doc_id", F.col("toxic").alias("mark"), "text"), number).orderBy("doc_id").toArrow()
    toxic, ids = examples.column(1).to_numpy(), examples.column(0).to_numpy()
    of_class = {c: int((toxic == c).sum()) for c in (0, 1)}
    idf = np.log((1 + total) / (1 + frequency)) + 1
    weight = idf * relevance(known.column(1).to_numpy(), known.column(2).to_numpy(), of_class[1], of_class[0]) if len(idf) else idf

    def vector(terms: bytes, counts: bytes, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = unpacked_terms(terms)
        return t, weighted(unpacked_counts(counts, len(t)), weight[t])

    vectors = [vector(t, n, weight) for t, n in zip(examples.column(2).to_pylist(), examples.column(3).to_pylist())]
    flat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    index = BlockMaxIndex(np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors]), flat([t for t, _ in vectors], np.int64), flat([w for _, w in vectors], float), len(vectors), len(idf))
    both = bool(of_class[0] and of_class[1])
    own = []
    for i, (t, w) in enumerate(vectors if both else []):
        near, products = index.nearest(t, w, k, skip=i)
        own.append(votes(products, toxic[near], share))
    fit = _calibration(own, toxic, share, of_class)
    sent = sc.broadcast({"index": index, "toxic": toxic, "ids": ids, "weight": weight})

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            scores, evidence = [], []
            pairs = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()))
            for at in range(0, len(pairs), TOGETHER):
                texts = [vector(t, n, model["weight"]) for t, n in pairs[at : at + TOGETHER]]
                for near, products in model["index"].nearest_many(texts, k) if both else [((), ())] * len(texts):
                    scores.append(_calibrated(votes(products, model["toxic"][near], share), fit) if len(near) else share)
                    evidence.append([int(model["ids"][e]) for e in near[:5]])
            marks = batch.column(1).cast(pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), marks, pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(evidence, pa.list_(pa.int64()))],
                ["doc_id", "held_out", "score", "predicted", "evidence"])

    discard(chosen)
    return marked.mapInArrow(judge, "doc_id long, held_out boolean, score double, predicted int, evidence array<long>")


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _calibration(shares: list[float], toxic: np.ndarray, share: float, of_class: dict[int, int]) -> tuple[float, float]:
    """Slope and offset of a logistic fit of the votes' logit, with the classes at their shares among all labels."""
    if not len(shares) or not of_class[0] or not of_class[1]:
        return 1.0, 0.0
    x = np.column_stack((_logit(np.array(shares)), np.ones(len(shares))))
    weight = np.where(toxic == 1, share / of_class[1], (1 - share) / of_class[0]) * (of_class[0] + of_class[1])
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ ((toxic - p) * weight) - 1e-2 * (w - np.array([1.0, 0.0]))
        curve = (x * (p * (1 - p) * weight)[:, None]).T @ x + 1e-2 * np.eye(2)
        w = w + np.linalg.solve(curve, slope)
    return float(w[0]), float(w[1])


def _calibrated(p: float, fit: tuple[float, float]) -> float:
    return float(1 / (1 + np.exp(-np.clip(fit[0] * _logit(p) + fit[1], -30, 30))))
