"""Language identification: the family first, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F

from .common import join_sized, staged

#: Family by language code; a code that is in none is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "da", "sv", "no", "is", "af"),
    "romance": ("fr", "es", "pt", "it", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "bg", "mk", "sr", "hr", "pl", "cs", "sk", "sl"),
}
#: Bounds of the sample the machines are trained on: rows of a language, rows of all (but LEAST_ROWS of each language).
PER_LANGUAGE, SAMPLE_ROWS, LEAST_ROWS, LOG_BUCKETS = 400, 2000, 5, 14
#: Languages of no known family are families of their own up to so many; more are gathered by likeness, GATHERED together.
LONE, GATHERED = 16, 8
#: Bytes of a text that are taken at a time.
PART = 1 << 20

_LETTER = regex.compile(r"\p{L}")
#: A-Z to a-z, other ASCII but letters to blank, bytes of other characters as they are.
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def grams(raw: np.ndarray, before: int = 0) -> np.ndarray:
    """Buckets of the 1-, 2- and 3-byte runs that end at each byte after the first `before` (0 or 2), (3, n); runs of
    blanks count like any other."""
    x = _FOLD[raw].astype(np.uint32)
    one = x if before else np.concatenate((np.full(2, 32, np.uint32), x))
    x = one[2:]
    two, three = one[1:-1] << np.uint32(8) | x, one[:-2] << np.uint32(16) | one[1:-1] << np.uint32(8) | x
    shift = np.uint32(32 - LOG_BUCKETS)
    spread = lambda v, k: (v + np.uint32(k << 25)) * np.uint32(2654435761) >> shift
    return np.stack((spread(x, 0), spread(two, 1), spread(three, 2)))


def parts(raw: bytes) -> Iterator[np.ndarray]:
    """The buckets of a whole text, some at a time; each part takes the two bytes before it along."""
    bytes_ = np.frombuffer(raw, np.uint8)
    for at in range(0, len(bytes_), PART):
        yield grams(bytes_[max(0, at - 2) : at + PART], 2 if at else 0)


def histogram(raw: bytes) -> np.ndarray:
    """Shares of the buckets in a whole text, times 10."""
    out = np.zeros(1 << LOG_BUCKETS, np.float32)
    for buckets in parts(raw):
        out += np.bincount(buckets.ravel(), minlength=1 << LOG_BUCKETS) * (10 / len(raw))
    return out


def train_svm(products: np.ndarray, y: np.ndarray, rounds: int = 1000, penalty: float = 1e-5) -> tuple[np.ndarray, float]:
    """A linear support vector machine (squared hinge loss) by accelerated gradient steps, as coefficients of the rows,
    of which the inner products are given; y is 1 or -1; classes weigh the same however many rows they have."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    a, b, last_a, last_b = np.zeros(len(y)), 0.0, np.zeros(len(y)), 0.0
    step = 1.0 / (2 * (products.diagonal().max() + 1) + penalty)
    for i in range(rounds):
        speed = i / (i + 3)
        at_a, at_b = a + speed * (a - last_a), b + speed * (b - last_b)
        slack = np.maximum(0, 1 - y * (products @ at_a + at_b)) * y * weight
        last_a, last_b = a, b
        a, b = at_a - step * (penalty * at_a - 2 * slack), at_b + step * 2 * slack.sum()
    return a, float(b)


def gathered(lone: list[str], middle: dict[str, np.ndarray]) -> dict[str, list[str]]:
    """Families of languages of no known one: each by itself, or, if they are many, with those of the likest histograms."""
    if len(lone) <= LONE:
        return {lang: [lang] for lang in lone}
    out, left = {}, list(lone)
    while left:
        first = left[0]
        near = sorted(left, key=lambda x: (-float(middle[first] @ middle[x]) if x != first else -np.inf, x))[:GATHERED]
        out[f"like {first}"] = sorted(near)
        left = [x for x in left if x not in near]
    return out


def fit(named: list[str], x: np.ndarray) -> dict:
    """The machines of rows' languages and histograms: between families, and between the languages of each, all pairs."""
    of, langs = np.array(named), sorted(set(named))
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    middle = {lang: (x[of == lang] / np.maximum(norm[of == lang], 1e-9)).mean(axis=0) for lang in langs}
    groups = {f: [lang for lang in langs if lang in members] for f, members in FAMILIES.items()}
    groups = {f: found for f, found in groups.items() if found}
    groups |= gathered([lang for lang in langs if family_of(lang) == lang], middle)
    family = {lang: f for f, members in groups.items() for lang in members}
    families = np.array([family[lang] for lang in named])
    duels, weights = [], []
    for kind, pairs in ((families, combinations(sorted(groups), 2)), (of, (p for g in groups.values() for p in combinations(g, 2)))):
        for one, other in pairs:
            rows = np.flatnonzero((kind == one) | (kind == other))
            some = x[rows]
            a, bias = train_svm((some @ some.T).astype(np.float64), np.where(kind[rows] == one, 1.0, -1.0))
            duels.append((one, other, bias))
            weights.append((a * 10).astype(np.float32) @ some)
    return {"groups": groups, "duels": duels, "weights": np.array(weights, np.float32).reshape(len(duels), 1 << LOG_BUCKETS)}


def _winner(among: list[str], margins: dict[tuple[str, str], float]) -> tuple[str, float]:
    """The one with most duels won (ties: the larger sum of margins, then the first by name) and its chance in the duel
    that was closest for it."""
    if len(among) == 1:
        return among[0], 1.0
    own = {a: [margins[a, b] if (a, b) in margins else -margins[b, a] for b in among if b != a] for a in among}
    best = max(among, key=lambda a: (sum(m > 0 for m in own[a]), sum(own[a])))
    return best, float(1 / (1 + np.exp(-np.clip(3 * min(own[best]), -50, 50))))


def classify(raw: bytes, model: dict) -> tuple[str, float]:
    """Language and score of a whole text; `und` without a letter or a model."""
    if not model["groups"] or not _LETTER.search(raw.decode("utf-8", "replace")):
        return "und", 0.0
    total = np.zeros(len(model["duels"]))
    for buckets in parts(raw):
        for i, w in enumerate(model["weights"]):
            total[i] += w[buckets].sum(dtype=np.float64)
    margins = {(a, b): total[i] / len(raw) + bias for i, (a, b, bias) in enumerate(model["duels"])}
    family, p = _winner(list(model["groups"]), margins)
    lang, q = _winner(model["groups"][family], margins)
    return lang, p * q


def held_out(doc_id: str = "doc_id"):
    """Whether crc32(doc_id as text) mod 4 is 2 (a null doc_id: false, yet never learned from)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict:
    """Fits on a bounded sample of rows, whole texts: of each lang value the `per_language` rows (fewer, but LEAST_ROWS, if
    that made over SAMPLE_ROWS of all) with the smallest hash among those not held out. Every lang value is learned. The
    driver gets the rows' histograms, not their texts: 2**14 shares of a row at most."""
    rows = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "doc_id", "text")
    counts = staged(rows.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("count")))
    per_language = max(LEAST_ROWS, min(per_language, SAMPLE_ROWS // max(1, counts.count())))
    # A threshold on the hash leaves each language about three times the rows it needs, before any text is shuffled.
    spot = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1_000_000))
    near = join_sized(rows, counts, F.col("lang") == F.col("of")).where(spot < (F.least(F.lit(1.0), 3 * per_language / F.col("count")) * 1_000_000).cast("int") + 1)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(spot, "doc_id", F.xxhash64("text")))
    chosen = near.withColumn("n", rank).where(F.col("n") <= per_language).select("lang", "n", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [histogram(t.as_py()) for t in batch.column(2).cast(pa.binary())]
            at = [np.flatnonzero(x) for x in found]
            columns = [batch.column(0), batch.column(1), pa.array([a.astype(np.uint16).tobytes() for a in at], pa.binary()), pa.array([x[a].tobytes() for x, a in zip(found, at)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "n", "at", "shares"])

    sample = chosen.mapInArrow(run, "lang string, n int, at binary, shares binary").orderBy("lang", "n").toArrow()
    x = np.zeros((sample.num_rows, 1 << LOG_BUCKETS), np.float32)
    for row, at, shares in zip(x, sample.column(2).to_pylist(), sample.column(3).to_pylist()):
        row[np.frombuffer(at, np.uint16)] = np.frombuffer(shares, np.float32)
    return fit(sample.column(0).to_pylist(), x)


def identify(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """Per row of docs (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    score is the chance of the family times that of the language in it, each in its closest duel. Null texts and texts
    without a letter are `und` with score 0, as are all if nothing can be learned from. Whole texts are read. Rows that
    repeat a doc_id each get a prediction. An empty table gives no rows. Other columns are not read.
    """
    model = learn(docs) if model is None else model
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**14 floats for each pair of families, and of languages of one

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            found = [classify(t.as_py() or b"", sent.value) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, least: float = 0.05) -> DataFrame:
    """The rows of docs whose language is told: not `und`, and with a score of at least `least`. Each row is judged by
    itself, so nothing is shuffled. Null texts and texts without a letter go, as do all if nothing can be learned from;
    rows that repeat a doc_id each stay or go. Other columns pass through. An empty table gives no rows."""
    sent, at = docs.sparkSession.sparkContext.broadcast(learn(docs)), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (classify(t.as_py() or b"", sent.value) for t in batch.column(at).cast(pa.binary()))
            told = pa.array([lang != "und" and score >= least for lang, score in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(told) for c in batch.columns], names)

    names = docs.columns
    return docs.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, docs.schema)  # mapInArrow reads a dot in a name as a field
