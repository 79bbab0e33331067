"""The corpus pipeline: language, near copies, repeated passages, mixing, pieces. Part of subpackage llm.

Every stage takes rows with any nulls, repeated doc_ids and further columns, and an empty table, which gives none. A stage
judges rows, not doc_ids: rows that repeat a doc_id with different texts are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanworks.llm import language, mixing, pieces, shingles, suffixes
from spanworks.llm.common import staged, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose language is told; null texts and texts without a letter go."""
    return language.identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8 or more), the first by doc_id, null last;
    of rows equal in doc_id and text one. Null and empty texts are one group."""
    return shingles.deduplicated(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows without the passages that occur earlier; n_chars follows the text. Rows left without a word go; rows with a
    null text stay; of rows equal in doc_id and text one stays."""
    return suffixes.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows as the mix has them, in training order, a row for each copy; rows without a word go."""
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each row's text; null for a null text."""
    return pieces.encoded(docs)


STAGES = [
    ("language", identify_language),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeated_passages),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: Trained machines, shingle hashes (XXH64) and piece paths are not SQL; a test compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
