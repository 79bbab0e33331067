"""Secrets taken out of nested metadata."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.classify import REDACTIONS

# Keys whose values are never kept, and how deep and how many members of a collection are looked at.
SENSITIVE_KEY = re.compile(r"(?:api[_-]?key|token|secret|password|passwd|pwd|authorization|bearer)", re.I)
MOST_DEPTH, MOST_ITEMS = 8, 100
_PATTERNS = [(kind, re.compile(pattern)) for kind, pattern in REDACTIONS]


def _text(value: str) -> str:
    for kind, pattern in _PATTERNS:
        value = pattern.sub(f"[REDACTED:{kind}]", value)
    return value


def _walk(value, depth: int):
    if isinstance(value, str):
        return _text(value)
    if not isinstance(value, (dict, list)):
        return value
    if depth >= MOST_DEPTH:
        return "[REDACTED:metadata_depth]"
    if isinstance(value, list):
        return [_walk(x, depth + 1) for x in value[:MOST_ITEMS]]
    return {k: "[REDACTED:metadata]" if SENSITIVE_KEY.search(k) else _walk(x, depth + 1) for k, x in list(value.items())[:MOST_ITEMS]}


def redacted_json(text: str | None) -> str | None:
    """JSON without secrets, at any depth: values of sensitive keys, patterns in strings, what lies too deep, and members
    beyond the most; compact. What is no JSON is taken as a string."""
    if text is None:
        return None
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return json.dumps(_text(text), ensure_ascii=False)
    return json.dumps(_walk(value, 0), ensure_ascii=False, separators=(",", ":"))


def redacted_metadata(rows: DataFrame, metadata: str = "metadata") -> DataFrame:
    """rows with the JSON of a column redacted. Null stays null. Other columns pass through. A walk over values of any shape
    is no column expression, so it is a small function over Arrow batches; nothing is shuffled."""
    at, names = rows.columns.index(metadata), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([redacted_json(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], names)

    return rows.withColumn(metadata, F.col(metadata).cast("string")).mapInArrow(run, rows.schema)
