"""Where queries are named, each with the SQL that gives the same rows, if there is one."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: documents as files, for the oracles.
FILES = "files AS (SELECT doc_id, concat_ws('/', source, lang, doc_id::VARCHAR) AS path, lang, source, text, octet_length(encode(text))::BIGINT AS size, sha1(text) AS hash FROM documents)"

#: The relational graph, for the oracles.
EDGES = """edges AS (
  SELECT DISTINCT * FROM (
    SELECT 'region:' || n_regionkey AS source_id, 'nation:' || n_nationkey AS target_id, 'contains' AS relation, 1.0::DOUBLE AS confidence FROM nation
    UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'contains', 0.95 FROM customer
    UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'contains', 0.95 FROM supplier
    UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'calls', 0.9 FROM orders
    UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'mentions', 0.75 FROM lineitem
    UNION ALL SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'tests', 0.5 FROM lineitem))"""

#: The lines of the documents, for the oracles.
LINES = "lines AS (SELECT doc_id, path, source, lang, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1))::BIGINT AS line_no FROM files)"
