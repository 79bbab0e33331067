"""Every query beside its SQL, on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__

QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for name in os.listdir(sf):
        if name.endswith(".parquet"):
            connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return connection


def plain(value):
    if value is pd.NA or value is pd.NaT or value is None or isinstance(value, float) and math.isnan(value):
        return None
    value = value.item() if hasattr(value, "item") else value
    return round(value, 9) if isinstance(value, float) else str(value) if isinstance(value, pd.Timestamp) else value


def rows_of(frame):
    return sorted((tuple(map(plain, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, duck, name):
    ours, theirs = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and rows_of(ours) == rows_of(theirs)


@pytest.mark.parametrize("name", sorted(k for k in QUERIES if k not in ORACLES and not k.startswith("op") and k != "pipeline"))
def test_query_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_short_passages_are_found(spark, tmp_path):
    items = [(1, "one"), (2, "one two"), (3, "two three four fi"), (4, "one two three four fi"), (5, "absent here"), (6, "o")]
    docs = [(10, "zero one two three four five six"), (11, "two  three"), (12, "one"), (13, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.item_id, r.doc_id) for r in QUERIES["fts_phrase_route"](spark, str(tmp_path)).collect())
    connection = duckdb.connect()
    for name in ("benchmark", "documents"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert got == sorted(connection.execute(ORACLES["fts_phrase_route"]).fetchall()) and (3, 10) in got
