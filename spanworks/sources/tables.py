"""Tables as files, lines, links, blocks and a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def repository(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, hash, text) of the text files under a folder, by Spark's binary source."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = folder.rstrip("/") + "/"
    path = F.regexp_replace(F.expr(f"substring(path, instr(path, '{root}') + {len(root)})"), r"^/+", "")
    return files.select(path.alias("path"), F.col("length").alias("size"), F.sha1("content").alias("hash"), F.decode("content", "UTF-8").alias("text"))


def files(spark: SparkSession, folder: str) -> DataFrame:
    """documents as files: doc_id, path (source/lang/doc_id), lang, source, text, size in bytes, hash."""
    docs = table(spark, folder, "documents")
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return docs.select("doc_id", path.alias("path"), "lang", "source", "text", F.octet_length("text").cast("long").alias("size"), F.sha1(F.col("text")).alias("hash"))


def lines(rows: DataFrame, text: str = "text") -> DataFrame:
    """The rows with a line each: line_no from 1, line."""
    keep = [c for c in rows.columns if c != text]
    return rows.select(*keep, F.posexplode(F.split(text, "\n", -1)).alias("_at", "line")).withColumn("line_no", (F.col("_at") + 1).cast("long")).drop("_at")


def page_links(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, ordinal, href) of each link of each page, ordinal from 1."""
    pages = table(spark, folder, "pages")
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", "url", F.posexplode(found).alias("_at", "href")).select("page_id", "url", (F.col("_at") + 1).cast("long").alias("ordinal"), "href")


def edges(spark: SparkSession, folder: str, once: bool = True) -> DataFrame:
    """(source_id, target_id, relation, confidence) between the relational tables; without `once`, edges may repeat."""
    of = lambda name: table(spark, folder, name)
    key = lambda kind, column: F.concat(F.lit(kind + ":"), F.col(column).cast("string"))
    rows = lambda df, a, b, relation, confidence: df.select(a.alias("source_id"), b.alias("target_id"), F.lit(relation).alias("relation"), F.lit(confidence).alias("confidence"))
    line = of("lineitem")
    found = (
        rows(of("nation"), key("region", "n_regionkey"), key("nation", "n_nationkey"), "contains", 1.0)
        .union(rows(of("customer"), key("nation", "c_nationkey"), key("customer", "c_custkey"), "contains", 0.95))
        .union(rows(of("supplier"), key("nation", "s_nationkey"), key("supplier", "s_suppkey"), "contains", 0.95))
        .union(rows(of("orders"), key("customer", "o_custkey"), key("order", "o_orderkey"), "calls", 0.9))
        .union(rows(line, key("order", "l_orderkey"), key("part", "l_partkey"), "mentions", 0.75))
        .union(rows(line, key("part", "l_partkey"), key("supplier", "l_suppkey"), "tests", 0.5))
    )
    return found.distinct() if once else found
