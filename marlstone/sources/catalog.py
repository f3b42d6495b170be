"""Catalog views over the raw tables: files, chunks, typed facts, entities, queue events, gold queries.

Each view has one mapping, given here for Spark and in plans/registry.py for SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(documents: DataFrame) -> DataFrame:
    """file_id, path, filename, extension, content_hash, size_bytes, modified_at, status; text stays for extraction."""
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return documents.select(
        F.col("doc_id").alias("file_id"),
        F.concat_ws("/", F.lit("/corpus"), "source", "lang", name).alias("path"),
        name.alias("filename"),
        F.lit("txt").alias("extension"),
        F.sha2("text", 256).alias("content_hash"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        F.expr(f"TIMESTAMP_NTZ'{EPOCH}' + make_dt_interval(0, cast(doc_id as int), 0, 0)").alias("modified_at"),
        F.when(F.col("n_chars") < 20, "failed").otherwise("indexed").alias("status"),
        "text",
    )


def facts(orders: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """Typed facts: a money and a date fact for each order, under /region/nation/customer/order."""
    place = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = orders.join(place, F.col("o_custkey") == F.col("c_custkey"))
    common = [
        F.col("o_orderkey").alias("file_id"),
        F.concat_ws("/", F.lit(""), "r_name", "n_name", F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))).alias("path"),
        F.concat_ws("-", F.col("o_custkey").cast("string"), "o_orderstatus").alias("content_hash"),
    ]
    none, text = F.lit(None), F.format_number("o_totalprice", 2)
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    kinds = F.array(
        F.struct(F.lit("money").alias("fact_type"), text.alias("value_text"), F.col("o_totalprice").alias("value_number"), none.cast("string").alias("value_date"), F.lit("AUD").alias("unit"), F.lit(0.8).alias("confidence")),
        F.struct(F.lit("date").alias("fact_type"), day.alias("value_text"), none.cast("double").alias("value_number"), day.alias("value_date"), none.cast("string").alias("unit"), F.lit(0.7).alias("confidence")),
    )
    return rows.select(*common, F.col("o_orderpriority").alias("key"), F.explode(kinds).alias("k")).select("file_id", "path", "content_hash", "key", "k.*")


def fact_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(*(table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region")))


def file_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(table(spark, sf_dir, "documents"))
