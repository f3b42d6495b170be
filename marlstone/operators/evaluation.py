"""Evaluation of retrieval and classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def retrieval_metrics(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """hits(query_id, id, rank) against gold(query_id, kind, want array): per kind the share of queries with a wanted hit
    among the first 1, 3, 5, 10, and the mean reciprocal rank."""
    rows = gold.join(hits, "query_id", "left").withColumn("good", F.array_contains("want", F.col("id")))
    first = rows.groupBy("query_id", "kind").agg(F.min(F.when(F.col("good"), F.col("rank"))).alias("first"))
    share = [F.round(F.avg((F.coalesce("first", F.lit(1 << 30)) <= k).cast("double")), 6).alias(f"hit_{k}") for k in (1, 3, 5, 10)]
    return first.groupBy("kind").agg(F.count("*").alias("n"), *share, F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def calibration(rows: DataFrame) -> DataFrame:
    """rows(label, pred, conf): per confidence, how many and the share that is right."""
    return rows.groupBy("conf").agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("pred")).cast("double")), 6).alias("accuracy"))


def confusions(rows: DataFrame, most: int = 8) -> DataFrame:
    return rows.where("label <> pred").groupBy("label", "pred").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label", "pred").limit(most)


def usage(events: DataFrame) -> DataFrame:
    """Per client: calls, units, first and last time, last tool."""
    return events.groupBy("client").agg(F.count("*").alias("calls"), F.round(F.sum(F.col("units").cast("decimal(18,4)")), 2).cast("double").alias("units"), F.min("ts").cast("string").alias("first_seen"), F.max("ts").cast("string").alias("last_seen"), F.max_by("tool", F.struct("ts", "event_id")).alias("last_tool"))


def pass_rates(rows: DataFrame) -> DataFrame:
    """rows(kind, passed): per kind how many and the share passed."""
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg(F.col("passed").cast("double")), 6).alias("rate"))


def payload_tokens(payload: Column) -> Column:
    """Tokens of a payload, by a quarter of its JSON's length."""
    return F.floor(F.length(F.to_json(payload)) / 4).cast("long")
