"""Change streams: debounced file events, settled against the catalog; running usage counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUIET, LATE = "3 seconds", "10 minutes"


def debounced(events: DataFrame, quiet: str = QUIET) -> DataFrame:
    """events(path, kind, ts, seq): one row for each burst of a path that then is quiet; the last kind wins. Works on a
    batch and, with watermarked(), on a stream, where a burst comes out once the watermark has passed it."""
    return events.groupBy(F.session_window("ts", quiet).alias("w"), "path").agg(F.max_by("kind", F.struct("ts", "seq")).alias("kind"), F.count("*").alias("n")).select("path", F.col("w.start").cast("string").alias("started"), "kind", "n")


def watermarked(events: DataFrame, late: str = LATE) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def run_changes(events: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], quiet: str = QUIET):
    """Feed debounced changes to handle(batch, batch_id) until what is there is read."""
    return debounced(watermarked(events), quiet).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def counters(events: DataFrame) -> DataFrame:
    """Running usage per client, for update or complete mode."""
    return events.groupBy("client").agg(F.count("*").alias("calls"), F.sum("units").alias("units"), F.max("ts").alias("last_seen"))
