"""Incremental ingest: snapshots, merges, purges, clones, renames, and the work queue, as DataFrame projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .catalog_queries import scope

ATTEMPTS, BATCH, ERROR_CHARS = 3, 16, 2000
# Folders, prefixes and extensions of a scan.
SKIPPED = [".git", "__pycache__", ".venv", "venv", ".idea", ".vscode", "dist", "build", ".cache"]
DOCUMENTS = "pdf docx doc rtf odt txt md csv tsv xlsx xls ods pptx ppt json xml eml msg jpg jpeg png".split()


def watched(path: Column, prefixes: list[str], extensions: list[str] | None = None) -> Column:
    """Whether a scan takes a path: no hidden file, no skipped folder, under no excluded prefix, a known extension."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    skip = F.exists(parts, lambda p: p.isin(*SKIPPED) | p.endswith(".egg-info") | p.startswith("node_modules"))
    out = ~name.startswith(".") & ~skip & F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(*(extensions or DOCUMENTS))
    for p in prefixes:
        out = out & ~scope(path, p)
    return out


def scan_changes(stored: DataFrame, found: DataFrame) -> DataFrame:
    """path, kind of what differs between stored(path, content_hash) and found(path, content_hash); a deleted and a created
    path with the same hash are a rename."""
    both = stored.select("path", F.col("content_hash").alias("old")).join(found.select("path", F.col("content_hash").alias("new")), "path", "full")
    rows = both.where(~F.col("old").eqNullSafe(F.col("new"))).select("path", "old", "new", F.when(F.col("old").isNull(), "created").when(F.col("new").isNull(), "deleted").otherwise("modified").alias("kind"))
    gone = rows.where("kind = 'deleted'").groupBy(F.col("old").alias("new")).agg(F.min("path").alias("from_path"))
    rows = rows.join(gone, "new", "left")
    return rows.select("path", F.when((F.col("kind") == "created") & F.col("from_path").isNotNull(), "renamed").otherwise(F.col("kind")).alias("kind"), F.when(F.col("kind") == "created", F.col("from_path")).alias("from_path"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows, and the old ones whose key isn't among them."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"), allowMissingColumns=True)


def purge(rows: DataFrame, folder: str) -> DataFrame:
    return rows.where(~scope(F.col("path"), folder)) if folder.strip("/") else rows


def purge_children(rows: DataFrame, files: DataFrame) -> DataFrame:
    return rows.join(files.select("file_id"), "file_id", "left_semi")


def twins(files: DataFrame, chunk_counts: DataFrame) -> DataFrame:
    """For files that can be cloned: the smallest other id with the same hash and extension, indexed, with chunks. Each
    group is reduced to its two smallest ids first, so copies aren't paired."""
    ready = files.where("status = 'indexed'").join(chunk_counts.where("n > 0").select("file_id"), "file_id", "left_semi")
    order = Window.partitionBy("content_hash", "extension").orderBy("file_id")
    two = ready.withColumn("nth", F.row_number().over(order)).where("nth <= 2").groupBy("content_hash", "extension").agg(F.min("file_id").alias("a"), F.max("file_id").alias("b"))
    rows = files.join(two, ["content_hash", "extension"]).select("file_id", F.when(F.col("a") != F.col("file_id"), F.col("a")).when(F.col("b") != F.col("file_id"), F.col("b")).alias("twin"))
    return rows.where("twin is not null")


def clone(chunks: DataFrame, twin: DataFrame) -> DataFrame:
    """The chunks of twins, under the ids of the files that take them over."""
    return chunks.join(twin.select(F.col("twin").alias("file_id"), F.col("file_id").alias("to_id")), "file_id").withColumn("file_id", F.col("to_id")).drop("to_id")


def enqueue(queue: DataFrame, changes: DataFrame, reset_attempts: bool = False) -> DataFrame:
    """The queue with changes(path, kind, queued_at, priority, recency) pending. A path that is queued already keeps its
    attempts, unless reset."""
    new = changes.select("path", F.col("kind").alias("event_type"), "queued_at", F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("last_error"), "priority", "recency")
    if not reset_attempts:
        tried = queue.select("path", F.col("attempts").alias("tried"))
        new = new.join(tried, "path", "left").withColumn("attempts", F.coalesce("tried", "attempts")).drop("tried")
    return upsert(queue, new, "path")


def claim(queue: DataFrame, batch: int = BATCH, attempts: int = ATTEMPTS) -> DataFrame:
    """The next rows to work on: highest priority, then most recent, then longest queued."""
    rows = queue.where((F.col("status") == "pending") & (F.col("attempts") < attempts))
    rows = rows.orderBy(F.desc("priority"), F.desc("recency"), "queued_at", "path").limit(batch)
    return rows.withColumns({"status": F.lit("processing"), "attempts": F.col("attempts") + 1})


def recover(queue: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """After a crash: what was processing goes back; what has used its attempts has failed."""
    open_ = F.col("status").isin("pending", "processing")
    spent = open_ & (F.col("attempts") >= attempts)
    return queue.withColumns({
        "last_error": F.when(spent, F.coalesce("last_error", F.lit("attempts exhausted"))).otherwise(F.col("last_error")),
        "status": F.when(spent, "failed").when(F.col("status") == "processing", "pending").otherwise(F.col("status")),
    })


def settle(queue: DataFrame, results: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """Results(path, ok, transient, error): done, back to pending if a transient error has attempts left, else failed."""
    rows = queue.join(results, "path", "left")
    status = F.when(F.col("ok").isNull(), F.col("status")).when(F.col("ok"), "done").when(F.col("transient") & (F.col("attempts") < attempts), "pending").otherwise("failed")
    return rows.select("path", "event_type", "queued_at", status.alias("status"), "attempts", F.coalesce(F.substring("error", 1, ERROR_CHARS), "last_error").alias("last_error"), "priority", "recency")


def stale(files: DataFrame, version: int) -> DataFrame:
    """Files to process again: changed, or of an older index version."""
    return files.where((F.col("index_version") < version) | ~F.col("content_hash").eqNullSafe(F.col("seen_hash")))


def health(files: DataFrame, queue: DataFrame) -> DataFrame:
    """One row: files indexed, rows of the queue that are open, and whether the index is up to date."""
    open_ = F.col("status").isin("pending", "processing")
    counts = files.agg(F.count_if(F.col("status") == "indexed").alias("files_indexed")).crossJoin(queue.agg(F.count_if(open_).alias("queue_pending")))  # one row each
    return counts.withColumn("status", F.when(F.col("queue_pending") > 0, "indexing").otherwise("up_to_date"))


def runtime_counts(files: DataFrame, queue: DataFrame) -> DataFrame:
    """One row: files indexed and failed, queue rows pending and failed, megabytes of the files."""
    is_ = lambda v: F.count_if(F.col("status") == v)
    counts = files.agg(is_("indexed").alias("files_indexed"), is_("failed").alias("files_failed"), F.round(F.sum("size_bytes") / 1e6, 1).alias("size_mb"))
    return counts.crossJoin(queue.agg(is_("pending").alias("queue_pending"), is_("failed").alias("queue_failed")))  # one row each


def current(queue: DataFrame) -> DataFrame:
    """The row that is worked on, or is next: processing first, then priority, recency."""
    first = F.when(F.col("status") == "processing", 0).otherwise(1)
    return queue.where(F.col("status").isin("pending", "processing")).orderBy(first, F.desc("priority"), F.desc("recency"), "path").limit(1)
