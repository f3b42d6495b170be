"""Browsing, typed facts, entities, facets: catalog reads as plain plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def scope(path: Column, folder: str | None) -> Column:
    """A folder and what is under it; None, blank, 'all' and '/' restrict nothing. Case-sensitive, no wildcards."""
    folder = (folder or "").strip().rstrip("/")
    if folder in ("", "all"):
        return F.lit(True)
    return (path == folder) | path.startswith(folder + "/")


def fact_filter(facts: DataFrame, fact_type=None, key=None, least=None, most=None, since=None, until=None, contains=None, folder=None) -> DataFrame:
    """Rows that meet every given condition; ranges are inclusive, contains ignores case."""
    c = F.col
    conditions = [
        (fact_type, lambda v: c("fact_type") == v), (key, lambda v: c("key") == v), (least, lambda v: c("value_number") >= v), (most, lambda v: c("value_number") <= v),
        (since, lambda v: c("value_date") >= v), (until, lambda v: c("value_date") <= v), (contains, lambda v: F.contains(F.lower("value_text"), F.lit(v.lower()))), (folder, lambda v: scope(c("path"), v)),
    ]
    return facts.where(reduce(lambda a, b: a & b, [f(v) for v, f in conditions if v is not None], F.lit(True)))


def fact_page(facts: DataFrame, by: str = "value_number", descending: bool = True, limit: int = 50, offset: int = 0) -> DataFrame:
    by = by if by in ("value_number", "value_date", "confidence") else "value_number"
    order = F.desc_nulls_last(by) if descending else F.asc_nulls_last(by)
    return facts.orderBy(order, "file_id", "fact_type").offset(offset).limit(limit)


def fact_aggregate(facts: DataFrame, op: str) -> DataFrame:
    """op over the distinct (content_hash, value_number, value_text); also how many rows and distinct hashes."""
    ops = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}
    if op not in ops:
        raise ValueError(f"unknown op {op}; supported: {', '.join(ops)}")
    rows = facts.select("content_hash", "value_number", "value_text").distinct()
    return rows.agg(F.round(ops[op]("value_number").cast("double"), 2).alias("value"), F.count("*").alias("n"), F.count_distinct("content_hash").alias("n_files"))


def headline(facts: DataFrame) -> DataFrame:
    """Per file the text of its largest money fact, else the year of its surest date."""
    money = F.max_by("value_text", F.when(F.col("fact_type") == "money", F.struct("value_number", "value_text")))
    date = F.max_by("value_date", F.when(F.col("fact_type") == "date", F.struct("confidence", "value_date")))
    return facts.groupBy("file_id").agg(F.coalesce(money, F.substring(date, 1, 4)).alias("headline"))


def browse(files: DataFrame, folder=None, status="indexed", limit=500, offset=0) -> DataFrame:
    rows = files.where(scope(F.col("path"), folder))
    rows = rows.where(F.col("status") == status) if status else rows
    return rows.orderBy(F.desc("modified_at"), "file_id").offset(offset).limit(limit)


def recent(files: DataFrame, now: str, days: int, limit: int = 50) -> DataFrame:
    since = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return files.where(F.col("modified_at") >= since).orderBy(F.desc("modified_at"), "file_id").limit(limit)


def entity_lookup(entities: DataFrame, value: str) -> DataFrame:
    """Files with an entity equal to value (trimmed, ignoring case); if there is none, with one that contains it."""
    v = value.strip().lower()
    name = F.lower("entity_value")
    rows = entities.where(F.contains(name, F.lit(v))).withColumn("tier", F.when(name == v, 0).otherwise(1))
    best = rows.agg(F.min("tier").alias("best"))
    rows = rows.join(F.broadcast(best), F.col("tier") == F.col("best"))  # one row
    return rows.groupBy("file_id", F.when(F.col("tier") == 0, "exact").otherwise("partial").alias("match_type")).agg(F.count("*").alias("n"))


def top_entities(entities: DataFrame, most: int = 15) -> DataFrame:
    groups = entities.groupBy("file_id", "entity_type", F.lower("entity_value").alias("name")).agg(F.count("*").alias("n"), F.min("entity_value").alias("entity_value"))
    order = Window.partitionBy("file_id").orderBy(F.desc("n"), "entity_type", "name")
    return groups.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("file_id", "entity_type", "entity_value", "n", "rank")


def facets(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    return rows.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy(F.concat(F.lit(prefix), F.col(column)).alias("facet")).agg(F.count("*").alias("n"))


def tag_facets(tags: DataFrame, file_tags: DataFrame) -> DataFrame:
    return tags.join(file_tags, "tag", "left").groupBy("tag").agg(F.count("file_id").alias("n"))


def suggestions(rows: DataFrame, known: DataFrame, least: int) -> DataFrame:
    """Labels that at least so many files share and that no known category has; with the file ids."""
    groups = rows.groupBy(F.lower(F.trim("label")).alias("label")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("file_id")).alias("ids")).where((F.col("n") >= least) & (F.col("label") != ""))
    return groups.join(known.select(F.lower("label").alias("label")), "label", "left_anti")


def folder_status(files: DataFrame) -> DataFrame:
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    return files.groupBy(folder.alias("folder")).agg(F.count_if(F.col("status") == "indexed").alias("indexed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count("*").alias("n"))


def index_status(files: DataFrame) -> DataFrame:
    return files.agg(
        F.count_if(F.col("status") == "indexed").alias("indexed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count("*").alias("n"),
        F.max("modified_at").cast("string").alias("newest"), F.sum("size_bytes").alias("bytes"), F.count_distinct("content_hash").alias("distinct_texts"),
    )


def neighbours(chunks: DataFrame, reach: int = 1) -> DataFrame:
    """Pairs of chunks of a file whose indexes differ by 1 to reach."""
    steps = F.explode(F.array(*[F.lit(k) for k in range(-reach, reach + 1) if k]))
    ask = chunks.select("file_id", "chunk_index", steps.alias("step")).withColumn("want", F.col("chunk_index") + F.col("step"))
    near = chunks.select(F.col("file_id").alias("f"), F.col("chunk_index").alias("want"), F.col("token_estimate").alias("neighbour_tokens"))
    return ask.join(near, (ask["file_id"] == near["f"]) & (ask["want"] == near["want"])).select("file_id", "chunk_index", "step", "neighbour_tokens")


def duplicates(files: DataFrame) -> DataFrame:
    """Of hashes with several files: each file with the group's size and its keeper, the best located path. Groups are
    never expanded into pairs."""
    key = F.struct(locatedness(F.col("path")).alias("penalty"), F.size(F.split("path", "/")).alias("depth"), F.col("path"))
    groups = files.groupBy("content_hash").agg(F.count("*").alias("group_size"), F.min_by("file_id", key).alias("keeper")).where("group_size > 1")
    return files.join(groups, "content_hash").select("file_id", "content_hash", "group_size", "keeper", (F.col("file_id") == F.col("keeper")).alias("kept"))


#: Folders of unsorted files.
JUNK = "misc,miscellaneous,untitled,new folder,new folder with items,downloads,desktop,stuff,temp,tmp,unsorted,to sort".split(",")


def locatedness(path: Column) -> Column:
    low = F.lower(path)
    folders = F.split(F.regexp_extract(low, "^(.*)/[^/]*$", 1), "/")
    junk = F.arrays_overlap(folders, F.array(*map(F.lit, JUNK)))
    return F.when(junk, 3).otherwise(0) + F.when(F.contains(low, F.lit("/downloads/")), 2).otherwise(0) + F.when(F.contains(low, F.lit("/desktop/")), 1).otherwise(0)


def file_tokens(chunks: DataFrame) -> DataFrame:
    total = F.sum("token_estimate")
    return chunks.groupBy("file_id").agg(F.when(total > 0, total).otherwise(F.floor(F.sum(F.length("text")) / 4)).cast("long").alias("tokens"))


def fact_counts(facts: DataFrame) -> DataFrame:
    """Per file a map from fact type to how many facts."""
    rows = facts.groupBy("file_id", "fact_type").agg(F.count("*").alias("n"))
    return rows.groupBy("file_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("fact_type", "n")))).alias("counts"))


def first_per(rows: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The first row of each key in the given order. Spark limits a
    window of rank 1 before the shuffle, to one row of a key from each task."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__at", F.row_number().over(w)).where("__at = 1").drop("__at")


def hash_or_own(file_id: Column, content_hash: Column) -> Column:
    """A key under which a file without a hash is a group of its own."""
    return F.coalesce(content_hash, F.concat(F.lit("id:"), file_id.cast("string")))


def stem(filename: Column) -> Column:
    return F.lower(F.regexp_replace(filename, r"\.[^.]*$", ""))


def best_chunk(chunks: DataFrame) -> DataFrame:
    """Per file its lowest chunk and that chunk's text."""
    return chunks.groupBy("file_id").agg(F.min("chunk_index").alias("chunk_index"), F.min_by("text", "chunk_index").alias("text"))


def head_text(chunks: DataFrame, most: int = 6) -> DataFrame:
    """Per file the texts of its first chunks in order, one a line."""
    w = Window.partitionBy("file_id").orderBy("chunk_index")
    rows = chunks.withColumn("__at", F.row_number().over(w)).where(F.col("__at") <= most)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"])  # at most so many a file
    return rows.groupBy("file_id").agg(F.count("*").alias("n"), F.array_join(parts, "\n").alias("text"))


def capped_facts(facts: DataFrame, owner: str = "file_id", order: str = "file_id", most: int = 500) -> DataFrame:
    """The first fact of each (owner, type, value) in the given order, and of those the first so many a type."""
    first = first_per(facts, F.struct(owner, "fact_type", "value_text"), F.col(order))
    w = Window.partitionBy(owner, "fact_type").orderBy(order, "value_text")
    return first.withColumn("__at", F.row_number().over(w)).where(F.col("__at") <= most).drop("__at")


def suffixed_keys(rows: DataFrame, owner: str, key: str, *order: str) -> DataFrame:
    """key made unique within its owner: key, key_2, key_3 in the given order."""
    at = F.row_number().over(Window.partitionBy(owner, key).orderBy(*order))
    return rows.withColumn("unique_key", F.when(at == 1, F.col(key)).otherwise(F.concat(key, F.lit("_"), at.cast("string"))))


def preview(hits: DataFrame, width: int = 300) -> DataFrame:
    """The beginning of the text and the day, as a listing shows them."""
    return hits.select("file_id", F.substring("text", 1, width).alias("preview"), F.substring(F.col("modified_at").cast("string"), 1, 10).alias("day"))


def unwatched(files: DataFrame, extensions: list[str]) -> DataFrame:
    """Files whose extension isn't among those (lower-case) watched."""
    return files.where(~F.lower("extension").isin(*extensions))


def scopes(path: Column, folders: list[str]) -> Column:
    """Whether a path is in one of the folders; of no folders, none."""
    return reduce(lambda a, b: a | b, [scope(path, f) for f in folders], F.lit(False))


def with_summary(files: DataFrame, summaries: DataFrame) -> DataFrame:
    """files with the columns of summaries(file_id, ...), null where a file has none."""
    return files.join(summaries, "file_id", "left")


def provenance(facts: DataFrame, files: DataFrame, summaries: DataFrame, chunks: DataFrame) -> DataFrame:
    """facts(file_id, chunk_index, ...) with the file they come from, and where there are, its summary and the chunk."""
    rows = facts.join(files.select("file_id", "filename", F.col("path").alias("file_path")), "file_id").join(summaries, "file_id", "left")
    return rows.join(chunks.select("file_id", "chunk_index", F.col("text").alias("chunk_text")), ["file_id", "chunk_index"], "left")


def page_of_hits(hits: DataFrame, offset: int, limit: int, factor: int = 4) -> DataFrame:
    """A page of hits(file_id, content_hash, score) after copies are gone: of factor times what is asked, the best of
    each hash, then offset and limit. A top-k report."""
    order = [F.desc("score"), F.col("file_id")]
    best = hits.orderBy(*order).limit(factor * (offset + limit))
    return first_per(best, hash_or_own(F.col("file_id"), F.col("content_hash")), *order).orderBy(*order).offset(offset).limit(limit)


def latest(rows: DataFrame, id_: str) -> DataFrame:
    """The row with the highest id."""
    return rows.orderBy(F.desc(id_)).limit(1)


def roots(files: DataFrame, home: str, preferred: list[str]) -> DataFrame:
    """root, preferred: the folder under home that holds each indexed file, or outside of home the file's own folder."""
    home = home.rstrip("/")
    inside = F.col("path").startswith(home + "/")
    first = F.concat(F.lit(home + "/"), F.split(F.substring("path", F.lit(len(home) + 2), F.length("path")), "/")[0])
    rows = files.where("status = 'indexed'").select(F.when(inside, first).otherwise(F.regexp_extract("path", "^(.*)/[^/]*$", 1)).alias("root")).distinct()
    return rows.withColumn("preferred", F.col("root").isin(*[f"{home}/{p}" for p in preferred]))


def by_frequency(rows: DataFrame, column: str) -> DataFrame:
    """Distinct values, the most frequent first by their place."""
    return rows.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def allowed(fields: Column, names: list[str]) -> Column:
    """A map without the keys that aren't named."""
    return F.map_filter(fields, lambda k, v: k.isin(*names) & v.isNotNull())


def hash_lookup(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """For wanted(content_hash) the least id of a file that has it, or null."""
    return wanted.select("content_hash").distinct().join(files.groupBy("content_hash").agg(F.min("file_id").alias("file_id")), "content_hash", "left")
