"""The write side as merges: replaced children, renames, tags, edits, categories, watched roots, free destinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X

#: Fields of a card that a user may edit, beside its facts.
EDITABLE = ["summary_text", "one_line_anchor", "document_type", "suggested_filename"]
FACT_PREFIX = "key_facts."


def replaced(old: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """new, and the old rows of owners that have none in it: chunks or facts are replaced owner by owner."""
    return old.join(new.select(owner).distinct(), owner, "left_anti").unionByName(new)


def renamed(files: DataFrame, moves: DataFrame) -> DataFrame:
    """files with the path and file name of moves(file_id, to_path); nothing else changes."""
    rows = files.join(moves.select("file_id", "to_path"), "file_id", "left")
    rows = rows.withColumn("path", F.coalesce("to_path", "path"))
    return rows.withColumn("filename", F.when(F.col("to_path").isNull(), F.col("filename")).otherwise(F.element_at(F.split("to_path", "/"), -1))).select(*files.columns)


def ensured_tags(tags: DataFrame, wanted: DataFrame, source: str = "auto") -> DataFrame:
    """tags(name, kind, slug, source) and those of wanted(kind, slug) whose name, kind:slug, isn't among them."""
    new = wanted.select(F.concat_ws(":", "kind", "slug").alias("name"), "kind", "slug", F.lit(source).alias("source")).dropDuplicates(["name"])
    return tags.unionByName(new.join(tags.select("name"), "name", "left_anti"))


def auto_tagged(links: DataFrame, derived: DataFrame) -> DataFrame:
    """links(file_id, tag, source, confidence) after tagging: automatic links of the files tagged give way to
    derived(file_id, tag, confidence); a user's link keeps its source and takes the new confidence."""
    tagged = derived.select("file_id").distinct().withColumn("tagged", F.lit(True))
    kept = links.join(tagged, "file_id", "left").where((F.col("source") != "auto") | F.col("tagged").isNull()).select("file_id", "tag", "source", "confidence")
    both = kept.join(derived.select("file_id", "tag", F.col("confidence").alias("new")), ["file_id", "tag"], "full")
    return both.select("file_id", "tag", F.coalesce("source", F.lit("auto")).alias("source"), F.coalesce("new", "confidence").alias("confidence"))


def editable(field: Column) -> Column:
    return field.isin(*EDITABLE) | (field.startswith(FACT_PREFIX) & (F.length(field) > len(FACT_PREFIX)))


def set_edits(edits: DataFrame, new: DataFrame, files: DataFrame) -> DataFrame:
    """edits(file_id, field, value, edited_at, content_hash) after new(file_id, field, value, edited_at): one row a field
    of a file, the latest; the hash is the file's at the time. Fields off the card and unknown files are refused, which
    refused() gives."""
    rows = new.where(editable(F.col("field"))).join(files.select("file_id", "content_hash"), "file_id")
    value = F.max_by(F.struct("value", "edited_at", "content_hash"), F.struct("edited_at", "value")).alias("e")
    rows = rows.groupBy("file_id", "field").agg(value).select("file_id", "field", "e.*")
    return edits.join(rows.select("file_id", "field"), ["file_id", "field"], "left_anti").unionByName(rows)


def refused(new: DataFrame, files: DataFrame) -> DataFrame:
    known = files.select("file_id", F.lit(True).alias("known"))
    return new.join(known, "file_id", "left").where(~editable(F.col("field")) | F.col("known").isNull()).drop("known")


def cleared(edits: DataFrame, which: DataFrame) -> DataFrame:
    """edits without those of which(file_id, field)."""
    return edits.join(which, ["file_id", "field"], "left_anti")


def edit_dump(edits: DataFrame) -> DataFrame:
    """file_id, edits: a file's edits as a JSON list by field, of which a card has few."""
    one = F.array_sort(F.collect_list(F.struct("field", "value")))
    return edits.groupBy("file_id").agg(F.to_json(one, {"ignoreNullFields": "false"}).alias("edits"))


def root_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """root, change: what differs between two tables of watched roots(root)."""
    gone, come = old.select("root").subtract(new.select("root")), new.select("root").subtract(old.select("root"))
    return come.withColumn("change", F.lit("added")).unionByName(gone.withColumn("change", F.lit("removed")))


def with_category(categories: DataFrame, new: DataFrame) -> DataFrame:
    """categories(slug, label) after adding new(label): the slug names it, a known slug takes the new label."""
    rows = new.select(X.slugify(F.col("label")).alias("slug"), F.trim("label").alias("label")).where("slug <> ''").groupBy("slug").agg(F.max("label").alias("label"))
    return replaced(categories, rows, "slug")


def taxonomy(builtin: list[str], own: DataFrame) -> DataFrame:
    """slug, label, builtin, tier, at: the built-in types, then own(slug, label) that aren't among them by label, and
    'other' last; sort by tier, at, label."""
    names = own.sparkSession.createDataFrame([(s, s.replace("-", " ").title(), 2 if s == "other" else 0, k) for k, s in enumerate(builtin)], "slug string, label string, tier int, at int")
    rows = own.select("slug", "label").dropDuplicates(["slug"]).join(names.select("slug"), "slug", "left_anti")
    return names.withColumn("builtin", F.lit(True)).unionByName(rows.select("slug", "label", F.lit(1).alias("tier"), F.lit(0).alias("at"), F.lit(False).alias("builtin")))


def free_destinations(plan: DataFrame, listing: DataFrame) -> DataFrame:
    """file_id, to_path: no two alike and none in listing(path). The k-th file of a destination (by id) takes its k-th free
    name: 'a.pdf', 'a (2).pdf', 'a (3).pdf' and so on."""
    pattern = r"^(.*?[^./][^/]*?)( \((\d+)\))?(\.[^./]*)?$"
    taken = listing.select(F.regexp_replace("path", pattern, "$1$4").alias("to_path"), F.coalesce(F.nullif(F.regexp_extract("path", pattern, 3), F.lit("")).try_cast("long"), F.lit(1)).alias("n"))
    whole = listing.select(F.col("path").alias("to_path"), F.lit(1).cast("long").alias("n"))
    taken = taken.unionByName(whole).join(plan.select("to_path").distinct(), "to_path", "left_semi").groupBy("to_path").agg(F.array_sort(F.collect_set("n")).alias("taken"))
    order = Window.partitionBy("to_path").orderBy("file_id")
    rows = plan.select("file_id", "to_path", F.row_number().over(order).cast("long").alias("k")).join(taken, "to_path", "left")
    number = F.aggregate(F.coalesce("taken", F.array().cast("array<bigint>")), F.col("k"), lambda x, t: F.when(t <= x, x + 1).otherwise(x))
    stem, ext = F.regexp_extract("to_path", r"^(.*?[^./][^/]*)(\.[^./]*)$", 1), F.regexp_extract("to_path", r"^(.*?[^./][^/]*)(\.[^./]*)$", 2)
    name = F.when(stem == "", F.concat("to_path", F.lit(" ("), number.cast("string"), F.lit(")"))).otherwise(F.concat(stem, F.lit(" ("), number.cast("string"), F.lit(")"), ext))
    return rows.select("file_id", F.when(number == 1, F.col("to_path")).otherwise(name).alias("to_path"))
