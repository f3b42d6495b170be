"""Organising: tags, plans of moves, conflicts, previews; and applying them, on the driver, with a journal."""

from __future__ import annotations

import hashlib
import json
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from .catalog_queries import locatedness

# Fixed values.
PARTY_STOP = (
    "inc ltd llc the and pty co corp company digital commission applicant respondent appellant page email subject attachment document draft final copy "
    "csv xlsx pdf board chair respondents vce opened viewed sent from"
).split()
PARTY_NOISE = r"(mailsuite|tracking|pixel|page-\d+|unsubscribe|-(from|opened|viewed|clicked|sent)$)"
EXCLUDED = ["/Library/", "/System/", "/.Trash/", "/node_modules/"]
PACKAGES = ["app", "rtfd", "bundle", "framework", "photoslibrary"]
LEAST_PARTY, MOST_PARTIES = 3, 2


def parties(entities: DataFrame) -> DataFrame:
    """Per file the slugs of its most frequent organisations that look like names, at most MOST_PARTIES."""
    groups = entities.groupBy("file_id", F.lower("entity_value").alias("name")).agg(F.count("*").alias("n"))
    rows = groups.withColumn("slug", X.slugify(F.col("name")))
    rows = rows.where((F.length("slug") >= LEAST_PARTY) & ~F.col("slug").isin(*PARTY_STOP) & ~F.col("slug").rlike(PARTY_NOISE) & ~X.looks_like_id(F.col("slug")))
    rows = rows.groupBy("file_id", "slug").agg(F.max("n").alias("n"))
    order = Window.partitionBy("file_id").orderBy(F.desc("n"), "slug")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= MOST_PARTIES).select("file_id", "slug", "rank")


def derive_tags(cards: DataFrame, parties_: DataFrame | None = None) -> DataFrame:
    """file_id, kind, slug, confidence from cards(file_id, document_type, card_date, status_text, modified_at)."""
    kind = F.struct(F.lit("type").alias("kind"), X.canonical_type(F.col("document_type")).alias("slug"), F.when(F.coalesce("document_type", F.lit("")) != "", 0.9).otherwise(0.4).alias("confidence"))
    surest = F.regexp_extract(F.coalesce("card_date", F.lit("")), "((19|20)[0-9]{2})", 1)
    year = F.struct(F.lit("year").alias("kind"), X.year_of(F.col("card_date"), F.col("modified_at")).alias("slug"), F.when(surest != "", 0.9).otherwise(0.6).alias("confidence"))
    status = F.struct(F.lit("status").alias("kind"), X.slugify(F.col("status_text")).alias("slug"), F.lit(0.6).alias("confidence"))
    rows = cards.select("file_id", F.explode(F.array(kind, year, status)).alias("t")).select("file_id", "t.*").where("slug <> ''")
    if parties_ is not None:
        rows = rows.unionByName(parties_.select("file_id", F.lit("party").alias("kind"), "slug", F.lit(0.7).alias("confidence")))
    return rows


def excluded(path: Column) -> Column:
    low = F.lower(path)
    out = F.lit(False)
    for s in EXCLUDED:
        out = out | F.contains(path, F.lit(s))
    return out | low.rlike(r"\.(" + "|".join(PACKAGES) + r")(/|$)")


def parent(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def root_of(files: DataFrame, roots: DataFrame) -> DataFrame:
    """file_id, root: the longest of roots(root) that holds the path, else its folder. Each path meets the roots by its
    own prefixes, so it is an equi-join."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    rows = files.select("file_id", "path", F.explode(prefixes).alias("prefix")).join(roots.select(F.regexp_replace("root", "/+$", "").alias("prefix"), F.lit(True).alias("is_root")), "prefix", "left")
    best = F.max_by("prefix", F.when(F.col("is_root"), F.length("prefix")))
    return rows.groupBy("file_id", "path").agg(best.alias("root")).select("file_id", F.coalesce("root", parent(F.col("path"))).alias("root"))


def plan(files: DataFrame, root: str) -> DataFrame:
    """Actions for files(file_id, path, filename, content_hash, document_type, card_date, party, ref, modified_at): the
    worse located of equal texts go to quarantine; others to root/Type/Year under their canonical name. Type 'other'
    stays in its folder. Columns: file_id, action, from_path, to_path, reason."""
    rows = files.where(~excluded(F.col("path")))
    best = Window.partitionBy("content_hash").orderBy(locatedness(F.col("path")), F.size(F.split("path", "/")), "path")
    rows = rows.withColumn("nth", F.row_number().over(best))
    kind = X.canonical_type(F.col("document_type"))
    year = X.year_of(F.col("card_date"), F.col("modified_at"))
    folder = F.when(kind == "other", parent(F.col("path"))).otherwise(F.concat_ws("/", F.lit(root.rstrip("/")), X.type_folder(kind), F.nullif(year, F.lit(""))))
    name = X.canonical_filename(F.col("document_type"), F.col("party"), F.col("ref"), F.col("card_date"), F.lit(None).cast("string"), F.col("filename"))
    to = F.when(F.col("nth") > 1, F.concat_ws("/", F.lit(root.rstrip("/") + "/Duplicates"), "filename")).otherwise(F.concat_ws("/", folder, name))
    action = F.when(F.col("nth") > 1, "quarantine_duplicate").when(to == F.col("path"), None).when(parent(to) == parent(F.col("path")), "rename").otherwise("move")
    reason = F.when(F.col("nth") > 1, "same content as a better located file").otherwise(F.concat(F.lit("type "), kind))
    return rows.select("file_id", action.alias("action"), F.col("path").alias("from_path"), to.alias("to_path"), reason.alias("reason")).where("action is not null")


def new_folders(plan_: DataFrame, existing: DataFrame) -> DataFrame:
    return plan_.select(parent(F.col("to_path")).alias("folder")).distinct().join(existing, "folder", "left_anti")


def conflicts(plan_: DataFrame, listing: DataFrame) -> DataFrame:
    """Why an action can't run: its source is missing, another action has its destination, or that exists already."""
    there = listing.select("path", F.lit(True).alias("there"))
    times = plan_.groupBy("to_path").agg(F.count("*").alias("times"))
    rows = plan_.join(times, "to_path").join(there.select(F.col("path").alias("from_path"), F.col("there").alias("source")), "from_path", "left").join(there.select(F.col("path").alias("to_path"), F.col("there").alias("target")), "to_path", "left")
    why = F.when(F.col("source").isNull(), "missing_source").when(F.col("times") > 1, "collision").when(F.col("target"), "exists")
    return rows.select("file_id", why.alias("conflict")).where("conflict is not null")


def folder_summary(plan_: DataFrame) -> DataFrame:
    return plan_.groupBy(parent(F.col("to_path")).alias("folder")).agg(F.count("*").alias("n"))


def counters(plan_: DataFrame) -> DataFrame:
    return plan_.groupBy("action").agg(F.count("*").alias("n"), F.count_distinct("to_path").alias("targets"))


def prunable(plans: DataFrame, journal: DataFrame, keep: int) -> DataFrame:
    """Drafts and previews without a journal row, beyond the newest."""
    rows = plans.where(F.col("status").isin("draft", "previewed")).join(journal.where("plan_id is not null").select("plan_id").distinct(), "plan_id", "left_anti")
    newest = rows.select("plan_id").orderBy(F.desc("plan_id")).limit(keep)
    return rows.join(newest, "plan_id", "left_anti").select("plan_id")


def merge_colours(current: Column, managed: Column, wanted: Column) -> Column:
    """Tags of a file after a sync: foreign ones stay, stale managed ones go, wanted ones come."""
    return F.array_distinct(F.concat(F.array_except(current, managed), wanted))


def tree(paths: list[str]) -> dict:
    """Nested folders with their files under '_files'; for small listings on the driver."""
    out: dict = {}
    for p in sorted(paths):
        *folders, name = [x for x in p.split("/") if x]
        node = out
        for f in folders:
            node = node.setdefault(f, {})
        node.setdefault("_files", []).append(name)
    return out


def _digest(path: Path) -> str:
    return hashlib.sha256(path.read_bytes()).hexdigest()


def apply_plan(actions: list[dict], journal: str) -> dict[str, int]:
    """Run moves in order, each written to the journal before it happens. Nothing is overwritten, a changed source is
    skipped, and a failure doesn't stop the rest. Runs on the driver only: tasks may be repeated."""
    done = {"done": 0, "skipped": 0, "failed": 0}
    with open(journal, "a") as log:
        for a in actions:
            source, target = Path(a["from_path"]), Path(a["to_path"])
            try:
                if not source.exists() or target.exists() or a.get("hash") not in (None, _digest(source)):
                    done["skipped"] += 1
                    continue
                print(json.dumps({"from": str(source), "to": str(target), "hash": _digest(source)}), file=log, flush=True)
                target.parent.mkdir(parents=True, exist_ok=True)
                os.rename(source, target)
                done["done"] += 1
            except OSError:
                done["failed"] += 1
    return done


def undo(journal: str) -> dict[str, int]:
    """Reverse a journal, the last move first; changed or occupied places are skipped."""
    done = {"done": 0, "skipped": 0}
    for row in reversed([json.loads(x) for x in Path(journal).read_text().splitlines()]):
        now, before = Path(row["to"]), Path(row["from"])
        if now.exists() and not before.exists() and _digest(now) == row["hash"]:
            before.parent.mkdir(parents=True, exist_ok=True)
            os.rename(now, before)
            done["done"] += 1
        else:
            done["skipped"] += 1
    return done
