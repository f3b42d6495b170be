"""Cards: chunks of typed blocks, text for summaries, facts from entities, classification by signals, user pins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from .catalog_queries import capped_facts, first_per
from .documents import OVERLAP, WINDOW, card_facts

# Fixed values.
HEAD_CHUNKS, SAMPLES, LEAST_SAMPLE, GAP = 12, 4, 200, "\n\n[…]\n\n"
FORMAT_TYPES = {
    "csv": "spreadsheet", "tsv": "spreadsheet", "xlsx": "spreadsheet", "xls": "spreadsheet", "numbers": "spreadsheet",
    "pptx": "presentation", "ppt": "presentation", "key": "presentation", "eml": "email", "msg": "email",
}
FOLDER_TYPES = [
    (["invoices", "invoice"], "invoice"), (["receipts", "receipt"], "receipt"), (["contracts", "contract", "agreements"], "contract"),
    (["resumes", "resume", "cvs"], "cv"), (["study-designs", "study designs", "curriculum", "syllabus"], "reference"),
]
NEEDS_REVIEW = "needs-review"


def chunk_blocks(blocks: DataFrame, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of blocks(file_id, block, source_type, text): a table is one chunk, other blocks are cut into word windows;
    the index runs on over the blocks of a file."""
    text = X.squeezed(F.col("text"))
    rows = blocks.select("file_id", "block", "source_type", text.alias("text"), F.filter(F.split(text, r"\s+"), lambda x: x != "").alias("words"))
    last = F.greatest(F.lit(0), F.ceil((F.size("words") - window) / (window - overlap))).cast("int")
    windows = F.transform(F.sequence(F.lit(0), last), lambda k: F.array_join(F.slice("words", k * (window - overlap) + 1, F.lit(window)), " "))
    parts = F.when(F.col("source_type") == "table", F.array("text")).when(F.size("words") > 0, windows).otherwise(F.array().cast("array<string>"))
    rows = rows.select("file_id", "block", "source_type", F.posexplode(parts).alias("part", "text"))
    order = Window.partitionBy("file_id").orderBy("block", "part")
    return rows.select("file_id", (F.row_number().over(order) - 1).alias("chunk_index"), "source_type", "text", X.tokens_estimate(F.col("text")).alias("token_estimate"))


def summary_text(chunks: DataFrame, budget: int) -> DataFrame:
    """file_id, text for a summary of chunks(file_id, chunk_index from 0, text): the first chunks if they fit; else half the
    budget from the head and evenly spaced samples of later chunks, with a mark for each gap. Only chunks that are used
    are gathered, at most 16 a file."""
    n = chunks.groupBy("file_id").agg(F.count("*").cast("int").alias("n"))
    span, samples = F.col("n") - 1, F.least(F.lit(SAMPLES), F.col("n") - 1)
    picks = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(samples - 1, F.lit(0))), lambda i: (1 + F.bround(i * (span - 1) / F.greatest(F.lit(1), samples - 1))).cast("int")))
    rows = chunks.join(n.withColumn("picks", picks), "file_id")
    rows = rows.where((F.col("chunk_index") < HEAD_CHUNKS) | F.array_contains("picks", F.col("chunk_index").cast("int")))
    rows = rows.groupBy("file_id", "n", "picks").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("c"))
    texts = lambda keep: F.transform(F.filter("c", keep), lambda s: s["text"])
    head = F.array_join(texts(lambda s: s["chunk_index"] < HEAD_CHUNKS), "\n\n")
    rows = rows.withColumn("head", head)
    half = budget // 2
    per = F.greatest(F.lit(LEAST_SAMPLE), F.floor(F.lit(budget - half) / F.size("picks"))).cast("int")
    parts = F.concat(F.array(F.substring("head", 1, half)), F.transform(texts(lambda s: F.array_contains("picks", s["chunk_index"].cast("int"))), lambda t: F.substring(t, F.lit(1), per)))
    spread = F.substring(F.array_join(F.filter(parts, lambda p: F.trim(p) != ""), GAP), 1, budget + 64)
    return rows.select("file_id", F.when((F.length("head") <= budget) | (F.col("n") <= 2), F.substring("head", 1, budget)).otherwise(spread).alias("text"))


def entity_facts(entities: DataFrame, most: int = 500) -> DataFrame:
    """Typed facts of entities(file_id, entity_type, entity_value, entity_raw): money and dates by their parsed raw form,
    names that look like names, addresses and numbers as they are; what doesn't parse is no fact. One fact a value,
    at most so many a type and file, by value."""
    raw, value, kind = F.trim(F.coalesce(F.nullif("entity_raw", F.lit("")), "entity_value")), F.trim("entity_value"), F.col("entity_type")
    money, day = F.when(kind == "money", X.parse_money(raw)), F.when(kind == "date", X.parse_date(raw))
    good = money.isNotNull() | day.isNotNull() | kind.isin("email", "phone", "ref_number") | (kind.isin("person", "org", "location") & X.looks_like_name(value))
    rows = entities.where((value != "") & good)
    text = F.when(kind.isin("money", "date"), raw).otherwise(value)
    rows = rows.select(
        "file_id", kind.alias("fact_type"), kind.alias("key"), text.alias("value_text"), money["value"].alias("value_number"), day.alias("value_date"), money["unit"].alias("unit"), F.lit(0.6).alias("confidence"), value.alias("value"),
    )
    rows = first_per(rows, F.struct("file_id", "fact_type", "value"), F.col("value_text"))
    return capped_facts(rows, order="value", most=most).drop("value")


def assembled_facts(cards: DataFrame, entities: DataFrame) -> DataFrame:
    """All facts of a file, of its card and of its entities, with their source."""
    return card_facts(cards).withColumn("source", F.lit("card")).unionByName(entity_facts(entities).withColumn("source", F.lit("ner")))


def format_signal(filename: Column) -> Column:
    """The type that a file name's extension decides, or null."""
    return X.lookup(FORMAT_TYPES, F.regexp_extract(F.lower(filename), r"\.([^.]*)$", 1))


def path_prior(path: Column) -> Column:
    """The type that a whole component of the path suggests, or null; the first rule that fits."""
    parts = F.transform(F.split(F.translate(F.lower(path), "\\", "/"), "/"), lambda x: F.trim(x))
    return F.coalesce(*[F.when(F.arrays_overlap(parts, F.array(*map(F.lit, names))), slug) for names, slug in FOLDER_TYPES])


def classified(files: DataFrame, least_chars: int = 40) -> DataFrame:
    """file_id, document_type, confidence, reason by rules: format, then too little text, then the folder; what no rule
    decides needs review."""
    kind, prior = format_signal(F.col("filename")), path_prior(F.col("path"))
    thin = F.length(F.trim(F.coalesce("text", F.lit("")))) < least_chars
    slug = F.when(kind.isNotNull(), kind).when(thin | prior.isNull(), NEEDS_REVIEW).otherwise(prior)
    sure = F.when(kind.isNotNull(), "high").when(thin, "none").when(prior.isNotNull(), "medium").otherwise("low")
    why = F.when(kind.isNotNull(), "format").when(thin, "thin text").when(prior.isNotNull(), "folder").otherwise("undecided")
    return files.select("file_id", slug.alias("document_type"), sure.alias("confidence"), why.alias("reason"))


def reclassified(cards: DataFrame, verdicts: DataFrame, types: list[str]) -> DataFrame:
    """cards(file_id, document_type, confidence) after another pass over those of the given types: confidence is refreshed,
    the type changes where verdicts(file_id, document_type, confidence) differ. With scanned and changed."""
    new = verdicts.select("file_id", F.col("document_type").alias("new_type"), F.col("confidence").alias("new_confidence"))
    rows = cards.join(new, "file_id", "left").withColumn("scanned", F.col("document_type").isin(*types) & F.col("new_type").isNotNull())
    changed = F.col("scanned") & (F.col("new_type") != F.col("document_type"))
    return rows.select(
        "file_id", F.when(F.col("scanned"), F.col("new_type")).otherwise(F.col("document_type")).alias("document_type"),
        F.when(F.col("scanned"), F.col("new_confidence")).otherwise(F.col("confidence")).alias("confidence"), "scanned", changed.alias("changed"),
    )


def pinned(cards: DataFrame, pins: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """cards(file_id, document_type, confidence, note) with a user's pins(file_id, slug): a type of the taxonomy or the one
    for review is taken with high confidence; other slugs do nothing."""
    known = taxonomy.select("slug").distinct().unionByName(pins.sparkSession.createDataFrame([(NEEDS_REVIEW,)], "slug string"))
    good = pins.join(known, "slug", "left_semi").groupBy("file_id").agg(F.max("slug").alias("pin"))
    rows = cards.join(good, "file_id", "left")
    pick = lambda new, old: F.when(F.col("pin").isNotNull(), new).otherwise(F.col(old)).alias(old)
    return rows.select("file_id", pick(F.col("pin"), "document_type"), pick(F.lit("high"), "confidence"), pick(F.lit("user"), "note"))
