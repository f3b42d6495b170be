"""Document processing: chunks, entities, facts from cards, sections, cards, classification, checks of cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X

WINDOW, OVERLAP, LONG_WINDOW, LONG_CHARS = 512, 64, 1024, 20_000
# Patterns and vocabularies.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"\+?\d[\d\s().-]{7,}\d"
REFERENCE = r"(?i)\b(?:INV|REF|PO|#)[-#]?\d{3,}\b"
MONEY = r"[$£€]\s?\d[\d,]*(?:\.\d+)?"
LEGAL = r"(?i)\b(whereas|herein|hereby|indemnif)\b"
MONTH_DATE = r"(?i)\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}\b"
AMOUNT = r"(?i)[$£€]\s?\d[\d,]*(?:\.\d+)?(?:\s?(?:million|billion|trillion|bn|mn|[kmb]))?\b"
INJECTION = r"(?i)(ignore|disregard|forget)\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions?|prompts?|context)|reply\s+only\s+with|respond\s+only\s+with"
BOILERPLATE = r"(?i)(confidential|all rights reserved|copyright|©|page \d+|www\.|https?://|binding margin|do not write|@[\w.-]+\.\w+)"
DOC_START = (
    r"(?i)\b(tax invoice|invoice|statement of (claim|account)|account statement|receipt|remittance|purchase order|penalty|infringement|reminder notice|notice of|prescription|pharmacy|"
    r"medical centre|medical center|clinic|certificate|dear\s+\w|payslip|pay advice|claim|abn[:\s]|policy number|reference number|to the operator|from:|subject:|re:)"
)
TITLE_WORDS = [("invoice", "invoice"), ("purchase order", "invoice"), ("receipt", "receipt"), ("curriculum vitae", "cv"), ("non-disclosure", "contract"), ("terms and conditions", "contract"), ("agreement", "contract"), ("contract", "contract")]
NAME_WORDS = [("invoice", "invoice"), ("receipt", "receipt"), ("curriculum vitae", "cv")]
BODY_WORDS = [("invoice", "invoice"), ("contract", "contract"), ("letter", "letter"), ("report", "report")]
CONTAINER_TYPES = {"email": "email", "presentation": "slide-deck"}
PLACEHOLDERS = ["", "n/a", "na", "n.a", "not specified", "not stated", "not provided", "tbd", "unknown", "none", "null", "nil", "-", "—", "redacted", "[redacted]", "..", "todo", "tba"]
DUMP_KEYS = ["columns", "column_names", "column names", "headers", "fields"]
SECTION_RULE = {"overlap": 0.08, "least": 3, "most": 25, "median": 12, "starts": 0.5}


def long_form(text: Column, path: Column) -> Column:
    return (F.length(text) > LONG_CHARS) | F.contains(F.lower(path), F.lit("contract")) | text.rlike(LEGAL)


def chunk_windows(files: DataFrame, window: int = WINDOW, overlap: int = OVERLAP, long_window: int = LONG_WINDOW) -> DataFrame:
    """Word windows that step by window - overlap; the last ends at the last word. Long-form texts get long windows."""
    rows = files.select("file_id", "text", F.when(long_form(F.col("text"), F.col("path")), long_window).otherwise(window).alias("w"))
    rows = rows.select("file_id", "w", F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("words")).where("size(words) > 0")
    last = F.greatest(F.lit(0), F.ceil((F.size("words") - F.col("w")) / (F.col("w") - overlap))).cast("int")
    rows = rows.select("file_id", "w", "words", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    text = F.array_join(F.slice("words", F.col("chunk_index") * (F.col("w") - overlap) + 1, F.col("w")), " ")
    return rows.select("file_id", "chunk_index", text.alias("text")).withColumn("token_estimate", X.tokens_estimate(F.col("text")))


def regex_entities(files: DataFrame) -> DataFrame:
    """E-mail, phone, reference and money of each text; values lower-cased except money."""
    kinds = [("email", EMAIL), ("phone", PHONE), ("ref_number", REFERENCE), ("money", MONEY)]

    def found_of(kind: str, pattern: str) -> Column:
        row = lambda m: F.struct(F.lit(kind).alias("entity_type"), (m if kind == "money" else F.lower(m)).alias("entity_value"), m.alias("entity_raw"))
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), row)

    found = F.flatten(F.array(*[found_of(k, p) for k, p in kinds]))
    return files.select("file_id", F.explode(found).alias("e")).select("file_id", "e.*")


def card_facts(cards: DataFrame) -> DataFrame:
    """Typed facts of cards(file_id, key_facts map): money, date, number or attribute, in this order."""
    rows = cards.select("file_id", F.explode("key_facts").alias("key", "v")).where("v is not null and v <> ''")
    money, day, number = X.parse_money(F.col("v")), X.parse_date(F.col("v")), X.parse_number(F.col("v"))
    kind = F.when(money.isNotNull(), "money").when(day.isNotNull(), "date").when(number.isNotNull(), "quantity").otherwise("attribute")
    return rows.select(
        "file_id", "key", kind.alias("fact_type"), F.substring("v", 1, 500).alias("value_text"), F.coalesce(money["value"], F.when(day.isNull(), number)).alias("value_number"),
        F.when(money.isNull(), day).alias("value_date"), money["unit"].alias("unit"), F.when(kind == "attribute", 0.7).otherwise(0.8).alias("confidence"),
    )


def first_line(text: Column, least_words: int = 3) -> Column:
    """First line with so many words of letters and no boilerplate; else the first that isn't blank."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    good = F.filter(lines, lambda x: (F.size(F.regexp_extract_all(x, F.lit("[A-Za-z]{2,}"), F.lit(0))) >= least_words) & ~x.rlike(BOILERPLATE))
    return F.coalesce(F.get(good, 0), F.get(lines, 0), F.lit(""))


def section_anchor(text: Column, most: int = 18) -> Column:
    return F.array_join(F.slice(F.filter(F.split(first_line(text), r"\s+"), lambda x: x != ""), 1, most), " ")


def _first_hit(text: Column, rules: list[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for word, kind in reversed(rules):
        out = F.when(F.contains(text, F.lit(word)), kind).otherwise(out)
    return out


def heuristic_card(files: DataFrame) -> DataFrame:
    """anchor, document_type, amount and date of a text by rules alone."""
    head = F.substring("text", 1, 3000)
    anchor = F.array_join(F.slice(F.regexp_extract_all(F.substring(first_line(F.col("text")), 1, 200), F.lit(r"(?U)(\w+)"), F.lit(1)), 1, 25), " ")
    pick = lambda p: F.nullif(F.regexp_extract(head, p, 0), F.lit(""))
    return files.select("file_id", anchor.alias("anchor"), F.coalesce(_first_hit(F.lower(head), BODY_WORDS), F.lit("other")).alias("document_type"), pick(AMOUNT).alias("amount"), pick(MONTH_DATE).alias("date"), F.lit("degraded: heuristic fallback").alias("note"))


def fast_classify(files: DataFrame) -> DataFrame:
    """Container, then title line, then precise words of the file name; null defers to a model. Tables always defer."""
    name = F.lower("filename")
    heading = F.lower(F.substring(F.element_at(F.split(F.trim("text"), "\n"), 1), 1, 120))
    kind = F.coalesce(X.lookup(CONTAINER_TYPES, F.col("file_type")), F.when(~name.rlike(r"\.(csv|tsv)$"), F.coalesce(_first_hit(heading, TITLE_WORDS), _first_hit(name, NAME_WORDS))))
    return files.select("file_id", kind.alias("document_type"))


def composite(pages: DataFrame, rule: dict = SECTION_RULE) -> DataFrame:
    """Of pages(file_id, page, text): page count, median words, mean overlap of neighbours, share of pages that start like
    a document, and whether the file is a bundle."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))
    start = F.array_join(F.slice(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), 1, 6), "\n").rlike(DOC_START)
    rows = pages.groupBy("file_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), "\n").alias("text"))
    rows = rows.select("file_id", "page", words.alias("w"), start.alias("start"))
    before = F.lag("w").over(Window.partitionBy("file_id").orderBy("page"))
    both = F.size(F.array_intersect("w", "b"))
    rows = rows.withColumn("b", before).withColumn("sim", F.when(F.col("b").isNotNull(), F.when((F.size("w") == 0) | (F.size("b") == 0), 0.0).otherwise(both / F.greatest(F.lit(1), F.size(F.array_union("w", "b"))))))
    out = rows.groupBy("file_id").agg(F.count("*").alias("pages"), F.percentile(F.size("w"), 0.5).alias("median_words"), F.round(F.coalesce(F.avg("sim"), F.lit(1.0)), 6).alias("overlap"), F.round(F.avg(F.col("start").cast("double")), 6).alias("starts"))
    good = F.col("pages").between(rule["least"], rule["most"]) & (F.col("median_words") >= rule["median"]) & (F.col("overlap") <= rule["overlap"]) & (F.col("starts") >= rule["starts"])
    return out.withColumn("bundle", good)


def clean_facts(facts: Column) -> Column:
    """A card's map without placeholders, all-x values and table dumps; keys lose a leading total_."""
    value = lambda v: F.regexp_replace(F.lower(F.trim(v)), r"\.+$", "")
    kept = F.map_filter(facts, lambda k, v: ~value(v).isin(*PLACEHOLDERS) & ~value(v).rlike("^x{3,}$") & ~F.lower(F.trim(k)).isin(*DUMP_KEYS) & ~F.lower(F.trim(k)).rlike(r"^(sample\s+)?row\s*\d+$"))
    return F.transform_keys(kept, lambda k, v: F.when(k.startswith("total_") & (k != "total_rows"), F.substring(k, F.lit(7), F.length(k))).otherwise(k))


def containment(value: Column, source: Column) -> Column:
    """null if too vague to check; else whether the value, or each of its precise tokens, is in the source."""
    checkable = (F.length(value) >= 4) & value.rlike(r"\d|\b[A-Z][a-z]{2,}")
    v, s = X.normalised(value), X.normalised(source)
    tokens = F.filter(F.regexp_extract_all(v, F.lit(r"(?U)[\w$£€.]+"), F.lit(0)), lambda t: t.rlike(r"\d") | (F.length(t) > 3))
    return F.when(checkable, F.contains(s, v) | ((F.size(tokens) > 0) & F.forall(tokens, lambda t: F.contains(s, t))))


def scrub(text: Column) -> Column:
    """A text without the sentences that give instructions to a reader model."""
    kept = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: ~s.rlike(INJECTION))
    return F.when(text.rlike(INJECTION), F.trim(F.array_join(kept, " "))).otherwise(text)


def confidence_note(verified: Column, checked: Column, missing: Column, covered: Column) -> Column:
    return F.concat_ws("; ", F.when(checked > 0, F.format_string("verified %d/%d facts in source", verified, checked)), F.when(F.size(missing) > 0, F.concat(F.lit("unverified: "), F.array_join(F.slice(F.array_sort(missing), 1, 5), ", "))), F.when(covered < 50, F.format_string("covers %d%% of source", covered)))


def capped_confidence(level: Column, chars: Column) -> Column:
    """The lower of a model's confidence and what the amount of text allows (under 120 characters low, under 500 medium)."""
    order = F.array(*map(F.lit, ("none", "low", "medium", "high")))
    ceiling = F.when(chars >= 500, 4).when(chars >= 120, 3).otherwise(2)
    return F.element_at(order, F.least(F.array_position(order, level).cast("int"), ceiling))


def apply_edits(cards: DataFrame, edits: DataFrame) -> DataFrame:
    """cards(file_id, content_hash, document_type, key_facts) with edits(file_id, field, value, content_hash): fields are
    replaced, facts replaced or (null) deleted; which were verified by a user, and whether the text changed since."""
    latest = edits.groupBy("file_id", "field").agg(F.max_by(F.struct("value", "content_hash"), "edited_at").alias("e"))
    by_file = latest.groupBy("file_id").agg(
        F.max(F.when(F.col("field") == "document_type", F.col("e.value"))).alias("new_type"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("field").startswith("key_facts."), F.struct(F.expr("substring(field, 11)").alias("k"), F.col("e.value").alias("v")))))).alias("new_facts"),
        F.array_sort(F.collect_set("field")).alias("user_verified"),
        F.max("e.content_hash").alias("edit_hash"),
    )
    rows = cards.join(by_file, "file_id", "left")
    none = F.create_map().cast("map<string,string>")
    changes = F.coalesce("new_facts", none)
    kept = F.map_filter("key_facts", lambda k, v: ~F.map_contains_key(changes, k))
    return rows.select(
        "file_id", F.coalesce("new_type", "document_type").alias("document_type"), F.map_concat(kept, F.map_filter(changes, lambda k, v: v.isNotNull())).alias("key_facts"),
        F.coalesce("user_verified", F.array().cast("array<string>")).alias("user_verified"), F.coalesce(F.col("edit_hash") != F.col("content_hash"), F.lit(False)).alias("edit_drift"),
    )
