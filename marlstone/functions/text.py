"""Scalar functions, Column to Column. None of them leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vocabularies, currencies and patterns that results depend on.
CANONICAL_TYPES = "invoice receipt payslip contract report cv letter email chat spreadsheet slide-deck note product other".split()
TYPE_SYNONYMS = {
    "slide_deck": "slide-deck", "slide deck": "slide-deck", "slidedeck": "slide-deck", "presentation": "slide-deck", "deck": "slide-deck",
    "csv": "spreadsheet", "excel": "spreadsheet", "xlsx": "spreadsheet", "table": "spreadsheet",
    "product_page": "product", "product page": "product", "product_description": "product", "product description": "product",
    "cover correspondence": "letter", "cover_letter": "letter", "correspondence": "letter",
    "resume": "cv", "curriculum vitae": "cv", "job_posting": "other", "job posting": "other", "assessment_plan": "report", "template": "other",
    "memo": "note", "pay slip": "payslip", "pay_slip": "payslip", "salary statement": "payslip", "salary summary": "payslip",
    "chat_export": "chat", "chat export": "chat", "transcript": "chat", "conversation": "chat", "message": "chat", "instant message": "chat",
    "agreement": "contract", "bill": "invoice",
}
TYPE_FOLDERS = {
    "invoice": "Invoices", "receipt": "Receipts", "payslip": "Payslips", "contract": "Contracts", "report": "Reports", "cv": "CVs & Resumes", "letter": "Letters",
    "email": "Email", "chat": "Chats & Transcripts", "spreadsheet": "Spreadsheets", "slide-deck": "Presentations", "note": "Notes", "product": "Product", "other": "Other",
}
CURRENCIES = "AUD USD GBP EUR JPY NZD CAD CHF CNY INR SGD HKD".split()
SYMBOLS = {"$": "AUD", "£": "GBP", "€": "EUR", "¥": "JPY"}
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
STOP_WORDS = (
    "the a an of for and or to in on at is are was were be with from this that my your his her its it any all what which when where who how do does did about "
    "much get got each every send sent out picked up as by me we so no if go us ok he she i"
).split()
MONEY = r"([$£€¥])?\s?(\d[\d,]*(?:\.\d+)?)\s?([A-Z]{3})?"
ISO_DATE = r"\b(\d{4})[-/](\d{1,2})[-/](\d{1,2})\b"
DMY_DATE = r"\b(\d{1,2})[-/.](\d{1,2})[-/.](\d{2,4})\b"
MONTH_DAY = r"\b([A-Za-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})\b"
DAY_MONTH = r"\b(\d{1,2})(?:st|nd|rd|th)?\s+([A-Za-z]{3,9})\.?,?\s+(\d{4})\b"


def lookup(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def words(text: Column) -> Column:
    """Lower-cased Unicode words."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), F.lit(1))


def word_count(text: Column) -> Column:
    """The size of words(), without making them."""
    return F.regexp_count(F.lower(text), F.lit(r"(?U)(\w+)"))


def content_terms(text: Column) -> Column:
    return F.filter(words(text), lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))


def tokens_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def canonical_type(raw: Column) -> Column:
    key = F.lower(F.trim(raw))
    norm = F.translate(key, "_ ", "--")
    return F.coalesce(lookup(TYPE_SYNONYMS, key), F.when(key.isin(*CANONICAL_TYPES), key), F.when(norm.isin(*CANONICAL_TYPES), norm), F.lit("other"))


def type_folder(kind: Column) -> Column:
    return F.coalesce(lookup(TYPE_FOLDERS, kind), F.lit("Other"))


def _group(text: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))


def parse_money(text: Column) -> Column:
    """(value, currency) of the first number, if a symbol or a known code marks it as money; else null."""
    code = _group(text, MONEY, 3)
    code = F.when(code.isin(*CURRENCIES), code)
    symbol = lookup(SYMBOLS, _group(text, MONEY, 1))
    value = F.regexp_replace(_group(text, MONEY, 2), ",", "").try_cast("double")
    unit = F.coalesce(code, symbol)
    return F.when(value.isNotNull() & unit.isNotNull(), F.struct(value.alias("value"), unit.alias("unit")))


def parse_number(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(r"^[-+]?\d[\d,]*(\.\d+)?$"), F.regexp_replace(trimmed, ",", "").try_cast("double"))


def _day(year: Column, month: Column, day: Column) -> Column:
    year = year.cast("int")
    year = F.when(year < 100, year + 2000).otherwise(year)
    return F.date_format(F.try_to_date(F.format_string("%04d-%02d-%02d", year, month.cast("int"), day.cast("int")), "yyyy-MM-dd"), "yyyy-MM-dd")


def parse_date(text: Column) -> Column:
    """ISO date of the first pattern that matches (ISO, day/month/year, month name first, day first); an impossible date
    of the first two is null without trying the others."""
    text = F.trim(text)
    iso = [_group(text, ISO_DATE, k) for k in (1, 2, 3)]
    a, b, y = (_group(text, DMY_DATE, k).cast("int") for k in (1, 2, 3))
    month = lambda name: lookup({m: str(k) for k, m in enumerate(MONTHS, 1)}, F.lower(F.substring(name, 1, 3)))
    named = lambda name: F.lower(name).rlike("^(" + "|".join(["jan(uary)?", "feb(ruary)?", "mar(ch)?", "apr(il)?", "may", "june?", "july?", "aug(ust)?", "sept?(ember)?", "oct(ober)?", "nov(ember)?", "dec(ember)?"]) + ")$")
    m1, m2 = _group(text, MONTH_DAY, 1), _group(text, DAY_MONTH, 2)
    return (
        F.when(iso[0].isNotNull(), _day(*iso))
        .when(a.isNotNull(), F.when((b > 12) & (a <= 12), _day(y, a, b)).otherwise(_day(y, b, a)))
        .when(m1.isNotNull() & named(m1), _day(_group(text, MONTH_DAY, 3), month(m1), _group(text, MONTH_DAY, 2)))
        .when(m2.isNotNull() & named(m2), _day(_group(text, DAY_MONTH, 3), month(m2), _group(text, DAY_MONTH, 1)))
    )


def looks_like_id(slug: Column) -> Column:
    s = F.regexp_replace(slug, "-", "")
    n = F.length(s)
    share = F.try_divide(n - F.length(F.regexp_replace(s, "[aeiou]", "")), n)
    return (n >= 6) & (((n >= 12) & (share < 0.22)) | (s.rlike("[0-9]") & (share < 0.30)))


def looks_like_name(text: Column) -> Column:
    digits = F.length(text) - F.length(F.regexp_replace(text, r"[0-9]", ""))
    return (F.length(text) >= 2) & text.rlike("[A-Za-z]{2,}") & (digits <= F.length(text) / 2)


def title(text: Column) -> Column:
    return F.initcap(F.trim(F.regexp_replace(text, r"[\s_-]+", " ")))


def clean_name(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(text, r'[/\\:*?"<>|]+', "")), "^[-—]+|[-—]+$", ""))


def year_of(card_date: Column, modified_at: Column) -> Column:
    first = lambda c: _group(c, "((19|20)[0-9]{2})", 1)
    return F.coalesce(first(card_date), first(modified_at), F.lit(""))


def canonical_filename(kind: Column, party: Column, ref: Column, date: Column, suggested: Column, original: Column) -> Column:
    """{Party} — {Type} {Id} — {Date}.ext if the type and one of party and date are known, else the suggestion or the original."""
    kind = canonical_type(kind)
    label = F.when(kind != "other", title(kind))
    party = F.nullif(title(clean_name(party)), F.lit(""))
    ref = F.nullif(clean_name(ref), F.lit(""))
    day = _group(date, r"(\d{4}-\d{2}-\d{2})", 1)
    ext = F.lower(F.regexp_extract(original, r"^.+(\.[^.]*)$", 1))
    name = F.concat(clean_name(F.concat_ws(" — ", party, F.concat_ws(" ", label, ref), day)), ext)
    return F.when(label.isNotNull() & (party.isNotNull() | day.isNotNull()), name).otherwise(F.coalesce(F.nullif(suggested, F.lit("")), original))


def normalised(text: Column) -> Column:
    """For containment: lower case, digit-group commas and gaps after currency signs removed, white space as one space."""
    t = F.regexp_replace(F.lower(text), r"(?<=\d),(?=\d)", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"([$£€])\s+", "$1"), r"\s+", " "))


def location(ref: Column) -> Column:
    """kind, start and end of a location text such as 'page 3' or 'rows 1-6'."""
    first = _group(ref, r"(\d+)", 1).cast("long")
    last = _group(ref, r"\d+\D+?(\d+)", 1).cast("long")
    kind = F.coalesce(_group(F.lower(ref), r"^(page|slide|rows|sheet|image|document)", 1), F.lit("other"))
    return F.struct(kind.alias("kind"), first.alias("start"), F.coalesce(last, first).alias("end"))


def page_of(ref: Column) -> Column:
    """The page number in a location text, or null."""
    return _group(ref, r"(?i)page\s+(\d+)", 1).try_cast("long")


#: Four or more single capitals with one space between neighbours.
_SPACED = r"(?U)(?<!\w)[A-Z] (?:[A-Z] ){2,}[A-Z](?!\w)"


def single_spaced(text: Column) -> Column:
    """Runs of spaces as one."""
    return F.regexp_replace(text, "  +", " ")


def squeezed(text: Column) -> Column:
    """Words of spaced-out capitals closed up, runs of spaces as one."""
    pieces, runs = F.split(text, _SPACED, -1), F.regexp_extract_all(text, F.lit(_SPACED), F.lit(0))
    closed = F.array_join(F.zip_with(pieces, runs, lambda a, b: F.concat(a, F.coalesce(F.replace(b, F.lit(" "), F.lit("")), F.lit("")))), "")
    return single_spaced(F.when(text.rlike(_SPACED), closed).otherwise(text))


def keep_extension(suggested: Column, filename: Column) -> Column:
    """A suggested name under the real extension of the file; without a suggestion the name it has."""
    split = r"^(.*?[^./][^/]*)(\.[^./]*)$"
    ext, name = F.regexp_extract(filename, split, 2), F.trim(suggested)
    root = F.coalesce(_group(name, split, 1), name)
    return F.when(F.coalesce(suggested, F.lit("")) == "", filename).when(ext == "", name).otherwise(F.concat(root, ext))


def suggestion(raw: Column) -> Column:
    """A category label of at most three plain words; empty if there are none or more than four."""
    plain = F.regexp_replace(F.lower(F.trim(raw)), "[^a-z0-9 /&-]", " ")
    parts = F.filter(F.split(plain, " "), lambda w: w != "")
    return F.when(F.size(parts).between(1, 4), F.array_join(F.slice(parts, 1, 3), " ")).otherwise("")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def sniff(content: Column) -> Column:
    """Format by magic bytes."""
    magic = F.hex(F.substring(content, 1, 8))
    kinds = (("25504446", "pdf"), ("7B5C727466", "rtf"), ("D0CF11E0", "ole"), ("FFD8FF", "jpeg"), ("89504E47", "png"), ("504B0304", "zip"))
    out = F.lit(None).cast("string")
    for start, kind in reversed(kinds):
        out = F.when(magic.startswith(start), kind).otherwise(out)
    return out
