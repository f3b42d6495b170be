"""Quality rules: figures of each text, and the frequency of its lines over the documents of a host."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, durable, native_hash, same, signed, table, text_bytes

SYMBOLS = "#*$%&|<>"
#: A line is boilerplate if over this share of a host's distinct texts hold it, and over so many.
MAX_SHARE, MAX_DOCS = 0.1, 10
#: The limits of the pipeline: a share that reaches lines of a few texts, and a number of texts that is always enough.
PIPELINE = {"max_share": 0.01, "max_docs": 10, "enough": 1000}
#: A document is depleted if over this share of its words stands in boilerplate lines.
MAX_LOST = 0.5


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more, the first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter([ids.setdefault(w, len(ids)) for w in words], np.int64, n)
    m = len(ids)
    if m == n:
        return 0
    if m < 1 << 21:
        key = (a[:-2] * m + a[1:-1]) * m + a[2:]
    else:
        pairs = np.unique(a[:-1] * m + a[1:], return_inverse=True)[1]
        key = pairs[:-1] * m + a[2:]
    order = np.argsort(key, kind="stable")
    same_as_next = key[order][1:] == key[order][:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same_as_next]] = True
    twice[order[:-1][same_as_next]] = True
    at = np.flatnonzero(twice)
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[at + k] = True
    return int(covered.sum())


def _stats_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: list[list] = [[] for _ in range(9)]
        for value in b.column(2):
            text = value.as_py() or ""
            raw = text_bytes(text)
            words = raw.split()
            lines = raw.split(b"\n")
            hashes, counts, nos, seen, dup = [], [], [], set(), 0
            for no, line in enumerate(lines):
                if parts := line.split():
                    dup += line in seen
                    seen.add(line)
                    norm = b" ".join(parts).decode("utf-8", "surrogatepass").lower()
                    hashes.append(signed(xxhash.xxh64_intdigest(text_bytes(norm))))
                    counts.append(len(parts))
                    nos.append(no)
            for c, v in zip(cols, (signed(xxhash.xxh64_intdigest(raw, 42)), len(words), len(text) - sum(text.count(c) for c in SPACES), sum(text.count(c) for c in SYMBOLS), dup, repeat_words(words), hashes, counts, nos), strict=True):
                c.append(v)
        kinds = [pa.int64()] * 6 + [pa.list_(pa.int64())] * 3
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_hash", "line_words", "line_no"])


def _judged(docs: DataFrame, max_share: float = MAX_SHARE, max_docs: int = MAX_DOCS, max_lost: float = MAX_LOST, enough: int | None = None) -> DataFrame:
    """judge() with the column drop: numbers of the lines that are boilerplate, null for none."""
    stats = durable(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), F.col("text").cast("string").alias("text")).mapInArrow(
            _stats_batches, "doc_id long, host string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_hash array<long>, line_words array<long>, line_no array<long>"
        )
    )
    texts = stats.groupBy("host", "text_hash").agg(F.first("line_hash").alias("line_hash"))
    hosts = texts.groupBy("host").agg(F.count("*").alias("n_texts"))
    # host in the key: one row for each distinct line of each distinct text, counted before the shuffle
    freq = texts.select("host", F.explode(F.array_distinct("line_hash")).alias("h")).groupBy("host", "h").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > max_docs)
    over = F.col("n_docs") > max_share * F.col("n_texts")
    if enough is not None:
        over |= F.col("n_docs") > enough
    common = same(freq, hosts, ["host"], "inner").where(over).select("host", "h")
    lines = stats.select("doc_id", "host", "text_hash", F.explode(F.arrays_zip(F.col("line_hash").alias("h"), F.col("line_words").alias("w"), F.col("line_no").alias("no"))).alias("l")).select("doc_id", "host", "text_hash", "l.h", "l.w", "l.no")
    lost = same(lines, common, ["host", "h"], "left_semi").groupBy("doc_id", "host", "text_hash").agg(F.sum("w").alias("lost"), F.collect_set("no").alias("drop"))
    # whole repeats of a row add up their lines: as many times as the row occurs
    times = stats.groupBy("doc_id", "host", "text_hash").agg(F.count("*").alias("times"))
    lost = same(lost, times, ["doc_id", "host", "text_hash"], "inner").select("doc_id", "host", "text_hash", (F.col("lost") / F.col("times")).cast("long").alias("lost_words"), "drop")
    out = same(stats.drop("line_hash", "line_words", "line_no"), lost, ["doc_id", "host", "text_hash"], "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    lost_words = F.coalesce("lost_words", F.lit(0))
    return out.select("doc_id", "text_hash", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), lost_words.alias("lost_words"), (~failed & (lost_words <= max_lost * F.col("n_words"))).alias("kept"), "drop")


def judge(docs: DataFrame, max_share: float = MAX_SHARE, max_docs: int = MAX_DOCS, max_lost: float = MAX_LOST, enough: int | None = None) -> DataFrame:
    """Figures and verdict for each row of docs(doc_id, text, source).

    base_failed: under 50 words, or over half of them in repeated 3-word windows. Else the method's verdict: lines are
    normalised (case, white space) and hashed; a line that over max_share of a host's distinct texts and over max_docs
    of them hold is removed, as is, where enough is given, one that over so many hold; a document that loses over max_lost of its words so is rejected. The host is the source
    (null: a host of its own). Exact copies count once, so a copied text doesn't condemn itself. Null text: as empty,
    which fails the base. Repeated rows get equal verdicts. Other columns are ignored. Columns: doc_id, text_hash,
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_words, kept.
    """
    return _judged(docs, max_share, max_docs, max_lost, enough).drop("drop")


def keep_good(docs: DataFrame, **limits: float) -> DataFrame:
    """The rows of docs that judge() keeps, without their boilerplate lines; limits: as of judge(). n_chars, where there
    is such a column, follows the text; a text without such lines and all other columns stay as they were."""
    good = _judged(docs, **limits).where("kept").select(F.col("doc_id").alias("__id"), F.col("host").alias("__host"), F.col("text_hash").alias("__hash"), F.col("drop").alias("__drop"))
    good = good.dropDuplicates(["__id", "__host", "__hash"])
    on = docs["doc_id"].cast("long").eqNullSafe(good["__id"]) & docs["source"].cast("string").eqNullSafe(good["__host"])
    out = docs.join(good, on & (native_hash(docs["text"]) == good["__hash"]))
    lines = F.filter(F.split(docs["text"].cast("string"), "\n", -1), lambda _, no: ~F.array_contains("__drop", no.cast("long")))
    cut = F.col("__drop").isNotNull()
    out = out.withColumn("text", F.when(cut, F.array_join(lines, "\n")).otherwise(docs["text"]))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[f"`{c}`" for c in docs.columns])


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
windows AS (SELECT rid, p, words[p] || ' ' || words[p + 1] || ' ' || words[p + 2] AS t FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS p FROM w)),
again AS (SELECT rid, p FROM windows QUALIFY count(*) OVER (PARTITION BY rid, t) > 1),
covered AS (SELECT rid, count(DISTINCT p + k) AS n_repeat_words FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
pieces AS (SELECT rid, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (SELECT rid, host, text, line, len(parts) AS n, lower(array_to_string(parts, ' ')) AS norm FROM (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS parts FROM pieces) WHERE len(parts) > 0),
dups AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY rid),
hosts AS (SELECT host, count(DISTINCT text) AS n_texts FROM d GROUP BY host),
freq AS (SELECT host, norm, count(DISTINCT text) AS n_docs FROM lines GROUP BY host, norm HAVING n_docs > 10),
common AS (SELECT f.host, norm FROM freq f JOIN hosts h ON f.host IS NOT DISTINCT FROM h.host WHERE n_docs > 0.1::DOUBLE * n_texts),
lost AS (SELECT rid, sum(n)::BIGINT AS lost_words FROM lines l JOIN common c ON l.host IS NOT DISTINCT FROM c.host AND l.norm = c.norm GROUP BY rid),
figures AS (SELECT d.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost_words, 0) AS lost_words
  FROM d JOIN w USING (rid) LEFT JOIN covered USING (rid) LEFT JOIN dups USING (rid) LEFT JOIN lost USING (rid)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM figures)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost_words <= 0.5 * n_words AS kept, lost_words FROM judged"""
