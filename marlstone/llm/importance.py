"""Quality classifier by importance resampling.

Two generative models of hashed word unigrams and bigrams: of target text (documents that labels call good, at most
FIT_ROWS of them) and of raw text (all documents). A document's log importance is the mean over its n-grams of the
log-ratio of the two models, times SHARPNESS. Gumbel noise that depends on the document only turns the choice of the
k largest keys into a sample without replacement, weighted by importance (Xie et al., 2023).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, signed, table, text_bytes

BUCKETS, FIT_ROWS, SMOOTH = 1 << 14, 20_000, 1.0
SHARPNESS, KEEP, SEED = 150.0, 0.86, 7
#: Steps of the histogram that finds the k-th key.
STEPS = 4096


class Grams:
    """Hashed n-grams of a text, as bucket numbers; the hashes of words are remembered."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def of(self, text: str | None) -> np.ndarray:
        words = text_bytes(text).lower().split()
        if len(self.known) > 500_000:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter([known[w] for w in words], np.uint64, len(words))
        pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
        pairs ^= pairs >> np.uint64(29)
        half = np.uint64(BUCKETS // 2)
        return np.concatenate((h % half, half + pairs % half)).astype(np.int64)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams, total = Grams(), np.zeros(BUCKETS, np.int64)
    for b in batches:
        for v in b.column("text"):
            total += np.bincount(grams.of(v.as_py()), minlength=BUCKETS) if v.is_valid else 0
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(total)], ["bucket", "n"])


def model(docs: DataFrame) -> np.ndarray:
    """Log-probabilities of the buckets in docs(text); BUCKETS rows reach the driver."""
    out = np.full(BUCKETS, SMOOTH)
    for bucket, n in docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count_batches, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] += n
    half = out.reshape(2, -1)
    return np.log(half / half.sum(1, keepdims=True)).ravel()


def _weigh_batches(ratio: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for b in batches:
            w, h, n = [], [], []
            for v in b.column("text"):
                text = v.as_py()
                g = grams.of(text)
                w.append(float(ratio[g].mean()) if len(g) else float(ratio.min()))
                h.append(signed(xxhash.xxh64_intdigest(text_bytes(text), 42)))
                n.append((len(g) + 1) // 2)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(h, pa.int64()), pa.array(n, pa.int64()), pa.array(w, pa.float64())], ["doc_id", "hash", "n_words", "log_ratio"])

    return run


def largest(rows: DataFrame, key: str, share: float) -> Column:
    """Condition that holds for the share of rows with the largest keys; ties at the limit all pass. The limit comes from
    histograms of STEPS rows, each within the step of the last that holds it; driver and tasks see no more."""
    lo, hi, total = rows.agg(F.min(key), F.max(key), F.count(key)).first()
    want = round(share * total)
    if not want:
        return F.lit(False)
    above = 0
    while hi > lo:
        width = (hi - lo) / STEPS
        if lo + width <= lo or hi - width >= hi:
            break
        step = F.least(F.lit(STEPS - 1), F.floor((F.col(key) - lo) / width)).cast("long")
        counts = rows.where(F.col(key).between(lo, hi)).groupBy(step.alias("s")).agg(F.count("*"), F.min(key), F.max(key)).collect()
        for s in sorted(counts, reverse=True):
            if above + s[1] >= want:
                break
            above += s[1]
        if (s[2], s[3]) == (lo, hi):
            break
        lo, hi = s[2], s[3]
        if above + s[1] == want:
            hi = lo
    return F.col(key) >= lo


def resample(docs: DataFrame, target: DataFrame, keep: float = KEEP) -> DataFrame:
    """(doc_id, n_words, log_ratio, gumbel_key, kept) for each row of docs(doc_id, text); target(text).

    log_ratio: mean log-ratio of the target's and the raw model over the n-grams of the whole text; a text without words
    (null, empty) has the least that any n-gram has. kept: among the keep share with the largest keys. Noise hashes
    doc_id and text, so reruns agree and whole repeats fare alike. With no target text all ratios lean on the raw
    model alone. Other columns are ignored; an empty table gives an empty result.
    """
    ratio = model(target) - model(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_weigh_batches(ratio), "doc_id long, hash long, n_words long, log_ratio double")
    u = (F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "hash"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    rows = durable(rows.withColumn("gumbel_key", SHARPNESS * F.col("log_ratio") - F.log(-F.log(u))))
    return rows.select("doc_id", "n_words", "log_ratio", "gumbel_key", largest(rows, "gumbel_key", keep).alias("kept"))


def labelled_good(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """Texts of at most so many documents that labels call good and not toxic, chosen by a hash of doc_id."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").alias("__id")).distinct().orderBy(F.xxhash64("__id"), "__id").limit(rows)
    return docs.join(F.broadcast(good), docs["doc_id"] == good["__id"], "left_semi").select("text")


def op9_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return resample(docs, labelled_good(docs, table(spark, sf_dir, "labels")))
