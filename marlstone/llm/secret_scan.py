"""Secret scans: fixed patterns, and a randomness test battery over long tokens. DataFrame functions only.

Battery. A token's encoding is inferred from its characters. Against the uniform alphabet of that encoding run a
chi-squared test of the character counts, a runs test (changes between digits, lower case, upper case and others) and a
serial-correlation test of neighbouring character codes; a token that any of them rejects is not random. The same
counts give the evidence against plain text: fewer collisions than text has (chi-squared) and more class changes
(runs), joined by Fisher's rule. These p-values enter the Benjamini-Hochberg step-up rule over all tokens of the corpus,
weighted by length (Genovese, Roeder and Wasserman, 2006), since long tokens carry more evidence. The step-up runs on a
histogram of the weighted p-values in steps of a tenth of a decade, so at most BINS rows reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Tokens that the battery looks at.
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")
#: False-discovery rate; level at which the battery rejects randomness, in standard deviations.
RATE, REJECT = 0.001, 4.0
#: Of plain text: chance that two characters are equal, chance that neighbours differ in class.
TEXT_EQUAL, TEXT_CHANGE = 0.066, 0.08
BINS = 600


def _found(text: Column, pattern: str, kind: int, keep: str | None = None) -> Column:
    """Array of (start, kind, end, token) of a pattern's matches; keep: pattern that a match's group 2 fits entirely.

    Positions count code points: a match starts after the pieces that split() leaves before it and the matches before.
    """
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,token:string>>")
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if keep else whole
    gaps = F.transform(F.split(text, pattern, -1), lambda s: F.length(s).cast("bigint"))
    rows = F.arrays_zip(whole.alias("m"), value.alias("v"), F.slice(gaps, F.lit(1), F.size(gaps) - 1).alias("g"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out"))

    def step(acc: Column, row: Column) -> Column:
        at = acc["at"] + row["g"]
        end = at + F.length(row["m"])
        one = F.array(F.struct(at.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), row["m"].alias("token")))
        good = row["v"].rlike(keep) if keep else F.lit(True)
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(rows, start, step, lambda acc: acc["out"])).otherwise(empty)


def _phi(z: Column) -> Column:
    """Normal distribution function, its lower tail to a relative 1e-8: a continued fraction beyond 2, a series within."""

    def tail(x: Column) -> Column:
        a = F.abs(x)
        density = F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
        fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), a, lambda c, k: a + k / c)
        series = F.aggregate(F.sequence(F.lit(30), F.lit(1), F.lit(-1)), F.lit(1.0), lambda c, k: 1 + a * a / (2 * k + 1) * c)
        low = F.when(a < 2, 0.5 - density * a * series).otherwise(density / fraction)
        return F.when(x <= 0, low).otherwise(1 - low)

    return F.get(F.transform(F.array(z), tail), 0)  # z is worked out once


def _tested(token: Column) -> Column:
    """(random, p) of a token: whether the battery accepts randomness, and the evidence against plain text."""
    body = F.rtrim(F.replace(token, F.lit("="), F.lit(" ")))
    size = F.when(body.rlike("^[0-9]+$"), 10).when(body.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16).when(body.rlike("^[A-Z2-7]+$"), 32).when(body.rlike("^([a-z]+|[A-Z]+)$"), 26).when(body.rlike("^([a-z0-9]+|[A-Z0-9]+)$"), 36).when(body.rlike("^[A-Za-z0-9]+$"), 62).otherwise(64)
    n = F.length(body).cast("double")
    chars = F.split(body, "")
    equal = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(body, c)), F.lit(2)))
    chi = size / n * equal - n
    chi_z = (chi - (size - 1)) / F.sqrt(2.0 * (size - 1) * (n - 1) / n)
    kind = F.translate(F.translate(F.translate(body, "0123456789", "0" * 10), "abcdefghijklmnopqrstuvwxyz", "a" * 26), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A" * 26)
    kinds = F.translate(kind, "+/_-", "++++")
    changes = n - 1 - F.aggregate(F.sequence(F.lit(1), F.length(kinds) - 1), F.lit(0), lambda a, k: a + F.when(F.substring(kinds, k, F.lit(1)) == F.substring(kinds, k + 1, F.lit(1)), 1).otherwise(0))
    share = {10: 0.0, 16: 2 * 10 * 6 / 256, 26: 0.0, 32: 2 * 26 * 6 / 1024, 36: 2 * 10 * 26 / 1296, 62: 2 * (2 * 10 * 26 + 26 * 26) / 3844, 64: 2 * (2 * 10 * 26 + 26 * 26 + 2 * 62) / 4096}
    q = F.coalesce(*[F.when(size == k, v) for k, v in share.items()])
    runs_z = F.when(q > 0, (changes - (n - 1) * q) / F.sqrt((n - 1) * q * (1 - q))).otherwise(0.0)
    code = F.transform(chars, lambda c: F.ascii(c).cast("double"))
    mean = F.aggregate(code, F.lit(0.0), lambda a, c: a + c) / n
    around = F.transform(code, lambda c: c - mean)
    power = F.aggregate(around, F.lit(0.0), lambda a, c: a + c * c)
    lag = F.aggregate(F.zip_with(F.slice(around, F.lit(1), F.size(around) - 1), F.slice(around, F.lit(2), F.size(around) - 1), lambda a, b: a * b), F.lit(0.0), lambda a, c: a + c)
    serial_z = F.when(power > 0, lag / power * F.sqrt(n)).otherwise(F.lit(99.0))
    pairs = n * (n - 1) / 2 * TEXT_EQUAL
    p_equal = F.greatest(_phi(((equal - n) / 2 - pairs) / F.sqrt(2 * pairs)), F.lit(1e-12))
    p_runs = F.greatest(_phi(((n - 1) * TEXT_CHANGE + 0.5 - changes) / F.sqrt((n - 1) * TEXT_CHANGE * (1 - TEXT_CHANGE))), F.lit(1e-12))
    x = -F.log(p_equal) - F.log(p_runs)
    accepted = (chi_z < REJECT) & (F.abs(runs_z) < REJECT) & (F.abs(serial_z) < REJECT)
    return F.struct(accepted.alias("random"), (F.exp(-x) * (1 + x)).alias("p"))


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, base and added: arrays of (start, kind, end), sorted; positions in code points, end exclusive.

    base: matches of the fixed patterns (kinds 0 assign, 1 access, 2 hex), each kind leftmost and non-overlapping. added
    (kind 3): tokens of 20 or more characters that overlap no base match, that the battery accepts as random and whose
    evidence against plain text passes the step-up rule at the given rate. Null text: as empty. Repeated rows each give
    a row. Other columns are ignored; an empty table gives an empty result.
    """
    text = F.col("text")
    spans = "array<struct<start:bigint,kind:int,end:bigint>>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.array_sort(F.concat(_found(text, ASSIGN, 0, ".{6}"), _found(text, ACCESS, 1), _found(text, HEX, 2))).alias("base"), _found(text, TOKEN, 3).alias("tokens"))
    lone = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    tested = F.transform(lone, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), _tested(t["token"]).alias("test")))
    rows = durable(rows.select("doc_id", F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end"))).cast(spans).alias("base"), tested.alias("tested")))

    one = rows.select(F.explode("tested").alias("t")).select((F.col("t.end") - F.col("t.start")).alias("n"), F.col("t.test.random").alias("random"), F.col("t.test.p").alias("p"))
    mean = one.agg(F.avg("n")).first()[0] or 1.0
    bin_of = lambda p, n: F.least(F.lit(BINS), F.greatest(F.lit(0), F.floor(-10 * F.log10(F.least(F.lit(1.0), p * mean / n)))))
    bins = {int(r[0]): (int(r[1]), int(r[2])) for r in one.groupBy(bin_of(F.col("p"), F.col("n"))).agg(F.count("*"), F.count_if(F.col("random"))).collect()}
    total, above, least = sum(v[0] for v in bins.values()), 0, BINS + 1
    for at in sorted(bins, reverse=True):
        above += bins[at][0]
        if 10 ** (-at / 10) <= rate * above / total:
            least = at
    good = F.filter("tested", lambda t: t["test"]["random"] & (bin_of(t["test"]["p"], t["end"] - t["start"]) >= least))
    added = F.transform(good, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    return rows.select("doc_id", "base", added.cast(spans).alias("added"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", "added"))).alias("spans"))
