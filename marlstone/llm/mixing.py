"""Mixing sources to target weights over fixed-length token blocks. DataFrame functions only.

The words of a source are one stream, cut into blocks of BLOCK words. Every output shard has SLOTS slots; the counts of
sources in the shards are drawn together, as a multinomial given its totals (a pseudorandom permutation deals all slots
out), so that each source meets its target to half a block. The n-th slot of a source maps through the source's
own pseudorandom permutation to a block; the blocks are joined by their index. The permutations are swap-or-not
networks (Hoang, Morris and Rogaway, 2012), which work on any range and need no table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, durable, native_hash, table

BLOCK, SLOTS = 64, 256
#: By the rank of a source, repeating.
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
ROUNDS, SEED = 8, 20240
_CHUNK = 1 << 15
_BUCKET_DOCS = 256


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """A bijection of 0..n-1, another for each key."""

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), r, *key), n) - x, n)
        swap = F.pmod(F.xxhash64(F.lit(SEED + 1), r, *key, F.greatest(x, other)), F.lit(2)) == 1
        return F.when(swap, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), step)


def fill(sizes: list[int], weights: list[float], total: float, most: float = MOST) -> list[float]:
    """Shares of total by weight; none above most times its size, the excess reshared by weight."""
    out = [0.0] * len(sizes)
    left, weight = total, float(sum(weights))
    for k in sorted(range(len(sizes)), key=lambda k: most * sizes[k] / weights[k]):
        out[k] = min(most * sizes[k], left * weights[k] / weight) if left > 0 else 0.0
        left, weight = left - out[k], weight - weights[k]
    return out


def sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return durable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), native_hash(docs["text"]).alias("hash"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size")))


def plan(sizes: DataFrame) -> DataFrame:
    """One row a source: source, sid, source_size, target, n_blocks, n_slots, first_slot, all_slots. The only rows that
    the driver sees are these, one a source."""
    rows = sizes.groupBy("source").agg(F.sum("size")).collect()
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or ""))
    totals = [int(r[1] or 0) for r in rows]
    goal = fill(totals, [float(WEIGHTS[k % len(WEIGHTS)]) for k in range(len(rows))], SHARE * sum(totals))
    out, first = [], 0
    for k, (r, size, target) in enumerate(zip(rows, totals, goal, strict=True)):
        blocks = -(-size // BLOCK)
        slots = min(2 * blocks, round(target * blocks / size)) if size else 0
        out.append((r[0], k, size, target, blocks, slots, first))
        first += slots
    frame = sizes.sparkSession.createDataFrame(out, "source string, sid int, source_size long, target double, n_blocks long, n_slots long, first_slot long")
    return frame.withColumn("all_slots", F.lit(first).cast("long"))


def slots(sources: DataFrame, parts: int) -> DataFrame:
    """One row a slot: sid, block, shard, slot (its place in the shard)."""
    chunks = sources.where("n_slots > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_slots - 1) div {_CHUNK}"))).alias("chunk")).repartition(parts, "sid", "chunk")
    rows = chunks.select("*", F.explode(F.sequence(F.col("chunk") * _CHUNK, F.least(F.col("chunk") * _CHUNK + (_CHUNK - 1), F.col("n_slots") - 1))).alias("j"))
    epoch = F.expr("j div n_blocks")
    place = permuted(F.col("first_slot") + F.col("j"), F.col("all_slots"), F.lit(-1))
    return rows.select("sid", permuted(F.expr("j % n_blocks"), F.col("n_blocks"), F.col("sid"), epoch).alias("block"), F.floor(place / SLOTS).alias("shard"), (place % SLOTS).alias("slot"))


def placed(sizes: DataFrame) -> DataFrame:
    """sizes with start: the words before the document in its source's stream, which is in pseudorandom order."""
    buckets = max(1, sizes.count() // _BUCKET_DOCS)
    order = F.xxhash64(F.lit(SEED), "doc_id", "hash")
    rows = sizes.select("*", F.pmod(order, F.lit(buckets)).alias("bucket"), order.alias("order"))
    within = Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "hash").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("size").over(within))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rows = rows.join(sums, rows["source"].eqNullSafe(sums["b_source"]) & (rows["bucket"] == sums["b_bucket"]))
    return rows.select("doc_id", "source", "hash", "size", (F.col("before") + F.col("upto") - F.col("size")).alias("start"))


def _dealt(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents placed in the streams of their sources, and slots()."""
    sizes = sized(docs)
    sources = plan(sizes)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = placed(sizes)
    src = sources.select(F.col("source").alias("s_source"), "sid", "source_size", "target")
    rows = durable(rows.join(src, rows["source"].eqNullSafe(src["s_source"])).drop("s_source"))
    return rows, slots(sources, parts)


def mix(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of docs(doc_id, text, source): documents, one row each (doc_id, hash, size, source_size, target, taken, sid,
    start), and uses, one row for each block that a document reaches into and the mix takes (sid, start, lo, hi, uses:
    words lo to hi - 1 of the document are taken so often).

    A document's size is its number of words (null text: 0); its source may be null (a source of its own, last). Target
    shares follow WEIGHTS by rank of the source and SHARE of all words, at most MOST times a source. Blocks are taken
    at most twice, so no document gives over 2 times its size. All draws hash fixed seeds, ids and texts: reruns agree.
    Whole repeats of a row are documents of their own. Other columns are ignored; an empty table gives empty results.
    """
    rows, dealt = _dealt(docs)
    uses = dealt.groupBy("sid", "block").agg(F.count("*").alias("uses"))
    pieces = rows.where("size > 0").select("sid", "start", "size", F.explode(F.expr(f"sequence(start div {BLOCK}, (start + size - 1) div {BLOCK})")).alias("block"))
    # neither side's size has a bound: never a broadcast, at any size
    taken = pieces.hint("merge").join(uses, ["sid", "block"]).select(
        "sid", "start", F.greatest(F.lit(0), F.col("block") * BLOCK - F.col("start")).alias("lo"), F.least(F.col("size"), F.col("block") * BLOCK + BLOCK - F.col("start")).alias("hi"), "uses"
    )
    return rows, taken


def mixed(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of docs."""
    rows, taken = mix(docs)
    taken = taken.groupBy(F.col("sid").alias("t_sid"), F.col("start").alias("t_start")).agg(F.sum(F.expr("(hi - lo) * uses")).alias("n"))
    out = rows.join(taken, (rows["sid"] == taken["t_sid"]) & (rows["start"] == taken["t_start"]) & (rows["size"] > 0), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("n", F.lit(0)).cast("long").alias("taken"))


def shards(docs: DataFrame) -> DataFrame:
    """The output shards: (shard, slot, source, sid, block, text), one row for each slot of a shard, with the words of
    its block joined by spaces. All shards but the last have SLOTS slots, numbered from 0."""
    rows, dealt = _dealt(docs)
    # whole repeats of a row have one text and several places
    places = rows.where("size > 0").groupBy(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash"), F.col("source").alias("__source"), "sid", "size").agg(F.collect_list("start").alias("starts"))
    texts = docs.select(F.col("doc_id").cast("long").alias("__k_id"), native_hash(docs["text"]).alias("__k_hash"), F.col("source").cast("string").alias("__k_source"), F.col("text").cast("string").alias("text"))
    texts = texts.dropDuplicates(["__k_id", "__k_hash", "__k_source"])
    on = texts["__k_id"].eqNullSafe(places["__id"]) & (texts["__k_hash"] == places["__hash"]) & texts["__k_source"].eqNullSafe(places["__source"])
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    pieces = texts.join(places, on).select("sid", F.col("__source").alias("source"), "size", words.alias("words"), F.explode("starts").alias("start"))
    pieces = pieces.select("*", F.explode(F.expr(f"sequence(start div {BLOCK}, (start + size - 1) div {BLOCK})")).alias("block"))
    low, high = F.greatest(F.lit(0), F.col("block") * BLOCK - F.col("start")), F.least(F.col("size"), F.col("block") * BLOCK + BLOCK - F.col("start"))
    pieces = pieces.select("sid", "source", "block", "start", F.array_join(F.slice("words", (low + 1).cast("int"), (high - low).cast("int")), " ").alias("piece"))
    blocks = pieces.groupBy("sid", "source", "block").agg(F.array_sort(F.collect_list(F.struct("start", "piece"))).alias("pieces"))
    blocks = blocks.select("sid", "source", "block", F.array_join("pieces.piece", " ").alias("text"))
    return dealt.join(blocks, ["sid", "block"]).select("shard", "slot", "source", "sid", "block", "text")


def take(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of docs: of each document one row with the words taken once or more, and one
    more with those taken twice. A text taken whole stays as it is; of others the taken words are joined by a space.
    n_chars, where there is such a column, follows the text."""
    rows, taken = mix(docs)
    spans = taken.select("*", F.explode(F.sequence(F.lit(1), F.col("uses").cast("int"))).alias("copy")).groupBy("sid", "start", "copy").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"), F.sum(F.expr("hi - lo")).alias("n"))
    rows = rows.select("sid", "start", "size", F.col("doc_id").alias("__id"), F.col("hash").alias("__hash"), F.col("source").alias("__source"))
    rows = rows.where("size > 0").hint("merge").join(spans, ["sid", "start"]).select("__id", "__hash", "__source", "size", "start", "copy", "n", "spans")
    # whole repeats of a row share id, hash and source: each meets one of the rows' shares
    nth = Window.partitionBy("__id", "__hash", "__source", "copy").orderBy("start")
    shares = rows.withColumn("__nth", F.row_number().over(nth)).groupBy("__id", "__hash", "__source", "__nth").agg(F.collect_list(F.struct("size", "n", "spans")).alias("__shares"))
    keyed = docs.withColumns({"__k_id": F.col("doc_id").cast("long"), "__k_hash": native_hash(docs["text"]), "__k_source": F.col("source").cast("string")})
    keyed = keyed.withColumn("__k_nth", F.row_number().over(Window.partitionBy("__k_id", "__k_hash", "__k_source").orderBy("__k_hash")))
    on = keyed["__k_id"].eqNullSafe(shares["__id"]) & (keyed["__k_hash"] == shares["__hash"]) & keyed["__k_source"].eqNullSafe(shares["__source"]) & (keyed["__k_nth"] == shares["__nth"])
    both = keyed.join(shares.hint("merge"), on).withColumn("__share", F.explode("__shares"))
    words = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"({WORD})"), F.lit(1))
    cut = F.flatten(F.transform("__share.spans", lambda s: F.slice(words, (s["lo"] + 1).cast("int"), (s["hi"] - s["lo"]).cast("int"))))
    out = both.withColumn("text", F.when(F.col("__share.n") == F.col("__share.size"), F.col("text")).otherwise(F.array_join(cut, " ")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[f"`{c}`" for c in docs.columns])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))
