"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space bytes that end a word; bytes.split() without arguments uses exactly these.
SPACES = " \t\n\x0b\x0c\r"
#: One word, as a Java or Python pattern.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: While a table is written: a query's shuffle files go when the query ends, not when the driver next collects garbage; and
#: batches for Python workers are bounded by their bytes, since texts may be long.
_WHILE_WRITTEN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
#: Tables written by durable() that are still there, in order: folder and (session, number).
_written: dict[str, tuple[SparkSession, int]] = {}
_numbers = count()


def _folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ckpt-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage: write a table to the shared checkpoint folder and read it from there.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only on a local master that names none a
    temporary one is made. The table stays until drop() or drop_since(); shuffle files of the writing query go at its end.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in _WHILE_WRITTEN}
    try:
        for k, v in _WHILE_WRITTEN.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    _written[path] = spark, next(_numbers)
    out = spark.read.schema(df.schema).parquet(path)
    out.durable_path = path
    return out


def _remove(path: str) -> None:
    spark, _ = _written.pop(path)
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(to, True)


def drop(*tables: DataFrame) -> None:
    """Remove tables of durable() that nothing reads any more."""
    for t in tables:
        _remove(t.durable_path)


def mark() -> int:
    """The state that drop_since() goes back to."""
    return next(_numbers)


def drop_since(at: int, *keep: DataFrame) -> None:
    """Remove all tables written since mark() but those to keep."""
    kept = {t.durable_path for t in keep}
    for path in [p for p, (_, n) in _written.items() if n > at and p not in kept]:
        _remove(path)


def text_bytes(text: str | None) -> bytes:
    """UTF-8, lone surrogates included."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def signed(h: int) -> int:
    """An unsigned 64-bit number as Spark's long."""
    return h - (1 << 64) if h >> 63 else h


def native_hash(text: Column) -> Column:
    """XXH64 of a text with seed 42, null as empty; in Python: signed(xxh64_intdigest(text_bytes(t), 42))."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Null-safe equi-join; the right keys are dropped."""
    right = right.select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = [left[k].eqNullSafe(right[f"__r_{k}"]) for k in keys]
    return left.join(right, on, how).drop(*[f"__r_{k}" for k in keys])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (u, v) edges of longs, as (node, root): root is the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014). Each is one pre-aggregated minimum and one
    equi-join, so a hot centre is split by the skew join; each round is cut by a written table; the one before it goes.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = durable(edges)

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = mark(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v")))
        last, edges = edges, durable(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
        drop(last)
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
