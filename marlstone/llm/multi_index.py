"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves, each with its own codebook (k-means on at most FIT_ROWS vectors); a vector's cell is
the pair of its nearest centroids. A query walks the cells by the sum of its distances to both centroids (the
multi-sequence algorithm, a heap over two sorted lists) until the cells hold enough entries, and the entries are
reranked by exact distances. Equal vectors are one entry with its smallest ids, so copies never multiply the work.
Queries meet entries by first centroid, with the list of second centroids that they reached there; each meeting gives
only its best for each query, so no list of pairs is made.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, table

FIT_ROWS, CENTROIDS, ROUNDS = 20_000, 128, 12
#: A query's cells hold at least so many entries, and at least this share of all.
LEAST_ENTRIES, SHARE = 3000, 0.35
NEAREST = 10
#: Queries whose reached cells a worker holds at once, and entries and queries that meet in one task.
WALKS, BLOCK = 64, 4096


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Lloyd's algorithm from k distinct rows; empty centroids stay."""
    x = np.unique(x, axis=0)
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].astype(float)
    for _ in range(rounds):
        own = nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def gaps(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([gaps(x[at : at + 8192], c).argmin(1) for at in range(0, len(x), 8192)]) if len(x) else np.zeros(0, np.int64)


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """Cells (i * len(second) + j) by first[i] + second[j], until they hold enough entries or all are seen."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, out, held = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(second) + int(b[j])
        if counts[cell]:
            out.append(cell)
            held += int(counts[cell])
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (first[a[p]] + second[b[q]], p, q))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (vec_id, vector of doubles): vec_id, its bytes; -0.0 as 0.0. Vectors that take no part are left out."""
    for b in batches:
        ids, out = [], []
        for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            v = v.as_py()
            if i is not None and v and None not in v:
                x = np.asarray(v, "<f8") + 0.0
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    out.append(x.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["vec_id", "v"])


def _cell_batches(books: tuple[np.ndarray, np.ndarray]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = books[0].shape[1]
        for b in batches:
            x = _matrix(b.column("v"))
            i, j = (nearest(x[:, :cut], books[0]), nearest(x[:, cut:], books[1])) if len(x) else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([b.column("v"), b.column("low"), pa.array(i.astype(np.int64)), pa.array(j.astype(np.int64))], ["v", "low", "i", "j"])

    return run


def _walk_batches(books: tuple[np.ndarray, np.ndarray], counts: np.ndarray, enough: int) -> Callable:
    """Of distinct query vectors: for each first centroid that the walk reaches, the second centroids it reaches with it."""

    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = books[0].shape[1]
        for b in batches:
            x = _matrix(b.column("v"))
            near = (gaps(x[:, :cut], books[0]), gaps(x[:, cut:], books[1])) if len(x) else ([], [])
            vs, lows = b.column("v").to_pylist(), b.column("low").to_pylist()
            for at in range(0, len(vs), WALKS):
                rows = []
                for k in range(at, min(at + WALKS, len(vs))):
                    reached: dict[int, list[int]] = {}
                    for cell in walk(near[0][k], near[1][k], counts, enough):
                        reached.setdefault(cell // len(books[1]), []).append(cell % len(books[1]))
                    rows += [(vs[k], lows[k], i, js) for i, js in reached.items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], ["v", "q", "i", "js"])

    return run


def _rerank(most: int) -> Callable:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """Of the queries and the entries of a first centroid (and block): each query's best entries."""
        out: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            x, low, j = _matrix(right.column("v").combine_chunks()), right.column("low").to_numpy(), right.column("j").to_numpy()
            for q, y, js in zip(left.column("q").to_pylist(), _matrix(left.column("v").combine_chunks()), left.column("js").to_pylist(), strict=True):
                at = np.flatnonzero(np.isin(j, js))
                d = np.sqrt(((x[at] - y) ** 2).sum(1))
                best = np.lexsort((low[at], d))[:most]  # so many distinct entries hold the best
                out.append((np.full(len(best), q), low[at][best], d[best]))
        cols = [np.concatenate([o[k] for o in out]) if out else np.zeros(0) for k in range(3)]
        return pa.table({"q": pa.array(cols[0].astype(np.int64)), "low": pa.array(cols[1].astype(np.int64)), "score": pa.array(cols[2].astype(float))})

    return run


def search(vectors: DataFrame, is_query, nearest_n: int = NEAREST, share: float = SHARE, least: int = LEAST_ENTRIES, centroids: int = CENTROIDS) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of each query row, against all other rows.

    vectors(vec_id, embedding); is_query: a condition on vec_id. score is the Euclidean distance in doubles; ties go to
    the smaller vec_id. Vectors that are null, zero or hold null or non-finite components take no part, nor do rows
    without an id or of another length than most vectors. An id that repeats is only left out against itself; whole
    repeats count once. With fewer rows than nearest_n all are returned. An empty table gives an empty result.
    """
    packed = durable(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_pack_batches, "vec_id long, v binary"))
    sizes = packed.groupBy(F.length("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    spark = vectors.sparkSession
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    packed = packed.where(F.length("v") == sizes[0][0]).distinct()
    # the ids that can show: the smallest nearest_n + 1 of each distinct vector
    own = Window.partitionBy("v").orderBy("vec_id")
    ids = durable(packed.withColumn("at", F.row_number().over(own)).where(F.col("at") <= nearest_n + 1).select("v", "vec_id", F.min("vec_id").over(own).alias("low")))
    entries = ids.where("vec_id = low").select("v", "low")  # one for each distinct vector, named by its smallest id
    sample = _matrix(pa.array([bytes(r[0]) for r in entries.orderBy(F.xxhash64("v")).limit(FIT_ROWS).select("v").collect()], pa.binary()))
    cut = max(1, sample.shape[1] // 2)
    halves = (sample[:, :cut], sample[:, cut:] if sample.shape[1] > 1 else np.zeros((len(sample), 0)))
    books = (kmeans(halves[0], centroids), kmeans(halves[1], centroids, seed=1) if halves[1].shape[1] else np.zeros((1, 0)))
    celled = durable(entries.mapInArrow(_cell_batches(books), "v binary, low long, i long, j long"))
    counts = np.zeros(len(books[0]) * len(books[1]), np.int64)
    for i, j, n in celled.groupBy("i", "j").agg(F.count("*")).collect():  # at most centroids squared rows
        counts[i * len(books[1]) + j] = n
    enough = max(least, int(share * counts.sum()))

    queries = packed.where(is_query).join(entries, "v").select("v", "low", F.col("vec_id").alias("query_id"))
    queries = durable(queries)
    # a number of partitions that is stated isn't coalesced: a walk takes long for its few bytes
    distinct = queries.select("v", "low").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "v", "low").distinct()
    asked = distinct.mapInArrow(_walk_batches(books, counts, enough), "v binary, q long, i long, js array<long>")
    # the entries of a centroid are split into blocks, and so are the queries: each block of one meets all of the other
    e_blocks = max(1, int(counts.reshape(len(books[0]), -1).sum(1).max()) // BLOCK)
    q_blocks = max(1, queries.count() // BLOCK)
    asked = asked.select("*", F.pmod(F.xxhash64("q"), F.lit(q_blocks)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(e_blocks - 1))).alias("eb"))
    celled = celled.select("*", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"), F.pmod(F.xxhash64("low"), F.lit(e_blocks)).cast("int").alias("eb"))
    best = asked.groupBy("i", "qb", "eb").cogroup(celled.groupBy("i", "qb", "eb")).applyInArrow(_rerank(nearest_n + 1), "q long, low long, score double")
    order = Window.partitionBy("q").orderBy("score", "low")
    best = best.withColumn("at", F.row_number().over(order)).where(F.col("at") <= nearest_n + 1).select("q", "low", "score")
    # the entries' ids, then each query row without itself
    listed = best.join(ids.select("low", "vec_id"), "low")
    order = Window.partitionBy("q").orderBy("score", "vec_id")
    listed = listed.withColumn("at", F.row_number().over(order)).where(F.col("at") <= nearest_n + 1).select("q", "vec_id", "score")
    listed = listed.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("best"))  # nearest_n + 1 at most
    out = queries.join(listed, queries["low"] == listed["q"]).select("query_id", F.filter("best", lambda b: b["vec_id"] != F.col("query_id")).alias("best"))
    out = out.select("query_id", F.posexplode(F.slice("best", 1, nearest_n)).alias("at", "b"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
