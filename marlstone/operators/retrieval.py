"""Hybrid retrieval over a DataFrame of queries: vectors, keywords, fusion, boosts, reranking, gate, grouping.

One query and ten thousand are the same plan: keywords and vectors meet the corpus in blocks of queries per partition, each
partition keeping its own best k.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text as X

# Defaults that results depend on.
RRF_K, VECTOR_WEIGHT, KEYWORD_WEIGHT, SUMMARY_BOOST, NAME_BOOST = 60, 0.7, 0.3, 0.5, 0.15
KNN_K, BM25_K, POOL, GUARANTEED, PER_FILE = 50, 50, 24, 10, 3
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
FLOOR, LEXICAL_SHARE, LEXICAL_FLOOR, STRONG = 0.40, 0.34, 0.30, 0.55
CROSS_WEIGHT = 0.65
FUSED_SHARE, OVERLAP_SHARE, TEXT_CHARS, BACKFILL_FLOOR = 0.7, 0.3, 360, 0.12
#: Queries that meet a partition of vectors or texts at once, and terms of queries that do; more make further passes.
QUERY_BLOCK, TERM_BLOCK = 1024, 200_000
#: Distinct query terms up to which all tasks get them to count; more meet the words of the texts in a shuffle.
BROADCAST_TERMS = 200_000
#: Rows of words that a task scores at a time, and scores (texts times queries, and their terms) that it holds meanwhile.
SCORE_ROWS, SCORE_CELLS = 100_000, 2_000_000


def _block_search(ids: list, matrix: np.ndarray, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(ids)
        for b in batches:
            own = b.column(0).to_numpy()
            x = np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(float) if b.num_rows else np.zeros((0, matrix.shape[1]))
            for q, y in enumerate(matrix):
                d = np.sqrt(((x - y) ** 2).sum(1))
                all_ids, all_d = np.concatenate((best[q][0], own)), np.concatenate((best[q][1], d))
                at = np.lexsort((all_ids, all_d))[:k]
                best[q] = all_ids[at], all_d[at]
        out = [np.repeat(np.array(ids, np.int64), [len(i) for i, _ in best]), np.concatenate([i for i, _ in best]), np.concatenate([d for _, d in best])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["query_id", "id", "distance"])

    return run


def knn(queries: DataFrame, vectors: DataFrame, k: int = KNN_K, block: int = QUERY_BLOCK) -> DataFrame:
    """Exact nearest vectors(id, embedding) of each of queries(query_id, embedding): query_id, id, distance, rank from 1.
    Queries go out in blocks; a partition returns k rows a query, so what is shuffled doesn't grow with the corpus."""
    asked = [(r[0], r[1]) for r in queries.where("embedding is not null").select("query_id", "embedding").orderBy("query_id").toLocalIterator()]
    source = vectors.where("embedding is not null").select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    parts = [source.mapInArrow(_block_search([q for q, _ in part], np.array([v for _, v in part], float), k), "query_id long, id long, distance double") for part in (asked[at : at + block] for at in range(0, len(asked), block))]
    if not parts:
        return source.sparkSession.createDataFrame([], "query_id long, id long, distance double, rank int")
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _tokenized(chunks: DataFrame) -> DataFrame:
    """id, length, w (words) and n of chunks(id, text); n texts of one id and length are one row, rows of one id lie together."""
    w = F.col("w")
    texts = chunks.select(F.col("id").cast("long").alias("id"), X.words(F.col("text")).alias("w")).select("id", F.when(w.isNotNull(), F.size(w)).alias("length"), "w")
    twice = chunks.groupBy(F.col("id").cast("long").alias("id")).count().where("count > 1").select("id")
    if twice.isEmpty():
        return texts.withColumn("n", F.lit(1))
    merged = texts.join(twice, "id", "left_semi").groupBy("id", "length").agg(F.flatten(F.collect_list("w")).alias("w"), F.count("*").cast("int").alias("n"))
    return texts.join(twice, "id", "left_anti").withColumn("n", F.lit(1)).unionByName(merged.repartition("id").sortWithinPartitions("id", "length"))


def _frequencies(texts: DataFrame, terms: pa.Array) -> tuple[np.ndarray, int, float]:
    """In how many rows of _tokenized() each of terms is, how many texts there are and their mean length. The empty word,
    which no text has, stands for a whole text; only counts are shuffled."""
    wanted = texts.sparkSession.createDataFrame(pa.table({"term": pa.concat_arrays([terms, pa.array([""], terms.type)])}))
    marked = F.explode(F.array_union(F.coalesce("w", F.array().cast("array<string>")), F.array(F.lit(""))))
    rows = texts.select("n", "length", marked.alias("term")).join(F.broadcast(wanted) if len(terms) <= BROADCAST_TERMS else wanted, "term", "left_semi")
    found = rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("n_docs"), F.sum(F.col("n") * F.col("length")).alias("total"), F.sum(F.when(F.col("length").isNotNull(), F.col("n"))).alias("counted")).toArrow()
    at = pc.index_in(found["term"], value_set=terms).to_numpy()
    df = np.zeros(len(terms), np.int64)
    df[at[~np.isnan(at)].astype(np.int64)] = found["df"].to_numpy()[~np.isnan(at)]
    totals = found.filter(pc.equal(found["term"], "")).to_pylist()
    return df, totals[0]["n_docs"] if totals else 0, (totals[0]["total"] or 0) / (totals[0]["counted"] or 1) if totals else 0.0


def _block_scores(ids: pa.Array, starts: np.ndarray, asker: np.ndarray, weights: np.ndarray, mean_length: float, k: int) -> Callable:
    """Scores of whole texts from rows (id, length, term), those of a text together. Term t is asked by the queries
    asker[starts[t]:starts[t + 1]], numbers in ids, with so many weights. A task returns each query's best k."""
    n = len(ids)

    def cut(q: np.ndarray, own: np.ndarray, score: np.ndarray) -> tuple:
        at = np.lexsort((own, -score, q))
        q, own, score = q[at], own[at], score[at]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[keep], own[keep], score[keep]

    def scored(own: np.ndarray, length: np.ndarray, term: np.ndarray) -> Iterator[tuple]:
        other = own[1:] != own[:-1]
        doc, text = (np.concatenate(([0], np.cumsum(x))) for x in (other, other | (length[1:] != length[:-1])))
        key, at, tf = np.unique(text * (len(starts) - 1) + term, return_index=True, return_counts=True)
        own, doc, term = own[at], doc[at], term[at]
        part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[at] / mean_length))
        wide = starts[term + 1] - starts[term]
        cells = np.cumsum(np.bincount(doc, wide) + n)
        ends = np.flatnonzero(np.diff(cells // SCORE_CELLS, append=-1)) + 1
        for low, high in zip([0, *ends[:-1]], ends):
            a, b = np.searchsorted(doc, (low, high))
            row = np.repeat(np.arange(a, b), wide[a:b])
            at = np.arange(len(row)) - np.repeat(np.cumsum(wide[a:b]) - wide[a:b] - starts[term[a:b]], wide[a:b])
            sums = np.bincount((doc[row] - low) * n + asker[at], weights[at] * part[row], (high - low) * n)
            cell = np.flatnonzero(sums)
            first = np.searchsorted(doc, low + cell // n)
            yield cell % n, own[first], np.floor(sums[cell] * 1e6 + 0.5).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64),) * 3]
        least, size, held, rows, full = np.full(n, -1), 0, [], 0, SCORE_ROWS
        for b in itertools.chain(batches, [None]):
            if b is not None:
                held.append([b.column(c).to_numpy().astype(np.int64) for c in range(3)])
                rows += b.num_rows
                if rows < full:
                    continue
            if not rows:
                continue
            whole = [np.concatenate(c) for c in zip(*held)]
            end = rows if b is None else int(np.max(np.flatnonzero(np.diff(whole[0])) + 1, initial=0))  # the last text may go on
            held, rows = [[c[end:] for c in whole]], rows - end
            full = rows + SCORE_ROWS
            for q, own, score in scored(*(c[:end] for c in whole)) if end else ():
                good = score >= least[q]
                best.append((q[good], own[good], score[good]))
                size += int(good.sum())
                if size > max(SCORE_CELLS // 4, 4 * n * k):
                    best = [cut(*map(np.concatenate, zip(*best)))]
                    size = len(best[0][0])
                    of, count = np.unique(best[0][0], return_counts=True)
                    least[of[count == k]] = best[0][2][np.cumsum(count)[count == k] - 1]
        q, own, score = cut(*map(np.concatenate, zip(*best)))
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), pa.array(own), pa.array(score / 1e6)], ["query_id", "id", "score"])

    return run


def bm25(queries: DataFrame, chunks: DataFrame, k: int = BM25_K) -> DataFrame:
    """Keyword scores of queries(query_id, query) over chunks(id, text): query_id, id, score, rank; higher is better.
    Repeated query terms count repeatedly. Inverse document frequencies under LEAST_IDF are raised to it. Texts are read
    twice, for the frequencies and for the scores, and neither they nor their postings are shuffled: a task scores its own
    texts and returns k rows a query."""
    spark, kind = chunks.sparkSession, queries.schema["query_id"].dataType
    asked = queries.select("query_id", F.explode(F.filter(X.words(F.col("query")), lambda w: F.length(w) > 1)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times")).orderBy("query_id", "term").toArrow().combine_chunks()
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType())])
    if not asked.num_rows:
        return spark.createDataFrame([], T.StructType([*schema, T.StructField("rank", T.IntegerType())]))
    query, term = (asked[c].combine_chunks().dictionary_encode("encode") for c in ("query_id", "term"))
    texts = _tokenized(chunks)
    df, n_docs, mean_length = _frequencies(texts, term.dictionary)
    asker, of = query.indices.to_numpy().astype(np.int64), term.indices.to_numpy().astype(np.int64)
    weights = np.maximum(np.log((n_docs - df + 0.5) / (df + 0.5)), LEAST_IDF)[of] * asked["times"].to_numpy()
    last = np.searchsorted(asker, asker, "right")  # where the query of each row ends
    rows, at = None, 0
    while at < len(asker):
        end = min(np.searchsorted(asker, asker[at] + QUERY_BLOCK), max(last[at], last[last <= at + TERM_BLOCK].max(initial=0)))
        own, number = np.unique(of[at:end], return_inverse=True)
        by = np.argsort(number, kind="stable")
        starts = np.searchsorted(number[by], np.arange(len(own) + 1))
        numbers = spark.createDataFrame(pa.table({"term": term.dictionary.take(pa.array(own)), "number": pa.array(np.arange(len(own), dtype=np.int32))}))
        found = texts.select("id", "length", F.explode("w").alias("term")).join(F.broadcast(numbers), "term").select("id", "length", "number")
        ids = query.dictionary.slice(asker[at], asker[end - 1] - asker[at] + 1)
        part = found.mapInArrow(_block_scores(ids, starts, (asker[at:end] - asker[at])[by], weights[at:end][by], mean_length, k), schema)
        rows, at = part if rows is None else rows.unionByName(part), end
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fuse(vector: DataFrame, keyword: DataFrame, vector_weight: float = VECTOR_WEIGHT, keyword_weight: float = KEYWORD_WEIGHT) -> DataFrame:
    """Weighted reciprocal ranks: query_id, id, fused, and the rank in each arm."""
    arm = lambda df, w, v: df.select("query_id", "id", (F.lit(w) / (RRF_K + F.col("rank"))).alias("part"), F.when(F.lit(v), F.col("rank")).alias("vector_rank"), F.when(F.lit(not v), F.col("rank")).alias("keyword_rank"))
    rows = arm(vector, vector_weight, True).unionByName(arm(keyword, keyword_weight, False))
    return rows.groupBy("query_id", "id").agg(F.sum("part").alias("fused"), F.min("vector_rank").alias("vector_rank"), F.min("keyword_rank").alias("keyword_rank"))


def name_terms(query: Column) -> Column:
    """Distinct lower-cased words between spaces: longer than 2, or of 2 and no stop word; the first 32."""
    parts = F.filter(F.split(F.lower(query), r"\s+"), lambda w: (F.length(w) > 2) | ((F.length(w) == 2) & ~w.isin(*X.STOP_WORDS)))
    return F.slice(F.array_distinct(parts), 1, 32)


def boosted(fused: DataFrame, queries: DataFrame, names: DataFrame, boost: float = NAME_BOOST) -> DataFrame:
    """fused with a boost for each query term that names(id, filename) contains, for candidates only."""
    rows = fused.join(queries.select("query_id", name_terms(F.col("query")).alias("terms")), "query_id").join(names, "id", "left")
    hits = F.size(F.filter("terms", lambda t: F.contains(F.lower(F.coalesce("filename", F.lit(""))), t)))
    return rows.withColumn("fused", F.col("fused") + boost * hits).drop("terms", "filename")


def summary_boosted(fused: DataFrame, summaries: DataFrame, boost: float = SUMMARY_BOOST) -> DataFrame:
    """fused plus boost / (60 + rank) of each id that is in the summary arm(query_id, id, rank)."""
    extra = summaries.select("query_id", "id", (F.lit(boost) / (RRF_K + F.col("rank"))).alias("extra"))
    return fused.join(extra, ["query_id", "id"], "full").withColumn("fused", F.coalesce("fused", F.lit(0.0)) + F.coalesce("extra", F.lit(0.0))).drop("extra")


def pool(fused: DataFrame, size: int = POOL, guaranteed: int = GUARANTEED) -> DataFrame:
    """The best by fused score and the first of each arm."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("fused", 9)), "id")
    rows = fused.withColumn("fused_rank", F.row_number().over(order))
    return rows.where((F.col("fused_rank") <= size) | (F.col("keyword_rank") <= guaranteed) | (F.col("vector_rank") <= guaranteed))


def match_window(text: Column, terms: Column, width: int = TEXT_CHARS) -> Column:
    """width characters around the first whole-word hit of a term, a third of them before it; else the head."""
    low = F.lower(text)
    at = F.array_min(F.filter(F.transform(F.filter(terms, lambda t: F.contains(low, t)), lambda t: F.regexp_instr(low, F.concat(F.lit(r"(?U)\b\Q"), t, F.lit(r"\E\b")))), lambda p: p > 0))
    start = F.greatest(F.lit(0), F.least(at - 1 - width // 3, F.length(text) - width))
    return F.when(F.length(text) <= width, text).when(at.isNull(), F.substring(text, 1, width)).otherwise(F.substring(text, start + 1, F.lit(width)))


def with_top(fused: DataFrame) -> DataFrame:
    return fused.withColumn("top_fused", F.max("fused").over(Window.partitionBy("query_id")))


def rerank(candidates: DataFrame, queries: DataFrame, texts: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """relevance = 0.7 fused / highest fused + 0.3 share of the query's words in the match window.
    top_fused, of with_top(), is the highest over all fused scores, not only the candidates. more(query_id, more) gives
    further terms to place the match window by."""
    asked = queries.select("query_id", "query", X.content_terms(F.col("query")).alias("terms"), F.array_distinct(F.filter(F.split(F.lower("query"), r"\s+"), lambda w: F.length(w) > 2)).alias("q"))
    rows = texts.join(F.broadcast(candidates), "id").join(F.broadcast(asked), "query_id")  # few rows a query; texts are graded where they are
    terms = F.col("terms")
    if more is not None:
        rows, terms = rows.join(more, "query_id", "left"), F.array_union("terms", F.coalesce("more", F.array().cast("array<string>")))
    window = match_window(F.col("text"), terms)
    overlap = F.size(F.array_intersect("q", F.split(F.lower(window), r"\s+"))) / F.greatest(F.lit(1), F.size("q"))
    return rows.withColumn("relevance", F.round(FUSED_SHARE * F.col("fused") / F.col("top_fused") + OVERLAP_SHARE * overlap, 6))


def typed(hits: DataFrame, kind: str | None) -> DataFrame:
    """hits without those of another document_type; what has no type stays."""
    return hits.where(F.col("document_type").isNull() | (F.col("document_type") == kind)) if kind else hits


def max_merged(*scores: DataFrame) -> DataFrame:
    """The highest score of each (query_id, id) over several tables of scores."""
    rows = scores[0].select("query_id", "id", "score")
    for more in scores[1:]:
        rows = rows.unionByName(more.select("query_id", "id", "score"))
    return rows.groupBy("query_id", "id").agg(F.max("score").alias("score"))


def cross_scored(candidates: DataFrame, weight: float = CROSS_WEIGHT) -> DataFrame:
    """candidates(query_id, id, logit, fused) with relevance: the cross-encoder's sigmoid and the share of the query's
    highest fused score, weighted."""
    top = F.max("fused").over(Window.partitionBy("query_id"))
    prior = F.when(top > 0, F.coalesce(F.col("fused"), F.lit(0.0)) / top).otherwise(0.0)
    return candidates.withColumn("relevance", weight * X.sigmoid(F.col("logit")) + (1 - weight) * prior)


def grounded_share(terms: Column, text: Column) -> Column:
    """Share of terms that occur as words of the text; endings s, es, ed, ly are forgiven for words of 5 letters or more."""
    stem = lambda w: F.when(F.length(w) >= 5, F.regexp_replace(w, "(es|ed|ly|s)$", "")).otherwise(w)
    found = F.array_union(X.words(text), F.transform(X.words(text), stem))
    hits = F.filter(terms, lambda t: F.array_contains(found, t) | F.array_contains(found, stem(t)))
    return F.when(F.size(terms) > 0, F.size(hits) / F.size(terms)).otherwise(0.0)


def gate(rows: DataFrame) -> DataFrame:
    """Rows that are relevant enough, or grounded in the words of the query; with their band."""
    band = F.when(F.col("relevance") >= STRONG, "strong").when(F.col("relevance") >= FLOOR, "moderate").otherwise("weak")
    passed = (F.col("relevance") >= FLOOR) | ((F.col("grounded") >= LEXICAL_SHARE) & (F.col("relevance") >= LEXICAL_FLOOR))
    return rows.where(passed).withColumn("match_confidence", band)


def best_per(rows: DataFrame, keys: list[str], most: int, score: str = "relevance") -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), "id")
    return rows.withColumn("__at", F.row_number().over(order)).where(F.col("__at") <= most).drop("__at")


def recall_floor(rows: DataFrame, passed: DataFrame, most: int = 3) -> DataFrame:
    """For queries without any hit: up to so many candidates of at least BACKFILL_FLOOR, as weak."""
    none = rows.join(passed.select("query_id").distinct(), "query_id", "left_anti").where(F.col("relevance") >= BACKFILL_FLOOR)
    return best_per(none, ["query_id"], most).withColumn("match_confidence", F.lit("weak"))


def _fused(queries: DataFrame, live: DataFrame, vectors: DataFrame, summaries: DataFrame | None) -> DataFrame:
    vector = knn(queries.select("query_id", "embedding"), vectors.join(live.select("id"), "id", "left_semi"))
    keyword = bm25(queries, live.select("id", "text"))
    fused = boosted(fuse(vector, keyword), queries, live.select("id", "filename"))
    return fused if summaries is None else summary_boosted(fused, summaries.join(live.select("id"), "id", "left_semi"))


def _graded(candidates: DataFrame, queries: DataFrame, live: DataFrame, more: DataFrame | None = None) -> DataFrame:
    ranked = rerank(candidates, queries, live.select("id", "text", "content_hash", "filename"), more)
    return ranked.withColumn("grounded", grounded_share(F.col("terms"), F.concat_ws(" ", "filename", F.substring("text", 1, 300))))


def _hits(passed: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "id")
    return passed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "id", "relevance", "match_confidence", "rank")


def search(queries: DataFrame, files: DataFrame, vectors: DataFrame, limit: int = 10, summaries: DataFrame | None = None, floor: bool = False) -> DataFrame:
    """The whole pipeline: queries(query_id, query, embedding), files(id, filename, content_hash, status, text),
    vectors(id, embedding). Returns query_id, id, relevance, match_confidence, rank; one hit per content hash. Where
    given, the summary arm summaries(query_id, id, rank) boosts; with floor, queries without a hit have recall_floor()."""
    live = files.where("status = 'indexed'")
    ranked = _graded(pool(with_top(_fused(queries, live, vectors, summaries))), queries, live)
    passed = best_per(gate(ranked), ["query_id", "content_hash"], 1)
    if floor:
        passed = passed.unionByName(recall_floor(best_per(ranked, ["query_id", "content_hash"], 1), passed))
    return _hits(passed, limit)


def union_rescue(queries: DataFrame, variants: DataFrame, files: DataFrame, vectors: DataFrame, limit: int = 10, summaries: DataFrame | None = None) -> DataFrame:
    """search() with a wider net: each of variants(query_id, query, embedding) retrieves as well, a document's prior is
    its highest fused score over the phrasings, and 2 POOL of them are reranked and gated by the original query."""
    live = files.where("status = 'indexed'")
    phrases = queries.select("query_id", "query", "embedding").unionByName(variants.select("query_id", "query", "embedding"))
    phrases = phrases.withColumn("phrase", F.xxhash64("query_id", "query")).dropDuplicates(["phrase"])
    of = phrases.select("query_id", "phrase")
    arm = None if summaries is None else summaries.join(of, "query_id").select(F.col("phrase").alias("query_id"), "id", "rank")
    fused = _fused(phrases.select(F.col("phrase").alias("query_id"), "query", "embedding"), live, vectors, arm)
    prior = fused.withColumnRenamed("query_id", "phrase").join(of, "phrase").groupBy("query_id", "id").agg(F.max("fused").alias("fused"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("fused", 9)), "id")
    best = with_top(prior).withColumn("at", F.row_number().over(order)).where(F.col("at") <= 2 * POOL).drop("at")
    more = variants.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list(X.content_terms(F.col("query"))))).alias("more"))
    return _hits(best_per(gate(_graded(best, queries, live, more)), ["query_id", "content_hash"], 1), limit)
