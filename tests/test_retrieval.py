"""Keyword scores against plain Python, and how much retrieval shuffles as the texts grow."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from marlstone.operators import retrieval as R
from marlstone.plans import registry


def scored(queries, chunks, k):
    """The best k (score, rank) of each query, as the SQL of bm25_topk has them."""
    words = [(i, re.findall(r"\w+", t.lower())) for i, t in chunks if t is not None]
    mean = sum(len(w) for _, w in words) / len(words)
    posts = Counter((i, len(w), t) for i, w in words for t in w)
    df = Counter(t for _, _, t in posts)
    total = defaultdict(float)
    for q, text in queries:
        for term, times in Counter(w for w in re.findall(r"\w+", (text or "").lower()) if len(w) > 1).items():
            idf = max(math.log((len(chunks) - df[term] + 0.5) / (df[term] + 0.5)), 1e-6)
            for (i, n, t), tf in posts.items():
                if t == term:
                    total[q, i] += times * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))
    out = set()
    for q in {q for q, _ in total}:
        best = sorted((-round(s, 6), i) for (p, i), s in total.items() if p == q)[:k]
        out |= {(q, i, round(-s, 6), rank) for rank, (s, i) in enumerate(best, 1)}
    return out


def texts(n, of=lambda k: k):
    return [(of(k), " ".join(f"w{(k * j) % 37}" for j in range(1, 3 + k % 11))) for k in range(n)]


def frames(spark, queries, chunks):
    return spark.createDataFrame(queries, "query_id long, query string"), spark.createDataFrame(chunks, "id long, text string")


QUERIES = [(q, f"w{q} W{q % 5} w{q % 5} w{(7 * q) % 37} nowhere x") for q in range(23)] + [(99, "zzz"), (100, None)]
CHUNKS = [*texts(300), (1000, None), (1001, ""), (1002, "..."), *((2000 + k, "w1 w2 w3") for k in range(30))]


@pytest.mark.parametrize("limits", [{}, {"QUERY_BLOCK": 4, "SCORE_ROWS": 7, "SCORE_CELLS": 40}, {"TERM_BLOCK": 3, "BROADCAST_TERMS": 5}], ids=str)
def test_bm25(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(R, name, value)
    got = R.bm25(*frames(spark, QUERIES, CHUNKS), k=8).collect()
    assert {tuple(r) for r in got} == scored(QUERIES, CHUNKS, 8) and len(got) == len({r[:2] for r in got})


def test_bm25_texts_that_share_an_id(spark):
    chunks = [*CHUNKS, *texts(60, lambda k: k // 3), (5, "w1 w2"), (5, "w2 w1")]
    assert {tuple(r) for r in R.bm25(*frames(spark, QUERIES, chunks), k=8).collect()} == scored(QUERIES, chunks, 8)


def test_bm25_without_queries_or_texts(spark):
    queries, chunks = frames(spark, QUERIES, CHUNKS)
    assert R.bm25(queries.where("query_id > 98"), chunks).count() == 0
    assert R.bm25(queries, chunks.where("false")).count() == 0 and R.bm25(queries.where("false"), chunks).columns == ["query_id", "id", "score", "rank"]


def stages(spark):
    sc, jvm = spark._jsc.sc(), spark._jvm
    gateway, none = spark.sparkContext._gateway, jvm.java.util.ArrayList()
    seq = sc.statusStore().stageList(none, False, False, gateway.new_array(jvm.double, 0), none)
    return {seq.apply(k).stageId(): (seq.apply(k).shuffleWriteRecords(), seq.apply(k).shuffleWriteBytes()) for k in range(seq.size())}


def shuffled(spark, run):
    """Records and bytes that a run writes for shuffles."""
    before = stages(spark)
    run()
    new = [v for k, v in stages(spark).items() if k not in before]
    return tuple(map(sum, zip(*new)))


def test_bm25_shuffles_no_postings(spark):
    queries = [(q, " ".join(f"w{k}" for k in range(37))) for q in range(20)]
    small, large = (shuffled(spark, R.bm25(*frames(spark, queries, texts(n)), k=5).collect)[0] for n in (400, 4000))
    # the ids go once, to find those of several texts; all else grows with queries and tasks
    assert large - small < 2 * (4000 - 400)


def test_search_keeps_texts_in_place(spark):
    draw = random.Random(5)
    files = spark.createDataFrame([(k, f"f{k}.txt", f"h{k}", "indexed", f"w{k % 37} " + "%x" % draw.getrandbits(40_000)) for k in range(400)], "id long, filename string, content_hash string, status string, text string")
    vectors = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(400)], "id long, embedding array<float>")
    queries = spark.createDataFrame([(1, "w1 w2", [1.0, 1.0])], "query_id long, query string, embedding array<float>")
    assert shuffled(spark, R.search(queries, files, vectors).collect)[1] < 400 * 10_000 / 4


def tables(spark, folder, docs, items, n_vectors=40):
    """documents, benchmark and embeddings under a folder, as its name."""
    rows = [(k, t, "en", "s", len(t)) for k, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(k, [float(k), 1.0]) for k in range(n_vectors)], "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["rrf_fusion", "rerank_pool"])
def test_fusion_shuffles_no_postings(spark, tmp_path, name):
    items = [(q, " ".join(f"w{k}" for k in range(37))) for q in range(20)]
    small, large = (shuffled(spark, registry.Q[name](spark, tables(spark, tmp_path / str(n), texts(n), items)).collect)[0] for n in (400, 4000))
    assert large - small < 2 * (4000 - 400)


def long_texts(n=400):
    draw = random.Random(5)
    return [(k, f"w{k % 37} " + "%x" % draw.getrandbits(40_000)) for k in range(n)]


@pytest.fixture
def large(spark):
    """Tables count as too large to be broadcast by themselves."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bands_keep_texts_in_place(spark, tmp_path, large):
    run = registry.Q["confidence_bands"](spark, tables(spark, tmp_path, long_texts(), [(1, "w1 w2")]))
    assert shuffled(spark, run.collect)[1] < 400 * 10_000 / 4


def test_eval_keeps_texts_in_place(spark, tmp_path, large):
    run = registry.Q["eval_hit_at_k"](spark, tables(spark, tmp_path, long_texts(), [(1, "w1"), (2, "nowhere")]))
    assert shuffled(spark, run.collect)[1] < 400 * 10_000 / 4 and {r.kind: (r.n, r.hit_1) for r in run.collect()} == {"known": (1, 1.0), "negative": (1, 0.0)}
