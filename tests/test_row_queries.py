"""Rows whose id is divisible by 50 search all rows."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from scriptorium.operators import retrieval as R
from scriptorium.plans import registry
from scriptorium.plans.registry_retrieval import row_queries

from .conftest import SF_ORACLE


def test_every_fiftieth_row_is_a_query(spark):
    e = spark.read.parquet(f"{SF_ORACLE}/embeddings.parquet")
    want = {r.vec_id for r in e.select("vec_id").collect() if r.vec_id % 50 == 0}
    got = registry.QUERIES["V3b_cosine_top_k_rows"](spark, SF_ORACLE).collect()
    assert {r.query_id for r in got} == want and len(got) == 5 * len(want)
    corpus = e.select(F.col("vec_id").alias("doc_id"), "embedding")
    blocks = R.cosine_top_k(row_queries(spark, SF_ORACLE), corpus, 5, max_broadcast_queries=4).collect()
    assert {(r.query_id, r.doc_id, r["rank"]) for r in blocks} == {(r.query_id, r.doc_id, r["rank"]) for r in got}


def recall(spark, queries, corpus, k=10, **options):
    exact = {(r.query_id, r.doc_id) for r in R.cosine_top_k(queries, corpus, k).collect()}
    approx = {(r.query_id, r.doc_id) for r in R.ann_top_k(queries, corpus, k, **options).collect()}
    return len(exact & approx) / len(exact)


def clustered(spark, n, noise):
    """Groups of 20 vectors around a centre; the cosine of two of a group is about 1 / (1 + noise ** 2)."""
    rnd = np.random.default_rng(n)
    centres = np.repeat(rnd.standard_normal((n // 20, 64)), 20, axis=0)
    v = centres + noise * rnd.standard_normal(centres.shape)
    return spark.createDataFrame(pd.DataFrame({"doc_id": np.arange(len(v)), "embedding": list(v)}), "doc_id long, embedding array<double>")


def test_recall_is_kept_at_several_sizes(spark):
    """Near random rows (the tables), weak and close neighbours; the buckets alone lose the former."""
    for sf in (SF_ORACLE, SF_ORACLE.replace("0.01", "0.1")):
        corpus = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
        assert recall(spark, row_queries(spark, sf), corpus) >= 0.9, sf
    for n, noise in ((2_000, 0.9), (20_000, 0.9), (20_000, 0.4)):
        corpus = clustered(spark, n, noise).cache()
        queries = corpus.where("doc_id % 200 = 0").withColumnRenamed("doc_id", "query_id")
        assert recall(spark, queries, corpus) >= 0.9, (n, noise)


def test_bands_grow_with_bits():
    for n in (500, 10**5, 10**6, 10**8):
        rows = R.lsh_rows(n)
        agree = 1 - np.arccos(0.8) / np.pi
        assert 1 - (1 - agree**rows) ** R.lsh_bands(rows, 0.9) >= 0.9


def test_queries_without_neighbours_in_buckets(spark):
    """Fewer than k rows in the buckets, NULL and non-finite vectors: as the exact search."""
    corpus = spark.createDataFrame([(1, [1.0] * 64), (2, [-1.0] * 64), (3, None), (4, [float("nan")] * 64)], "doc_id long, embedding array<double>")
    queries = corpus.withColumnRenamed("doc_id", "query_id")
    want = sorted((r.query_id, r.doc_id, r["rank"]) for r in R.cosine_top_k(queries, corpus, 2).collect())
    assert sorted((r.query_id, r.doc_id, r["rank"]) for r in R.ann_top_k(queries, corpus, 2).collect()) == want and len(want) == 4


# ------------------------------------------------------------------ inverted lists

def list_recall(queries, corpus, k=10):
    exact = {(r.query_id, r.doc_id) for r in R.cosine_top_k(queries, corpus, k).collect()}
    got = {(r.query_id, r.doc_id) for r in R.inverted_list_top_k(queries, corpus, k).collect()}
    return len(exact & got) / len(exact)


def test_inverted_lists_keep_their_recall(spark):
    """Near random rows (the tables) at two sizes, and groups of near vectors."""
    for sf in (SF_ORACLE, SF_ORACLE.replace("0.01", "0.1")):
        corpus = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
        assert list_recall(row_queries(spark, sf), corpus) >= 0.9, sf
    corpus = clustered(spark, 10_000, 0.5).cache()
    queries = corpus.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    assert list_recall(queries, corpus) >= 0.9
    rows = R._usable(corpus, "doc_id", "embedding", "doc_id")
    centres = spark.sparkContext.broadcast(R.coarse_cells(np.array([r.v for r in rows.limit(4000).collect()]), 512))
    listed = R.nearest_cells(rows, "doc_id", centres, 1)
    probes = R.probes_for(rows, listed, 10_000, 10, centres, 0.95)
    sizes = dict(listed.groupBy("cell").count().collect())
    asked = R.nearest_cells(R._usable(queries, "query_id", "embedding", "query_id"), "query_id", centres, probes)
    scored = sum(sizes.get(r.cell, 0) for r in asked.collect())
    assert scored < 0.1 * 200 * 10_000  # pairs scored, of all pairs


def test_inverted_lists_with_hot_cells_and_odd_vectors(spark, monkeypatch):
    """A third of all vectors are equal, lists and queries are cut into tiles; NULL, zero and non-finite vectors."""
    monkeypatch.setattr(R, "LIST_TILE", 16)
    rnd = np.random.default_rng(3)
    v = [[1.0] * 8 if i % 3 == 0 else [float(x) for x in rnd.standard_normal(8)] for i in range(300)]
    v += [None, [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7]
    corpus = spark.createDataFrame(list(enumerate(v)), "doc_id long, embedding array<double>")
    queries = corpus.withColumnRenamed("doc_id", "query_id")
    got = sorted(map(tuple, R.inverted_list_top_k(queries, corpus, 5, probes=1000).select("query_id", "doc_id", "rank").collect()))
    fine = corpus.filter("doc_id < 300")
    want = sorted(map(tuple, R.cosine_top_k(fine.withColumnRenamed("doc_id", "query_id"), fine, 5, dim=8).select("query_id", "doc_id", "rank").collect()))
    assert got == want
    few = R.inverted_list_top_k(queries.filter("query_id in (1, 2)"), corpus, 250, cells=20, probes=1)  # lists too short: exact
    assert few.groupBy("query_id").count().collect() == [(1, 250), (2, 250)] or {r.query_id: r["count"] for r in few.groupBy("query_id").count().collect()} == {1: 250, 2: 250}
    assert R.inverted_list_top_k(queries, corpus.limit(0), 5).collect() == []
    assert R.inverted_list_top_k(queries.limit(0), corpus, 5).collect() == []


# ------------------------------------------------------------------ buckets

def test_bucket_pairs_are_not_shuffled(spark, monkeypatch):
    """pairs of the buckets were made distinct and joined with the vectors of both sides. Many equal vectors, odd ones, several
    blocks of queries and slices of pairs: what brute force finds among the rows that share a bucket."""
    monkeypatch.setattr(R, "PAIRS", 50)
    rnd = np.random.default_rng(6)
    v = [[1.0] * 8 if i % 3 == 0 else [float(x) for x in rnd.standard_normal(8)] for i in range(200)]
    v += [None, [0.0] * 8, [float("nan")] + [1.0] * 7, [1e200] * 8]
    corpus = spark.createDataFrame([*enumerate(v), (None, [1.0] * 8)], "doc_id long, embedding array<double>")
    queries = corpus.withColumnRenamed("doc_id", "query_id")
    options = dict(bands=3, rows=4, dim=8, recall=None)
    assert "Join" not in R.ann_top_k(queries, corpus, 4, **options)._jdf.queryExecution().executedPlan().toString()
    planes, want = R._planes(8, 12), set()
    fine = {i: np.array(x) for i, x in enumerate(v) if x and np.isfinite(x).all()}
    codes = {i: [tuple(planes[4 * b:4 * b + 4] @ x > 0) for b in range(3)] for i, x in fine.items()}
    with np.errstate(all="ignore"):
        for q, x in fine.items():
            near = []
            for d, y in fine.items():
                score = float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y))) if x.any() and y.any() else 0.0
                if any(a == b for a, b in zip(codes[q], codes[d])) and not np.isnan(score):
                    near.append((-round(score, 9), d))
            want |= {(q, d, place + 1, -s) for place, (s, d) in enumerate(sorted(near)[:4])}
    for block in (None, 60):
        got = R.ann_top_k(queries, corpus, 4, max_broadcast_queries=block, **options).collect()
        assert {(r.query_id, r.doc_id, r["rank"], round(r.score, 9)) for r in got} == want and len(got) == len(want)
