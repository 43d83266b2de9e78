"""Registered retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..session import load, spread
from .catalog import register

K_RETRIEVE, N_RERANK = 10, 3


def _vec_text(c="embedding"):
    return F.array_join(F.transform(c, lambda x: x.cast("int").cast("string")), ",")


def _embed_sql(name: str, src: str, id_col: str, text_col: str) -> str:
    return f"""{name}_tok AS (SELECT {id_col} AS id, unnest(list_filter(regexp_split_to_array(lower({text_col}), '[^\\p{{L}}0-9]+'), lambda t: t <> '')) AS t FROM {src}),
{name}_b AS (SELECT id, ('0x' || substr(md5(t), 1, 8))::bigint % 64 AS b FROM {name}_tok),
{name}_grid AS (SELECT s.{id_col} AS id, r.i FROM {src} s CROSS JOIN range(64) r(i)),
{name}_cnt AS (SELECT g.id, g.i, count(b.b) AS n FROM {name}_grid g LEFT JOIN {name}_b b ON g.id = b.id AND g.i = b.b GROUP BY g.id, g.i),
{name} AS (SELECT id, list(cast(n AS double) ORDER BY i) AS vec FROM {name}_cnt GROUP BY id)"""


_V1_SQL = f"""
WITH {_embed_sql('emb', 'documents', 'doc_id', 'text')}
SELECT id AS doc_id, array_to_string(list_transform(vec, lambda x: cast(cast(x AS int) AS varchar)), ',') AS embedding_text FROM emb"""


@register("V1_embed_texts", _V1_SQL)
def v1(spark, sf):
    d = R.embed_texts(load(spark, sf, "documents").select("doc_id", "text"), "text", engine="jvm")
    return d.select("doc_id", _vec_text().alias("embedding_text"))


@register("X2_embedder_plugin", _V1_SQL)
def x2(spark, sf):
    d = R.embed_texts(load(spark, sf, "documents").select("doc_id", "text"), "text", embedder=R.HashingEmbedder())
    return d.select("doc_id", _vec_text().alias("embedding_text"))


@register("V1b_embed_texts_arrow", _V1_SQL)
def v1b(spark, sf):
    d = R.embed_texts(load(spark, sf, "documents").select("doc_id", "text"), "text")
    return d.select("doc_id", _vec_text().alias("embedding_text"))


@register("V2_length_guard", """
SELECT doc_id, cast(len(regexp_split_to_array(trim(text), '[ \\t\\n\\r]+')) AS int) AS n_tokens,
       len(regexp_split_to_array(trim(text), '[ \\t\\n\\r]+')) > 8192 AS over_limit FROM documents""")
def v2(spark, sf):
    return R.length_guard(load(spark, sf, "documents"), "text", 8192).select("doc_id", "n_tokens", "over_limit")


def label_centroids(spark, sf):
    """Query vectors derived from the corpus: the mean embedding of every label."""
    e = load(spark, sf, "embeddings")
    per_dim = (e.select("label", F.posexplode("embedding").alias("i", "x"))
               .groupBy("label", "i").agg(F.avg("x").alias("v")))
    return (per_dim.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s"))
            .select(F.col("label").alias("query_id"), F.transform("s", lambda z: z["v"]).alias("embedding")))


def row_queries(spark, sf):
    """Every row whose id is divisible by 50, its vector as it is: 2% of the rows at any size."""
    e = load(spark, sf, "embeddings").where("vec_id % 50 = 0")
    return e.select(F.col("vec_id").alias("query_id"), "embedding")


_ROWS_SQL = """q AS (SELECT vec_id AS query_id, cast(embedding AS double[]) AS qv FROM embeddings
      WHERE vec_id % 50 = 0 AND embedding IS NOT NULL)"""


V3_SQL = f"""
WITH {_ROWS_SQL},
s AS (SELECT q.query_id, e.vec_id AS doc_id, list_cosine_similarity(q.qv, cast(e.embedding AS double[])) AS score
      FROM q CROSS JOIN embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, doc_id, round(score, 6) AS score, cast(rank AS int) AS rank FROM r WHERE rank <= 5"""


@register("V3_cosine_top_k", V3_SQL)
@register("V3b_cosine_top_k_rows", V3_SQL)
def v3b(spark, sf):
    corpus = load(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    top = R.cosine_top_k(row_queries(spark, sf), corpus, 5)
    return top.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def _bucket_sql(vec: str) -> str:
    return f"sum(CASE WHEN list_dot_product({vec}, p) > 0 THEN 1::bigint << bit ELSE 0 END)::bigint AS bucket"


V4_SQL = f"""
WITH {_ROWS_SQL},
n AS (SELECT bits, cast(greatest(16, ceil(ln(0.1) / ln(1 - pow(1 - acos(0.8) / pi(), bits)))) AS bigint) AS bands
      FROM (SELECT greatest(4, length(bin(count(*) // 64))) AS bits FROM embeddings)),
nb AS (SELECT bits, unnest(range(bands * bits)) AS b FROM n),
pl AS (SELECT b // bits AS band, cast(b % bits AS int) AS bit,
              list(CASE WHEN ('0x' || substr(md5(b || ':' || i), 8, 1))::int % 2 = 1 THEN 1.0::double ELSE -1.0::double END ORDER BY i) AS p
       FROM nb, range(64) d(i) GROUP BY ALL),
qs AS (SELECT query_id, band, {_bucket_sql('qv')} FROM q, pl GROUP BY query_id, band),
es AS (SELECT vec_id, band, {_bucket_sql('cast(embedding AS double[])')} FROM embeddings, pl WHERE embedding IS NOT NULL GROUP BY vec_id, band),
k AS (SELECT DISTINCT query_id, vec_id FROM qs JOIN es USING (band, bucket)),
s AS (SELECT q.query_id, e.vec_id AS doc_id, list_cosine_similarity(q.qv, cast(e.embedding AS double[])) AS score, k.vec_id IS NOT NULL AS met
      FROM q CROSS JOIN embeddings e LEFT JOIN k ON k.query_id = q.query_id AND k.vec_id = e.vec_id WHERE e.embedding IS NOT NULL),
m AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE met),
f AS (SELECT query_id FROM m, n WHERE rank = 5
      AND 1 - pow(1 - pow(1 - acos(greatest(-1, least(1, score))) / pi(), bits), bands) >= 0.9),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s
      WHERE met OR query_id NOT IN (SELECT query_id FROM f))
SELECT query_id, doc_id, round(score, 6) AS score, cast(rank AS int) AS rank FROM r WHERE rank <= 5"""


@register("V4_ann_top_k", V4_SQL)
@register("V4b_ann_top_k_rows", V4_SQL)
def v4b(spark, sf):
    corpus = load(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    top = R.ann_top_k(row_queries(spark, sf), corpus, 5)
    return top.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@register("V4c_inverted_lists", None)
def v4c(spark, sf):
    """The same queries through a coarse quantiser; no SQL, its recall against V3 is tested."""
    corpus = load(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    top = R.inverted_list_top_k(row_queries(spark, sf), corpus, 5)
    return top.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def conversation_pairs(spark, sf):
    """(user turn, next assistant turn) pairs of every conversation."""
    c = load(spark, sf, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("query"))
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), "text")
    return u.join(a, ["conv_id", "turn"])


def _tok_sql(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}0-9]+'), lambda t: t <> ''))"


def _score_sql(q: str, d: str) -> str:
    return (f"1.0 / (1.0 + exp(0.0 - (CASE WHEN len({q}) + len({d}) > 0 "
            f"THEN 2.0 * len(list_intersect({q}, {d})) / (len({q}) + len({d})) ELSE 0.0 END * 8.0 - 4.0)))")


_PAIRS_SQL = f"""p AS (SELECT u.conv_id, u.turn, u.text AS query, a.text AS text FROM conversations u
       JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
t AS (SELECT conv_id, turn, {_tok_sql('query')} AS q, {_tok_sql('text')} AS d FROM p),
sc AS (SELECT conv_id, turn, {_score_sql('q', 'd')} AS score FROM t)"""


@register("V5_score_pairs", f"WITH {_PAIRS_SQL} SELECT conv_id, turn, round(score, 6) AS score FROM sc")
def v5(spark, sf):
    s = R.score_pairs(conversation_pairs(spark, sf))
    return s.select("conv_id", "turn", F.round("score", 6).alias("score"))


@register("X2b_scorer_plugin", f"""
WITH {_PAIRS_SQL},
c AS (SELECT conv_id, turn, 1.0 / (1.0 + exp(3.0 - 6.0 * CASE WHEN len(list_distinct(q)) > 0
        THEN len(list_intersect(list_distinct(q), d)) / len(list_distinct(q)) ELSE 0.0 END)) AS score FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS rerank FROM c)
SELECT conv_id, turn, round(score, 6) AS score, cast(rerank AS int) AS rerank FROM r WHERE rerank <= 2""")
def x2b(spark, sf):
    """V5 and W2 with a scorer plug-in instead of the built-in expression."""
    s = R.score_pairs(spread(conversation_pairs(spark, sf)), scorer=R.CoverageScorer())
    return R.rerank_top_n(s, 2, group="conv_id", item="turn").select("conv_id", "turn", F.round("score", 6).alias("score"), "rerank")


@register("W2_rerank_top_n", f"""
WITH {_PAIRS_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS rerank FROM sc)
SELECT conv_id, turn, round(score, 6) AS score, cast(rerank AS int) AS rerank FROM r WHERE rerank <= 2""")
def w2(spark, sf):
    s = R.score_pairs(conversation_pairs(spark, sf))
    top = R.rerank_top_n(s, 2, group="conv_id", item="turn")
    return top.select("conv_id", "turn", F.round("score", 6).alias("score"), "rerank")


def _rq(spark, sf):
    return load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _corpus(spark, sf):
    return load(spark, sf, "documents").select("doc_id", "text")


_RETRIEVE_SQL = f"""{_embed_sql('qe', 'benchmark', 'item_id', 'text')},
{_embed_sql('de', 'documents', 'doc_id', 'text')},
s AS (SELECT qe.id AS query_id, de.id AS doc_id, list_cosine_similarity(qe.vec, de.vec) AS sim FROM qe CROSS JOIN de),
cand AS (SELECT query_id, doc_id, cast(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_id) AS int) AS retrieval_rank FROM s
         QUALIFY retrieval_rank <= {K_RETRIEVE})"""


@register("J6_query_candidates", f"WITH {_RETRIEVE_SQL} SELECT query_id, doc_id, retrieval_rank FROM cand")
def j6(spark, sf):
    q, d = _rq(spark, sf), _corpus(spark, sf)
    qe, de = R.embed_texts(q, "query"), R.embed_texts(d, "text")
    cand = R.cosine_top_k(qe, de, K_RETRIEVE).select("query_id", "doc_id", F.col("rank").alias("retrieval_rank"))
    return R.query_candidates(cand, q, d).select("query_id", "doc_id", "retrieval_rank")


@register("V6_retrieve_then_rerank", f"""
WITH {_RETRIEVE_SQL},
t AS (SELECT c.query_id, c.doc_id, c.retrieval_rank, {_tok_sql('b.text')} AS q, {_tok_sql('d.text')} AS d
      FROM cand c JOIN benchmark b ON c.query_id = b.item_id JOIN documents d ON c.doc_id = d.doc_id),
sc AS (SELECT query_id, doc_id, retrieval_rank, {_score_sql('q', 'd')} AS score FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rerank FROM sc)
SELECT query_id, doc_id, retrieval_rank, round(score, 6) AS score, cast(rerank AS int) AS rerank FROM r WHERE rerank <= {N_RERANK}""")
def v6(spark, sf):
    out = R.retrieve_then_rerank(_rq(spark, sf), _corpus(spark, sf), K_RETRIEVE, N_RERANK)
    return out.select("query_id", "doc_id", "retrieval_rank", F.round("score", 6).alias("score"), "rerank")
