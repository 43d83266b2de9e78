"""Registered queries of the operators: thin functions (spark, folder) -> DataFrame, with SQL where DuckDB can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load
from . import (bpe_automaton, cube_mix, divergence, epsilon_grid, packing, periodic_runs, preference, quality_rules, records, severity,
               simhash, token_tree, tokens, url_lists)

WORD_FILE, BYTE_FILE = "word_bpe_49k.json", "byte_bpe_50k.json"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
    QUERIES[fn.__name__] = fn
    return fn


def _tokenizer(spark: SparkSession, name: str):
    return tokens.share(spark, public_tokenizers.path(name))


# ------------------------------------------------------------------ 1 token counts

def document_edits(docs: DataFrame) -> DataFrame:
    """Three edits of each document, at places that follow from its id: a word put in, a span taken
    out, and a span put in the place of another."""
    n = F.length(F.coalesce("text", F.lit("")))

    def at(i: int) -> F.Column:
        return F.pmod(F.xxhash64("doc_id", F.lit(i)), n + 1).cast("int")

    def one(start, length, text):
        return F.struct(start.alias("start"), length.alias("length"), text.alias("text"))

    some = F.substring(F.coalesce("text", F.lit("")), 1, 12)
    return docs.select("doc_id", "text", F.array(
        one(at(1), F.lit(0), F.lit(" edited")), one(at(2), F.lit(40), F.lit("")), one(at(3), F.lit(9), some)).alias("edits"))


@_query
def op1_token_counts(spark, sf):
    shared = _tokenizer(spark, BYTE_FILE)
    return token_tree.count_after_edits(document_edits(load(spark, sf, "documents")), shared)


# ------------------------------------------------------------------ 2 chat formatting

def conversation_pairs(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A pair for each conversation: chosen as it is, rejected with its last assistant turn replaced by
    the last assistant turn of the next conversation id (kept where there is none)."""
    last = (turns.where("role = 'assistant'").groupBy("conv_id")
            .agg(F.max("turn").alias("last"), F.max_by("text", F.struct("turn", "text")).alias("answer")))
    other = last.select((F.col("conv_id") - 1).alias("conv_id"), F.col("answer").alias("instead"))
    marks = last.select("conv_id", "last").join(other, "conv_id", "left")
    chosen = turns.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    swap = (F.col("turn") == F.col("last")) & (F.col("role") == "assistant") & F.col("instead").isNotNull()
    rejected = (turns.join(marks, "conv_id", "left")
                .select(F.col("conv_id").alias("pair_id"), "turn", "role", F.when(swap, F.col("instead")).otherwise(F.col("text")).alias("text")))
    return chosen, rejected


@_query
def op2_preference_format(spark, sf):
    out = preference.preference_format(*conversation_pairs(load(spark, sf, "conversations")))
    text = lambda c: F.array_join(F.transform(F.filter(c, lambda s: s["trained"]), lambda s: F.concat(
        s["start"].cast("string"), F.lit("+"), s["length"].cast("string"))), " ").alias(f"{c}")
    return out.select("pair_id", "n_common", "prompt", "chosen", "rejected", text("chosen_spans"), text("rejected_spans"))


ORACLE["op2_preference_format"] = """
WITH l AS (SELECT conv_id, max(turn) AS last, arg_max(text, {'t': turn, 'x': text}) AS answer
           FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
t AS (SELECT c.conv_id AS pair_id, c.turn, coalesce(c.role, 'unknown') AS role, coalesce(c.text, '') AS a,
             coalesce(CASE WHEN c.role = 'assistant' AND c.turn = l.last AND o.answer IS NOT NULL THEN o.answer ELSE c.text END, '') AS b
      FROM conversations c LEFT JOIN l ON c.conv_id = l.conv_id LEFT JOIN l o ON o.conv_id = c.conv_id + 1),
x AS (SELECT pair_id, role, text, row_number() OVER (PARTITION BY pair_id ORDER BY turn, role, text) AS i FROM (SELECT pair_id, turn, role, a AS text FROM t)),
y AS (SELECT pair_id, role, text, row_number() OVER (PARTITION BY pair_id ORDER BY turn, role, text) AS i FROM (SELECT pair_id, turn, role, b AS text FROM t)),
k AS (SELECT x.pair_id, coalesce(min(x.i) FILTER (WHERE x.role <> y.role OR x.text <> y.text) - 1, count(*)) AS n
      FROM x JOIN y ON x.pair_id = y.pair_id AND x.i = y.i GROUP BY x.pair_id),
r AS (SELECT s.side, s.pair_id, s.i, s.role, k.n, '<|' || s.role || '|>' || chr(10) || s.text || '<|end|>' || chr(10) AS turn,
             length(s.role) + 5 AS head, length(s.text) + 8 AS body
      FROM (SELECT 'x' AS side, * FROM x UNION ALL SELECT 'y', * FROM y) s JOIN k USING (pair_id)),
p AS (SELECT *, sum(CASE WHEN i > n THEN head + body ELSE 0 END) OVER (PARTITION BY side, pair_id ORDER BY i) - body AS begins FROM r)
SELECT pair_id, cast(n AS INT) AS n_common,
       coalesce(string_agg(turn, '' ORDER BY i) FILTER (WHERE side = 'x' AND i <= n), '') AS prompt,
       coalesce(string_agg(turn, '' ORDER BY i) FILTER (WHERE side = 'x' AND i > n), '') AS chosen,
       coalesce(string_agg(turn, '' ORDER BY i) FILTER (WHERE side = 'y' AND i > n), '') AS rejected,
       coalesce(string_agg(cast(begins AS INT) || '+' || body, ' ' ORDER BY i) FILTER (WHERE side = 'x' AND i > n AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg(cast(begins AS INT) || '+' || body, ' ' ORDER BY i) FILTER (WHERE side = 'y' AND i > n AND role = 'assistant'), '') AS rejected_spans
FROM p GROUP BY pair_id, n"""


# ------------------------------------------------------------------ 3, 4, 5

@_query
def op3_binary_records(spark, sf):
    return records.record_digest(load(spark, sf, "documents"), _tokenizer(spark, WORD_FILE))


@_query
def op4_simhash(spark, sf):
    return simhash.simhash_near_duplicates(load(spark, sf, "documents"))


@_query
def op5_best_fit_packing(spark, sf):
    return packing.best_fit_pack(packing.with_length(load(spark, sf, "documents"), shared=_tokenizer(spark, WORD_FILE)))


# ------------------------------------------------------------------ 6, 7, 8

@_query
def op6_quality_rules(spark, sf):
    docs = load(spark, sf, "documents")
    return quality_rules.quality_rules(docs, quality_rules.fit(docs, load(spark, sf, "labels")))


@_query
def op7_embedding_near_duplicates(spark, sf):
    return epsilon_grid.embedding_near_duplicates(load(spark, sf, "embeddings"))


@_query
def op8_bpe_automaton(spark, sf):
    return bpe_automaton.bpe_digest(load(spark, sf, "documents"), _tokenizer(spark, WORD_FILE))


# ------------------------------------------------------------------ 9 URL filters

def captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch date that follows from the page id (four years from 2020)."""
    return pages.select(F.col("page_id").alias("id"), "url",
                        F.expr("timestamp'2020-01-01 00:00:00' + make_dt_interval(cast(page_id * 7919 % 1461 as int))").alias("fetched"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries on what the pages contain: every third host is blocked and later allowed again,
    every fifth parent domain and every fourth "host/section" prefix likewise, on dates that follow from
    the smallest page id that shows them."""
    h = url_lists.host(F.col("url"))
    seen = pages.select("page_id", h.alias("h"), F.split(url_lists.path(F.col("url")), "/")[0].alias("p")).where("h <> ''")
    keys = F.array(
        F.struct(F.lit("host").alias("kind"), F.col("h").alias("key"), F.lit(3).alias("every")),
        F.struct(F.lit("domain").alias("kind"), F.regexp_replace("h", r"^[^.]*\.", "").alias("key"), F.lit(5).alias("every")),
        F.struct(F.lit("prefix").alias("kind"), F.concat_ws("/", "h", "p").alias("key"), F.lit(4).alias("every")))
    first = seen.select("page_id", F.inline(keys)).groupBy("kind", "key", "every").agg(F.min("page_id").alias("m"))
    dated = F.array(*[F.struct(F.expr(f"timestamp'2020-01-01 00:00:00' + make_dt_interval(cast(m * 31 % {a} + {b} as int))").alias("valid_from"),
                               F.lit(x).alias("action")) for a, b, x in ((500, 0, "block"), (300, 520, "allow"), (200, 900, "block"), (100, 1200, None))])
    return first.where("m % every = 0").select("kind", "key", F.inline(dated))


@_query
def op9_url_filters(spark, sf):
    pages = load(spark, sf, "pages")
    out = url_lists.temporal_filter(captures(pages), list_entries(pages))
    return out.select(F.col("id").alias("page_id"), "url", F.date_format("fetched", "yyyy-MM-dd").alias("fetched"), "kind", "key", "action",
                      F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"), F.coalesce(F.col("action") == "block", F.lit(False)).alias("blocked"))


_URL_HOST = r"rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '.')"
_URL_PATH = r"regexp_extract(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', 'x://'), '^[a-z][a-z0-9+.-]*://[^/?#]+/([^?#]*)', 1)"
_DATES = ((500, 0, "'block'"), (300, 520, "'allow'"), (200, 900, "'block'"), (100, 1200, "NULL"))
ORACLE["op9_url_filters"] = f"""
WITH p AS (SELECT page_id, url, date '2020-01-01' + cast(page_id * 7919 % 1461 AS INT) AS fetched, {_URL_HOST} AS h, {_URL_PATH} AS path FROM pages),
s AS (SELECT kind, key, every, min(page_id) AS m FROM (
        SELECT page_id, 'host' AS kind, h AS key, 3 AS every FROM p WHERE h <> ''
        UNION ALL SELECT page_id, 'domain', regexp_replace(h, '^[^.]*\\.', ''), 5 FROM p WHERE h <> ''
        UNION ALL SELECT page_id, 'prefix', h || '/' || split_part(path, '/', 1), 4 FROM p WHERE h <> '') GROUP BY ALL),
e AS ({' UNION ALL '.join(f"SELECT kind, key, date '2020-01-01' + cast(m * 31 % {a} + {b} AS INT) AS f, {x} AS action FROM s WHERE m % every = 0" for a, b, x in _DATES)}),
o AS (SELECT kind, key, f, max(action) AS action FROM e GROUP BY ALL),
i AS (SELECT *, lead(f) OVER (PARTITION BY kind, key ORDER BY f) AS t FROM o),
j AS (SELECT p.page_id, i.*, CASE kind WHEN 'prefix' THEN 2000 + length(key) WHEN 'host' THEN 1000 ELSE length(key) END AS rank
      FROM p JOIN i ON ((kind = 'host' AND key = h) OR (kind = 'domain' AND (key = h OR ends_with(h, '.' || key)))
                        OR (kind = 'prefix' AND (key = h || '/' || split_part(path, '/', 1))))
      AND i.action IS NOT NULL AND p.fetched >= i.f AND (i.t IS NULL OR p.fetched < i.t) WHERE h <> ''),
d AS (SELECT page_id, arg_max(kind, rank) AS kind, arg_max(key, rank) AS key, arg_max(action, rank) AS action, arg_max(f, rank) AS f FROM j GROUP BY page_id)
SELECT p.page_id, p.url, strftime(p.fetched, '%Y-%m-%d') AS fetched, d.kind, d.key, d.action, strftime(d.f, '%Y-%m-%d') AS valid_from,
       coalesce(d.action = 'block', false) AS blocked
FROM p LEFT JOIN d USING (page_id)"""


# ------------------------------------------------------------------ 10 toxicity

@_query
def op10_toxicity(spark, sf):
    docs = load(spark, sf, "documents")
    model = severity.fit_toxic(docs, load(spark, sf, "labels"))
    out = severity.severity(docs, model, keep=["doc_id"], names=["expected_severity", "p_toxic", "grade"])
    return out.withColumn("toxic", F.col("p_toxic") >= 0.5)


# ------------------------------------------------------------------ 11 source divergence audit

@_query
def op11_source_divergence(spark, sf):
    return divergence.source_divergence(load(spark, sf, "documents"))


ORACLE["op11_source_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
v AS (SELECT lang, term, count(*)::BIGINT AS nl FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
sz AS (SELECT lang, count(*)::BIGINT AS v, sum(nl)::BIGINT AS nt FROM v GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*)::BIGINT AS n FROM w JOIN v USING (lang, term) GROUP BY ALL),
t AS (SELECT lang, source, sum(n)::BIGINT AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n,
             1 + 1000000000 * (coalesce(c.n, 0) + 1) // (coalesce(t.n, 0) + sz.v) AS p, 1 + 1000000000 * (v.nl + 1) // (sz.nt + sz.v) AS q
      FROM g JOIN v USING (lang) JOIN sz USING (lang) LEFT JOIN t USING (lang, source) LEFT JOIN c USING (lang, source, term)),
pr AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
       FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pr.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pr ON pr.lang = a.lang AND pr.source = a.source AND pr.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
k AS (SELECT *, cast(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM x)
SELECT * FROM k WHERE part = 'pair' OR rank <= 200"""


# ------------------------------------------------------------------ 12 periodic run detection

def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text; with h the CRC-32 of the decimal id and h % 10 = 0, the words from a place that h names on
    repeat with a period that h names (words joined by one space), so that runs of all lengths are there to find."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    n, g = F.greatest(F.size("w"), F.lit(1)).cast("long"), F.floor(F.col("h") / 10)
    rows = rows.withColumn("a", g % n)
    rows = rows.withColumn("p", F.expr("1 + (greatest(size(w), 1) - a) div (3 + (h div 10) % 8)"))
    again = F.flatten(F.array_repeat(F.expr("slice(w, cast(a + 1 as int), cast(p as int))"), F.expr("cast((size(w) - a) div p + 1 as int)")))
    text = F.array_join(F.slice(F.concat(F.expr("slice(w, 1, cast(a as int))"), again), F.lit(1), F.size("w")), " ")
    return rows.select("doc_id", F.when(F.size("w") > 0, text).otherwise(F.col("text")).alias("text"))


@_query
def op12_periodic_runs(spark, sf):
    return periodic_runs.run_digest(periodic_runs.find_runs(with_periods(load(spark, sf, "documents")), keep=["doc_id"]))


# ------------------------------------------------------------------ 13 mixing sources to target weights

@_query
def op13_cube_mix(spark, sf):
    return cube_mix.mix_sources(load(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")
