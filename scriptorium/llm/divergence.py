"""Operator 11, source divergence audit: how the words of each source differ from its language's and from other sources'.

Count vectorizer per language. Each task builds the sparse count vector of each whole document and adds it
to the sums of its group (lang, source), as a summarizer's partial buffers do; what travels is one row per
group and term for each flush of a task, added up by Spark. The vocabulary of a language holds all terms in
at least ``min_df`` of its documents (the vocabulary size is the largest integer: no term is left out for
room). It stays a table: ``CountVectorizer.fit`` would hold all terms on the driver and in every task, a size
that grows with the corpus. ``document_vectors`` gives the vectors themselves, by index in that table.

Pair evaluation is sparse. With p = 1 + floor(SCALE * (count + 1) / (N + V)), terms that a source lacks all
have its least p. A pair of sources is the sum over terms that both have (an equi-join on the term, one row
per source), over terms that one has (from the number of terms with each count, less those both have), and a
multiple for terms that neither has. All numbers are integers: sums of counts are exact, p and the divergence
floor((p - q) * (p - q) / q) follow by whole-number division.

Defined results: null text, lang and source read as ''; a text without letters still counts its group;
repeated rows are documents of their own; a language without a kept term gives pairs of value 0 and no terms;
one source alone in its language has no pairs; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, cut

MIN_DF, TOP, SCALE = 3, 200, 1_000_000_000
FLUSH = 100_000  # entries of sums that a task holds before it hands them on
_DF, _DOCS, _WORDS = 24, 1 << 20, 1 << 30  # a held sum has documents in its low bits, occurrences above: so many at most
#: Terms are runs of letters A-Z, a-z and non-ASCII characters; only A-Z are lower-cased.
_LETTERS = bytes(c | 0x20 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_BIG = "decimal(38,0)"


def count_vector(text: bytes) -> Counter:
    """Term -> occurrences in one text (UTF-8)."""
    return Counter(text.translate(_LETTERS).split())


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def group_sums(docs: DataFrame, most: int = FLUSH) -> DataFrame:
    """lang, source, term, n (occurrences), df (documents with the term): the sums of the documents' vectors.
    Each group has a row with a null term too, whose df counts its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], dict[bytes | None, int]] = defaultdict(dict)
        held = docs = words = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in sums.items():
                both = np.fromiter(terms.values(), np.int64, len(terms))
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(lang, pa.string()), len(terms)), pa.repeat(pa.scalar(source, pa.string()), len(terms)),
                     pa.array(list(terms), pa.binary()).cast(pa.string()), pa.array(both >> _DF), pa.array(both & (1 << _DF) - 1)],
                    names=["lang", "source", "term", "n", "df"])
            sums.clear()

        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary())):
                group = sums[lang, source]
                held -= len(group)
                group[None] = group.get(None, 0) + 1
                vector = count_vector(text.as_py())
                for term, n in vector.items():
                    group[term] = group.get(term, 0) + (n << _DF) + 1
                held, docs, words = held + len(group), docs + 1, words + vector.total()
                if held > most or docs >= _DOCS or words >= _WORDS:
                    yield from flush()
                    held = docs = words = 0
        yield from flush()

    parts = _named(docs).mapInArrow(run, "lang string, source string, term string, n bigint, df bigint")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def vocabulary(sums: DataFrame, min_df: int = MIN_DF) -> DataFrame:
    """lang, term, n, df: the terms that each language keeps, with their counts over the whole language."""
    return (sums.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
            .where(F.col("df") >= min_df))


def indexed(words: DataFrame) -> DataFrame:
    """``vocabulary`` with ``index``: 0, 1, ... within the language, most frequent first, then by UTF-8."""
    from ..plans.scale import running_count

    return (running_count(words.withColumn("less", -F.col("n")), ["lang"], ["less", "term"], "index")
            .withColumn("index", F.col("index") - 1).drop("less"))


def document_vectors(docs: DataFrame, words: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, lang, and the sparse vector of each document: ``indices`` (ascending) and ``counts`` over the
    table ``words`` (from ``indexed``). Rows that share a key, lang and text share a row. A document without kept
    terms has empty arrays; only one document's terms are gathered at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, text in enumerate(as_bytes(b.column(2))):
                vector = count_vector(text)
                n = max(1, len(vector))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.chunked_array([b.column(i).slice(at, 1)] * n).combine_chunks() for i in (0, 1, 3)),
                     pa.array(list(vector) or [None], pa.binary()).cast(pa.string()), pa.array(list(vector.values()) or [0], pa.int64())],
                    names=["key", "lang", "digest", "term", "n"])

    src = docs.select(F.col(key).alias("key"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    src = src.withColumn("digest", F.sha2("text", 256))
    terms = src.mapInArrow(run, f"key {src.schema['key'].dataType.simpleString()}, lang string, digest string, term string, n bigint").distinct()
    held = terms.join(words.select("lang", "term", "index"), ["lang", "term"], "left")
    pairs = F.array_sort(F.collect_list(F.when(F.col("index").isNotNull(), F.struct("index", "n"))))
    return (held.groupBy("key", "lang", "digest").agg(pairs.alias("v"))
            .select(F.col("key").alias(key), "lang", F.col("v.index").alias("indices"), F.col("v.n").alias("counts")))


def probability(count: Column, total: Column, kept: Column) -> Column:
    """p of a count in a group of ``total`` occurrences of ``kept`` terms."""
    return (F.lit(1) + F.call_function("div", F.lit(SCALE).cast(_BIG) * (count.cast(_BIG) + 1), (total + kept).cast(_BIG))).cast("long")


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _ranked(rows: DataFrame, most: int | None = None) -> DataFrame:
    w = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = rows.withColumn("rank", F.row_number().over(w))
    return ranked if most is None else ranked.where(F.col("rank") <= most)


def source_divergence(docs: DataFrame, min_df: int = MIN_DF, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair``: the divergence of each other source of the
    language, all ranks; part ``term``: the ``top`` kept terms that the source has more often than its language."""
    sums = cut(group_sums(docs))
    words = cut(vocabulary(sums, min_df))
    size = words.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
    kept = sums.where("term is not null").join(words.select("lang", "term", F.col("n").alias("nl")), ["lang", "term"])
    total = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    groups = (sums.where("term is null").select("lang", "source").join(total, ["lang", "source"], "left").join(size, "lang", "left")
              .na.fill(0, ["total", "own", "kept", "lang_total"]))
    least = F.when(F.col("kept") > 0, probability(F.lit(0), F.col("total"), F.col("kept")))
    groups = cut(groups.withColumn("least", least))
    p = cut(kept.join(groups.select("lang", "source", "total", "kept", "lang_total"), ["lang", "source"])
            .select("lang", "source", "term", "n", probability(F.col("n"), F.col("total"), F.col("kept")).alias("p"),
                    probability(F.col("nl"), F.col("lang_total"), F.col("kept")).alias("q")))

    term = (p.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                    divergence(F.col("p"), F.col("q")).alias("value")))

    one = groups.select("lang", "source", F.col("own").alias("own_a"), F.col("least").alias("p0"), "kept")
    other = groups.select("lang", F.col("source").alias("item"), F.col("own").alias("own_b"), F.col("least").alias("q0"))
    pairs = one.join(other, "lang").where("source <> item")
    # terms by p: those of one source against the least p of each other one
    counted = p.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))
    mine = (counted.join(other.select("lang", "item", "q0"), "lang").where("source <> item")
            .groupBy("lang", "source", "item").agg(F.sum(divergence(F.col("p"), F.col("q0")) * F.col("terms")).alias("mine")))
    theirs = (counted.select("lang", F.col("source").alias("item"), "p", "terms").join(one.select("lang", "source", "p0"), "lang")
              .where("source <> item")
              .groupBy("lang", "source", "item").agg(F.sum(divergence(F.col("p0"), F.col("p")) * F.col("terms")).alias("theirs")))
    p0, q0 = groups.select("lang", "source", F.col("least").alias("p0")), other.select("lang", "item", "q0")
    a = p.select("lang", "source", "term", "p").join(p0, ["lang", "source"])
    b = p.select("lang", F.col("source").alias("item"), "term", F.col("p").alias("q")).join(q0, ["lang", "item"])
    # both have the term: its own value instead of what the two sums above hold for it
    instead = divergence(F.col("p"), F.col("q")) - divergence(F.col("p"), F.col("q0")) - divergence(F.col("p0"), F.col("q"))
    both = (a.join(b, ["lang", "term"]).where("source <> item")
            .groupBy("lang", "source", "item").agg(F.sum(instead).alias("both"), F.count("*").alias("common")))
    found = pairs
    for part in (mine, theirs, both):
        found = found.join(part, ["lang", "source", "item"], "left")
    neither = F.col("kept") - F.col("own_a") - F.col("own_b") + F.coalesce("common", F.lit(0))
    value = (F.coalesce("mine", F.lit(0)) + F.coalesce("theirs", F.lit(0)) + F.coalesce("both", F.lit(0))
             + F.coalesce(neither * divergence(F.col("p0"), F.col("q0")), F.lit(0)))
    pair = found.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))
    return _ranked(pair).union(_ranked(term, top))
