"""Operator 9, URL filters: temporal list join.

List entries (kind, key, action, valid_from) become validity intervals: an entry holds from its date
until the next entry of the same kind and key. Every capture (id, url, fetched) is judged by the entries
that were active when it was fetched; of several, the most specific one decides: the longest path
prefix, then the exact host, then the longest parent domain.

The as-of join is an equi-join: an interval is listed once for each span of ``days`` days that it
touches, a capture looks up its own span, and the dates decide among the few entries of one key in one
span. So a host with a third of all captures is split by time (and by Spark's skew join), and no
per-host window or group is needed on the captures' side.

Defined results: a capture without a readable host or without a date gets no entry (action null); an
entry with a null kind, key or date is ignored; of entries of one key at the same instant "block" wins,
a null action means that the key is listed no longer; repeated captures are judged each; entries are
active from their instant, inclusive, to the next, exclusive; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAYS = 32
_HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
_PATH = r"^[a-z][a-z0-9+.-]*://[^/?#]+/([^?#]*)"


def host(url: Column) -> Column:
    """The host in lower case, without user, port or a dot at the end; empty if there is none."""
    return F.rtrim(F.regexp_extract(F.lower(url), _HOST, 1), F.lit("."))


def path(url: Column) -> Column:
    """The path without its first slash, query and fragment."""
    return F.regexp_extract(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "x://"), _PATH, 1)


def _span(at: Column, days: int) -> Column:
    return F.floor(F.unix_timestamp(at) / (86_400 * days)).cast("int")


def intervals(entries: DataFrame) -> DataFrame:
    """kind, key, action, valid_from, valid_to (null: still valid), without repeated instants."""
    clean = entries.where("kind is not null and key is not null and valid_from is not null")
    one = clean.groupBy("kind", "key", "valid_from").agg(F.max_by("action", F.coalesce((F.col("action") == "block").cast("int") + 1, F.lit(0))).alias("action"))
    after = F.lead("valid_from").over(Window.partitionBy("kind", "key").orderBy("valid_from"))
    return one.withColumn("valid_to", after).where("action is not null")


def temporal_filter(captures: DataFrame, entries: DataFrame, days: int = DAYS) -> DataFrame:
    """``id``, ``url``, ``fetched`` and the entry that decides: ``kind``, ``key``, ``action``,
    ``valid_from`` (nulls if none is active). One row for each row of ``captures``."""
    held = intervals(entries)
    bounds = captures.agg(F.min("fetched").alias("a"), F.max("fetched").alias("b")).first()
    deepest = held.where("kind = 'prefix'").agg(F.max(F.size(F.split("key", "/")))).first()[0] or 0
    h, p = host(F.col("url")), F.split(path(F.col("url")), "/")
    labels = F.split(F.col("h"), r"\.")
    captured = captures.select("id", "url", "fetched")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(
        F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, n), ".").alias("key"), (n - i).alias("rank")))
    exact = F.array(F.struct(F.lit("host").alias("kind"), F.col("h").alias("key"), F.lit(1_000_000).alias("rank")))
    depth = F.least(F.size(F.col("p")), F.lit(deepest - 1))
    prefixes = F.when(depth > 0, F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda i: F.struct(
        F.lit("prefix").alias("kind"), F.concat_ws("/", F.col("h"), F.array_join(F.slice(F.col("p"), 1, i), "/")).alias("key"),
        (i + 2_000_000).alias("rank")))).otherwise(F.array().cast("array<struct<kind:string,key:string,rank:int>>"))
    asked = (captured.where("fetched is not null").select("id", "url", "fetched", h.alias("h"), p.alias("p")).where("h <> ''")
             .select("id", "url", "fetched", _span(F.col("fetched"), days).alias("span"), F.inline(F.concat(domains, exact, prefixes))))
    if bounds.a is None:  # nothing was fetched at a known time
        listed = held.withColumn("span", F.lit(0)).limit(0)
    else:
        first, last = (_span(F.lit(x), days) for x in (bounds.a, bounds.b))
        begin, end = F.greatest(_span(F.col("valid_from"), days), first), F.least(F.coalesce(_span(F.col("valid_to"), days), last), last)
        listed = held.where(begin <= end).withColumn("span", F.explode(F.sequence(begin, end)))
    active = asked.join(listed, ["kind", "key", "span"]).where("fetched >= valid_from and (valid_to is null or fetched < valid_to)")
    decides = (active.groupBy("id", "url", "fetched").agg(F.max(F.struct("rank", "kind", "key", "action", "valid_from")).alias("e"))
               .select(F.col("id").alias("i"), F.col("url").alias("u"), F.col("fetched").alias("f"), "e.kind", "e.key", "e.action", "e.valid_from"))
    mine = F.col("id").eqNullSafe(F.col("i")) & (F.col("url") == F.col("u")) & (F.col("fetched") == F.col("f"))
    return captured.join(decides, mine, "left").drop("i", "u", "f")
