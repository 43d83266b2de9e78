"""Operator 4, SimHash near-duplicates with bit-sliced comparison.

Fingerprints come from all word shingles of a whole text. Distinct fingerprints are compared, copies
never are. 64 bits fall into m blocks; two fingerprints at most r bits apart agree in m - r blocks at
least, so each is listed under its C(m, r) choices of m - r blocks, and only those that share a key are
compared. m grows with the logarithm of the number of distinct fingerprints, so lists stay short.

Comparison. A task sorts the fingerprints it gets by key and stores them as 64 vertical bit planes, one
machine word for 64 fingerprints. Fingerprint i is compared with i + 1, i + 2, ... of its key: the planes
are xored with themselves shifted, and the 64 differences of each word are summed by carry-save adders
into three counter planes with an overflow plane. A word is abandoned once all its pairs exceed the
radius or belong to different keys. Keys with many fingerprints are cut into tiles of bounded size, one
for each pair of parts, so nothing is left out and no task gets a whole hot key.

Links leave a task as a spanning forest of what it found, and the components follow on Spark.

Defined results: a null, empty or blank text has fingerprint zero and links like any other; copies
share a class; a null doc_id gets the component of its text and does not name one (null if its
component has no other id); an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_columns, as_bytes, cut, fresh
from .forest import Forest
from .graph import components

BITS, SEED = 64, 42
TILE = 1024  # fingerprints of one key that are compared in one go
BATCH = 1 << 15  # fingerprints whose planes a task holds
_SLICE = 1 << 16  # shingles whose bits are counted in one go


def fingerprint(text: bytes, width: int = 4) -> int:
    """A bit is 1 if it is set in over half of the XXH64 of all shingles, repeats included."""
    import xxhash

    words = text.lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    sums = np.zeros(BITS, np.int64)
    for at in range(0, n, _SLICE):
        stop = min(n, at + _SLICE)
        last = ends[at + width - 1:stop + width - 1] if len(words) >= width else ends[-1:]
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at:stop].tolist(), last.tolist())], "<u8")
        sums += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * sums > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, text: str = "text", keep: list[str] | None = None,
                 name: str = "fp") -> DataFrame:
    """Append the fingerprint (as a signed long) of each whole text."""

    def run(column: pa.Array) -> list:
        return [pa.array(np.array([fingerprint(b, width) for b in as_bytes(column)], np.uint64).view(np.int64))]

    return arrow_columns(docs, text, run, "fp bigint", [name], keep)


def blocks_for(n: int, radius: int, bits: int = BITS) -> int:
    """Blocks to cut fingerprints into, so that a key's list holds few of ``n`` spread-out ones."""
    m = radius + 2
    while m < 3 * radius + 2 and n >> int(bits * (m - radius) / m) > 64:
        m += 1
    return m


def keys(fp: Column, m: int, radius: int, bits: int = BITS) -> Column:
    """The keys of a fingerprint: for each choice of m - radius blocks, their bits and its number."""
    edges = [round(bits * i / m) for i in range(m + 1)]
    masks = [sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in some) for some in combinations(range(m), m - radius)]
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in masks]
    return F.array(*[F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(x))) for i, x in enumerate(signed)])


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """64 planes of ceil(n / 64) words: bit i of a plane belongs to fingerprint i."""
    n = len(fps)
    padded = np.zeros(-(-n // 64) * 64, np.uint64)
    padded[:n] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def _shifted(planes: np.ndarray, words: np.ndarray, by: int) -> np.ndarray:
    """Words ``words`` of the planes moved so that bit i holds what bit i + by held."""
    skip, bit = divmod(by, 64)
    low = planes[:, words + skip]
    if not bit:
        return low
    return low >> np.uint64(bit) | planes[:, words + skip + 1] << np.uint64(64 - bit)


def close_pairs(fps: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of all pairs within one group at most ``radius`` (below 8) bits apart, by distance
    in the list. ``group`` is sorted."""
    n = len(fps)
    if n < 2:
        return
    change = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    last = np.repeat(change[1:], np.diff(change))  # where the group of each row ends
    longest = int(np.diff(change).max())
    bits = bit_planes(fps)
    words = bits.shape[1]
    planes = np.concatenate((bits, np.zeros((64, longest // 64 + 2), np.uint64)), axis=1)
    rows = np.arange(n)
    for by in range(1, longest):
        inside = np.zeros(words * 64, bool)
        inside[:n] = rows + by < last
        alive = np.packbits(inside, bitorder="little").view(np.uint64)
        at = np.flatnonzero(alive)
        live = alive[at]
        one, two, four, over = (np.zeros(len(at), np.uint64) for _ in range(4))
        for k in range(0, BITS, 8):
            x = planes[k:k + 8, at] ^ _shifted(planes[k:k + 8], at, by)
            # carry-save: planes go two by two into the ones, their carries into the twos, and so on
            for i in range(0, 8, 4):
                a = one ^ x[i]
                c1 = one & x[i] | a & x[i + 1]
                one = a ^ x[i + 1]
                a = one ^ x[i + 2]
                c2 = one & x[i + 2] | a & x[i + 3]
                one = a ^ x[i + 3]
                a = two ^ c1
                c4 = two & c1 | a & c2
                two = a ^ c2
                over |= four & c4
                four ^= c4
            if radius == 4:
                far = over | four & (one | two)
            else:
                far = over.copy()
                for d in range(radius + 1, 8):
                    far |= (one if d & 1 else ~one) & (two if d & 2 else ~two) & (four if d & 4 else ~four)
            left = (live & ~far) != 0
            if not left.all():  # abandon words in which all pairs are too far apart
                at, live, far = at[left], live[left], far[left]
                one, two, four, over = one[left], two[left], four[left], over[left]
            if not len(at):
                break
        if len(at):
            hit = np.unpackbits((live & ~far).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            w, b = np.nonzero(hit)
            i = at[w] * 64 + b
            yield i, i + by


def _edges(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compare(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            forest, out = Forest(len(fp)), []
            for i, j in close_pairs(fp.view(np.uint64), key, radius):
                out += forest.add(i, j)
            found = np.array(out, int).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(fp[found[:, 0]]), pa.array(fp[found[:, 1]])], names=["a", "b"])

        key, fp = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in batches:  # sorted by key: hold what one comparison takes, the last key may go on
            key = np.concatenate((key, b.column(0).to_numpy(zero_copy_only=False)))
            fp = np.concatenate((fp, b.column(1).to_numpy(zero_copy_only=False)))
            if len(key) >= BATCH:
                stop = int(np.searchsorted(key, key[-1], side="left"))
                for at, end in _steps(key, stop):
                    yield compare(key[at:end], fp[at:end])
                key, fp = key[stop:], fp[stop:]
        for at, end in _steps(key, len(key)):
            yield compare(key[at:end], fp[at:end])

    return run


def _steps(key: np.ndarray, stop: int) -> Iterator[tuple[int, int]]:
    """Cut [0, stop) into runs of whole keys of about BATCH rows."""
    at = 0
    while at < stop:
        end = min(stop, at + BATCH)
        if end < stop:
            end = int(np.searchsorted(key[:stop], key[end - 1], side="right"))
        yield at, end
        at = end


def links(distinct: DataFrame, radius: int, n: int, tile: int = TILE) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of column ``fp`` that join all that lie at most
    ``radius`` bits apart: a spanning forest of each tile, not all pairs."""
    spark = distinct.sparkSession
    m = blocks_for(n, radius)
    listed = distinct.select("fp", F.explode(keys(F.col("fp"), m, radius)).alias("key"))
    hot = (listed.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > tile)
           .select("key", F.ceil(2 * F.col("rows") / tile).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int")
    other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    # a part of a hot key meets every part: tile (i, j) holds the parts i and j
    tiled = (listed.join(hot, "key", "left").select("key", "fp", part.alias("i"), other.alias("j"), "parts")
             .where("parts is null or i <> j")
             .select(F.when(F.col("parts").isNull(), F.col("key"))
                     .otherwise(F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j"))).alias("key"), "fp"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = tiled.repartition(tasks, "key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(_edges(radius), "a bigint, b bigint").distinct()


def classes(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(fp, root, component_id) for the fingerprints in ``fps`` (doc_id, fp): root is the smallest
    fingerprint and component_id the smallest doc_id in the component of links of at most ``radius`` bits."""
    own = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(links(own.select("fp"), radius, own.count()), "a", "b")
    roots = own.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    return roots.join(least, "root").select("fp", "root", "component_id")


def simhash_near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id for every row of ``docs``."""
    fps = cut(fingerprints(docs, width, keep=["doc_id"]))
    return (fps.join(classes(fps, radius), "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def one_of_each(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """One row of each component, with the columns of ``docs``: the one with the smallest doc_id, of
    equal ids the one whose text has the smallest hash; components without any id keep one row too.
    What stays is decided on ids and hashes; texts move once: the list they meet and the rows of one id and
    text are dealt by the same columns."""
    digest = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    light = cut(fingerprints(docs.select("doc_id", "text", digest.alias("h")), width, keep=["doc_id", "h"]))
    rank = F.struct(F.col("doc_id").isNull().alias("z"), F.coalesce("doc_id", F.lit(0)).alias("i"), "h")
    chosen = (light.join(classes(light, radius).select("fp", "root"), "fp").groupBy("root").agg(F.min(rank).alias("k"))
              .select("k.z", "k.i", "k.h"))
    z, i, h = (fresh(docs, n) for n in ("__none", "__id", "__digest"))
    rows = docs.withColumns({z: F.col("doc_id").isNull(), i: F.coalesce("doc_id", F.lit(0)), h: digest})
    kept = rows.join(chosen.toDF(z, i, h), [z, i, h], "left_semi")
    return kept.dropDuplicates([z, i, h]).select(*[F.col(f"`{c}`") for c in docs.columns])
