"""Operator 5, best-fit packing into several permitted sequence lengths.

Documents longer than the largest length are cut into full pieces and a rest, so nothing is truncated.
Pieces are dealt evenly over tasks; a task packs windows of bounded size, longest piece first, each into
the open bin with the least room that still takes it. If none does, a bin is opened: for each permitted
length the pieces that are still to come are tried against it, and the length with the least cost per
unit of content is taken (cost: its units, plus ``overhead`` units for the sequence itself). At the end
each bin is downsized to the smallest permitted length that holds its contents. Windows do not share
bins, which leaves at most a few unfilled bins per window.

Defined results: null and empty texts have length 0 (or ``end`` units with an end mark); pieces of
length 0 join any bin with free room or an empty bin of the smallest length; rows with a null doc_id and
repeated rows are packed like others; an empty table gives no bins; extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_columns, as_bytes, as_text
from .records import encoder

CAPACITIES = (512, 1024, 2048, 4096, 8192)
WINDOW = 50_000
SCHEMA = "bin_id bigint, capacity bigint, used bigint, offset bigint, doc_id bigint, start bigint, length bigint"


def fill(room: int, lengths: list[int], count: dict[int, int]) -> int:
    """How much of ``room`` a greedy choice among the pieces to come would use. ``lengths`` ascend."""
    used, i = 0, len(lengths)
    while room - used > 0:
        i = bisect_left(lengths, room - used + 1, 0, i) - 1
        if i < 0 or not lengths[i]:
            break
        used += lengths[i] * min(count[lengths[i]], (room - used) // lengths[i])
    return used


def pack_window(sizes: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = 16) -> list[tuple[int, int, int]]:
    """(bin, capacity, offset) for each piece of ``sizes``, none longer than the largest capacity."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    count: dict[int, int] = {}
    for s in sizes:
        count[s] = count.get(s, 0) + 1
    lengths = sorted(count)
    rooms: list[tuple[int, int]] = []  # (room left, bin) of open bins, ascending
    used: list[int] = []
    placed: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    for i in order:
        size = sizes[i]
        count[size] -= 1
        if not count[size]:
            del count[size]
            lengths.pop()  # pieces come in descending order
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room = min((c for c in capacities if c >= size),
                       key=lambda c: ((c + overhead) / max(1, size + fill(c - size, lengths, count)), c))
            b = len(used)
            used.append(0)
        placed[i] = (b, used[b])
        used[b] += size
        if room - size:
            insort(rooms, (room - size, b))
    final = [min(c for c in capacities if c >= u) for u in used]
    return [(b, final[b], at) for b, at in placed]


def with_length(docs: DataFrame, text: str = "text", end: int = 1, shared: Broadcast | None = None) -> DataFrame:
    """doc_id and ``length``: the tokens of the whole text, by the tokenizer file in ``shared`` (as operator 3
    writes them), plus ``end`` units for an end mark. Without a file the units are words."""

    def run(column: pa.Array) -> list:
        if shared is None:
            return [pa.array([len(b.split()) + end for b in as_bytes(column)], pa.int64())]
        enc = encoder(shared)
        return [pa.array([len(enc.encode(t)) // enc.width + end for t in as_text(column)], pa.int64())]

    return arrow_columns(docs, text, run, "length bigint", keep=["doc_id"])


def best_fit_pack(lengths: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = 16,
                  window: int = WINDOW, tasks: int | None = None) -> DataFrame:
    """Pack the rows of ``lengths`` (doc_id, length): a row for each piece with its bin, the bin's final
    capacity and content, where the piece begins in the bin (``offset``) and in its document (``start``).

    The round-robin shuffle moves ids and lengths only; Spark sorts before it, so a task that runs again
    gets the same rows."""
    capacities = tuple(sorted(capacities))
    most = capacities[-1]
    n = tasks or int(lengths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = F.greatest(F.coalesce(F.col("length"), F.lit(0)), F.lit(0)).cast("long")
    last = F.greatest(F.ceil(size / most).cast("long") - 1, F.lit(0))
    pieces = (lengths.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.explode(F.sequence(F.lit(0), last)).alias("k"))
              .select("doc_id", (F.col("k") * most).alias("start"), F.least(F.lit(most), F.col("size") - F.col("k") * most).alias("length")))
    dealt = pieces.repartition(n).sortWithinPartitions("doc_id", "start", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, rows = TaskContext.get().partitionId(), 0, []

        def packed(part: list) -> pa.RecordBatch:
            nonlocal made
            where = pack_window([r[2] for r in part], capacities, overhead)
            used: dict[int, int] = {}
            for (b, _, _), r in zip(where, part):
                used[b] = used.get(b, 0) + r[2]
            base = (task << 40) + made
            made += len(used)
            cols = zip(*[(base + b, c, used[b], at, *r) for (b, c, at), r in zip(where, part)])
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols],
                                              names=["bin_id", "capacity", "used", "offset", "doc_id", "start", "length"])

        for batch in batches:
            rows += zip(*(batch.column(i).to_pylist() for i in range(3)))
            while len(rows) >= window:
                yield packed(rows[:window])
                rows = rows[window:]
        if rows:
            yield packed(rows)

    return dealt.mapInArrow(run, SCHEMA)
