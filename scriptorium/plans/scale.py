"""Skew-safe building blocks for ordered work over keys that may be very large.

A window ``partitionBy(key)`` sends every row of a key to one task. When one key can hold a third of
the data (a topic partition, one busy task), that task becomes the whole job. The helpers below
range-partition on ``(key, order)`` instead, so a large key is cut into contiguous chunks that run
in parallel; a small per-(key, chunk) table carries what crosses chunk borders.

* ``running_sum`` / ``running_count``: ordinal or running total per key (offsets, byte budgets).
* ``next_match``: for every row, a payload of the first later row of the same key that satisfies a
  condition (successor pointers for the ledger state machine).

Within a chunk the rows are already sorted, so the scan is a per-partition pass over Arrow batches
(``mapInArrow``: columns pass through unchanged, 64-bit integers stay integers beside NULLs) carrying
O(1) state between batches; nothing is collected per key. There is one path, whatever the sizes; NULL
keys are one key, as in a window.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

_CHUNK = "_chunk"


def _join_null_safe(left: DataFrame, right: DataFrame, cols: list[str], how: str) -> DataFrame:
    """Equi-join in which NULL keys match each other; the columns of ``right`` follow without its keys."""
    names = {c: f"_r_{i}" for i, c in enumerate(cols)}
    renamed = right.withColumnsRenamed(names)
    on = None
    for c, r in names.items():
        term = left[c].eqNullSafe(renamed[r])
        on = term if on is None else on & term
    return left.join(renamed, on, how).drop(*names.values())


def _n_chunks(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _runs(keys: list[pa.Array], n: int, last: list[pa.Array] | None) -> tuple[np.ndarray, np.ndarray, bool]:
    """Runs of equal keys in a sorted batch of ``n`` rows: the run of each row, where each run
    starts, and whether the first run goes on from ``last``, the key of the row before the batch."""
    new = np.zeros(n, bool)
    for i, col in enumerate(keys):
        both = pa.concat_arrays([last[i] if last else col.slice(0, 1), col])
        codes = both.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        new |= codes[1:] != codes[:-1]
    goes_on = last is not None and not new[0]
    new[0] = True
    return np.cumsum(new) - 1, np.flatnonzero(new), bool(goes_on)


def running_sum(df: DataFrame, part_cols: Sequence[str], order_cols: Sequence, value_col, out: str | None = None,
                n_chunks: int | None = None) -> DataFrame:
    """Running totals per key in ``order_cols`` order (current row included; the order must be
    total; a NULL value counts as 0). ``value_col`` is a column name (result in ``out``), None for a row
    count, or a dict ``{out: value column}`` to compute several totals in one pass."""
    sums = dict(value_col) if isinstance(value_col, dict) else {out: value_col}
    n = _n_chunks(df, n_chunks)
    order = [_col(c) for c in order_cols]
    parts = [F.col(c) for c in part_cols]
    vals = {o: f"_val{i}" for i, o in enumerate(sums)}
    src = df
    for o, v in sums.items():
        src = src.withColumn(vals[o], F.lit(1).cast("long") if v is None else F.coalesce(F.col(v).cast("long"), F.lit(0)))
    ranged = src.repartitionByRange(n, *parts, *order).sortWithinPartitions(*parts, *order)
    schema = T.StructType(src.schema.fields + [T.StructField(_CHUNK, T.IntegerType())]
                          + [T.StructField(o, T.LongType()) for o in sums])
    keys_, names = list(part_cols), schema.names

    def scan(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        last, carry = None, [0] * len(sums)
        for b in batches:
            if not b.num_rows:
                continue
            keys = [_column(b, c) for c in keys_]
            run, starts, goes_on = _runs(keys, b.num_rows, last)
            totals = []
            for i, v in enumerate(vals.values()):
                x = _column(b, v).to_numpy(zero_copy_only=False)
                cum = np.cumsum(x, dtype=np.int64)
                cum = cum - (cum[starts] - x[starts])[run]
                if goes_on:
                    cum[run == 0] += carry[i]
                carry[i] = int(cum[-1])
                totals.append(pa.array(cum, pa.int64()))
            last = [c.slice(b.num_rows - 1, 1) for c in keys]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, pid, np.int32)), *totals], names=names)

    # Range bounds come from sampling and differ between jobs, so the chunked scan is written once
    # (reliable checkpoint in the shared folder) and both the rows and the chunk totals read it.
    scanned = cut_lineage(ranged.mapInArrow(scan, schema))
    totals = scanned.groupBy(*keys_, _CHUNK).agg(*[F.sum(vals[o]).alias(f"_tot_{o}") for o in sums])
    before = Window.partitionBy(*keys_).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*keys_, _CHUNK, *[F.coalesce(F.sum(f"_tot_{o}").over(before), F.lit(0)).alias(f"_base_{o}")
                                           for o in sums])
    res = _join_null_safe(scanned, base, [*keys_, _CHUNK], "inner")
    for o in sums:
        res = res.withColumn(o, F.col(o) + F.col(f"_base_{o}"))
    return res.drop(_CHUNK, *vals.values(), *[f"_base_{o}" for o in sums])


def running_count(df: DataFrame, part_cols: Sequence[str], order_cols: Sequence, out: str,
                  n_chunks: int | None = None) -> DataFrame:
    """1-based ordinal per key (a skew-safe ``row_number``)."""
    return running_sum(df, part_cols, order_cols, None, out, n_chunks)


def next_match(df: DataFrame, key_cols: Sequence[str], order_cols: Sequence[str], cond: Column,
               payload: Sequence[str], prefix: str, n_chunks: int | None = None) -> DataFrame:
    """Adds ``{prefix}{p}`` for each payload column: the value on the first row strictly after the
    current one (same key, ascending ``order_cols``, which must be total) where ``cond`` holds;
    NULL when there is none. Chunked by range so a hot key spreads over many tasks."""
    return next_matches(df, key_cols, order_cols, {prefix: cond}, payload, n_chunks)


def next_matches(df: DataFrame, key_cols: Sequence[str], order_cols: Sequence[str], conds: dict[str, Column],
                 payload: Sequence[str], n_chunks: int | None = None) -> DataFrame:
    """Several ``next_match`` searches (one per prefix -> condition) in a single chunked scan."""
    n = _n_chunks(df, n_chunks)
    prefixes = list(conds)
    flags = [f"_m{i}" for i in range(len(prefixes))]
    hits = [f"_hit{i}" for i in range(len(prefixes))]
    src = df
    for f, p in zip(flags, prefixes):
        src = src.withColumn(f, F.coalesce(conds[p], F.lit(False)))
    keys_ = list(key_cols)
    # Range-partition ascending, scan each chunk in descending order: "next after" is then
    # "last match already seen", a forward fill.
    desc = [F.col(c).desc() for c in [*keys_, *order_cols]]
    ranged = (src.repartitionByRange(n, *[F.col(c) for c in keys_], *[F.col(c) for c in order_cols])
              .sortWithinPartitions(*desc))
    out_fields = [T.StructField(pre + p, src.schema[p].dataType) for pre in prefixes for p in payload]
    schema = T.StructType(src.schema.fields + [T.StructField(_CHUNK, T.IntegerType())]
                          + [T.StructField(h, T.BooleanType()) for h in hits] + out_fields)
    names = schema.names

    def scan(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        last: list[pa.Array] | None = None
        carry: list[list[pa.Array] | None] = [None] * len(prefixes)  # payload of the last match, one row each
        for b in batches:
            size = b.num_rows
            if not size:
                continue
            keys, given = [_column(b, c) for c in keys_], [_column(b, p) for p in payload]
            run, starts, goes_on = _runs(keys, size, last)
            found, values = [], []
            for i, flag in enumerate(flags):
                m = _column(b, flag).to_numpy(zero_copy_only=False)
                upto = np.maximum.accumulate(np.where(m, np.arange(size), -1))
                seen = np.concatenate(([-1], upto[:-1]))  # the last match before each row
                inside = seen >= starts[run]
                held = ~inside & (run == 0) & (goes_on and carry[i] is not None)
                # row 0 of what is taken from is the carried match, row j + 1 is row j of the batch
                take = pa.array(np.where(inside, seen + 1, 0), pa.int64(), mask=~(inside | held))
                for j, col in enumerate(given):
                    first = carry[i][j] if carry[i] is not None else pa.nulls(1, col.type)
                    values.append(pa.concat_arrays([first, col]).take(take))
                found.append(pa.array(inside | held))
                if upto[-1] >= starts[-1]:
                    carry[i] = [col.slice(int(upto[-1]), 1) for col in given]
                elif not (goes_on and len(starts) == 1):
                    carry[i] = None
            last = [c.slice(size - 1, 1) for c in keys]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(size, pid, np.int32)), *found, *values], names=names)

    # Range bounds come from sampling and differ between jobs: write the chunked scan once.
    scanned = cut_lineage(ranged.mapInArrow(scan, schema))
    # First match of each (key, chunk) per condition, then the first one in any later chunk.
    heads = scanned.groupBy(*keys_, _CHUNK).agg(*[
        F.min(F.when(F.col(f), F.struct(*[F.col(c) for c in order_cols], *[F.col(p).alias("p_" + p) for p in payload])))
        .alias(f"_head{i}") for i, f in enumerate(flags)])
    later = Window.partitionBy(*keys_).orderBy(_CHUNK).rowsBetween(1, Window.unboundedFollowing)
    link = heads.select(*keys_, _CHUNK, *[F.first(f"_head{i}", ignorenulls=True).over(later).alias(f"_next{i}")
                                          for i in range(len(flags))])
    joined = _join_null_safe(scanned, link, [*keys_, _CHUNK], "left")
    for i, pre in enumerate(prefixes):
        missing = ~F.col(hits[i]) & F.col(f"_next{i}").isNotNull()
        for p in payload:
            joined = joined.withColumn(pre + p, F.when(missing, F.col(f"_next{i}")["p_" + p]).otherwise(F.col(pre + p)))
    return joined.drop(_CHUNK, *flags, *hits, *[f"_next{i}" for i in range(len(flags))])
