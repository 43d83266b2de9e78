"""Shared helpers: temporary column names, Arrow column functions, reliable lineage cuts, bounded samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir

#: ASCII white space; words are ``[^\x20\x09-\x0D]+``, which is what ``bytes.split()`` yields.
WHITE = b" \t\n\x0b\x0c\r"
_MASK = 1 << 31


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def as_bytes(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_text(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def arrow_columns(df: DataFrame, column: str, fn: Callable[[pa.Array], list], fields: str,
                  names: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Append columns that ``fn`` computes from one column, batch by batch (``mapInArrow``: narrow,
    no shuffle, memory bounded by a batch). ``fields`` is their DDL, ``names`` renames them, and
    ``keep`` are the input columns that pass through (all by default)."""
    keep = df.columns if keep is None else keep
    added = T.StructType.fromDDL(fields)
    if names:
        added = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, added.fields, strict=True)])
    src = df.select(*[df[c] for c in keep], df[column].alias(probe := fresh(df, "__input")))
    schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in keep] + added.fields)
    labels, kinds = schema.names, [_arrow_type(f.dataType) for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = fn(b.column(b.schema.get_field_index(probe)))
            new = [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(got, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], names=labels)

    return src.mapInArrow(run, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives lost executors, never computed twice."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded(df: DataFrame, key: Column, most: int) -> DataFrame:
    """An expected ``most`` rows of ``df``, chosen by a hash of ``key`` (all rows, if there are no
    more). The same rows whatever the partitioning. Only for fitting models on labelled rows."""
    total = df.count()
    if total <= most:
        return df
    return df.where(F.pmod(F.xxhash64(key, F.lit(17)), F.lit(_MASK)) < int(_MASK * most / total))

