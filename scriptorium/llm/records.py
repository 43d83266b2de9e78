"""Operator 3, token-ID output: length-delimited binary records with a separate offset index.

A file is a run of frames, all numbers little-endian:

    length uint64 | masked checksum of the length uint32 | payload | masked checksum of the payload uint32

with the CRC-32 of zlib, masked as ((crc >> 15 | crc << 17) + 0xA282EAD8) mod 2^32, so that the checksum
of data which holds checksums stays useful. A payload is flag uint8 (1: id given), width uint8 (bytes of an
id: 2 if the vocabulary's ids fit, else 4), id int64, ids unsigned ....
The index is a Parquet table with a row per record (file, offset, size, id, ids before it in its file), so
readers can deal records out anew, in any order, and fetch each by offset.

Defined results: a null or empty text is a record with the end id alone; rows with a null id come first
and keep a null id; repeated ids are all written, next to each other; an empty table gives no files and an
empty index; extra columns are not read. A task that runs again writes the same bytes under the same name.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import arrow_columns
from .tokens import WORDS, Memo, PerWorker, pieces, plain_tokenizer, spelled

# fixed values of the file format
MASK = 0xA282EAD8
HEAD, SUM, KEY = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<BBq")
INDEX = "file string, offset bigint, size bigint, doc_id bigint, before bigint, n_tokens bigint"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(body: bytes) -> bytes:
    length = struct.pack("<Q", len(body))
    return b"".join((length, SUM.pack(masked(length)), body, SUM.pack(masked(body))))


def payload(doc_id: int | None, ids: bytes, width: int = 4) -> bytes:
    return KEY.pack(doc_id is not None, width, doc_id or 0) + ids


def parts(data: bytes) -> tuple[int | None, bytes]:
    """(doc_id, ids as unsigned 32-bit integers) of a payload."""
    given, width, key = KEY.unpack_from(data)
    ids = data[KEY.size:]
    return (key if given else None), ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def unframe(data: bytes) -> bytes:
    """The payload of one frame; raises ValueError where a length or checksum doesn't hold."""
    length, check = HEAD.unpack_from(data)
    if check != masked(data[:8]) or len(data) != HEAD.size + length + SUM.size:
        raise ValueError("damaged record length")
    body = data[HEAD.size:HEAD.size + length]
    if SUM.unpack_from(data, HEAD.size + length)[0] != masked(body):
        raise ValueError("damaged record")
    return body


class Encoder:
    """Whole texts to ids with the tokenizers library. Plain texts go word by word through the library's
    model, so that a word costs the library once; other pieces go through all of its steps."""

    def __init__(self, content: str):
        self.library = plain_tokenizer(content)
        self.model = self.library.model
        self.width = 2 if max(self.library.get_vocab().values(), default=0) < 1 << 16 else 4
        self.ids = Memo(lambda w: self.pack([t.id for t in self.model.tokenize(spelled(w))]))

    def pack(self, ids: list[int]) -> bytes:
        """The ids as they are stored (struct raises an error for one that does not fit)."""
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def encode(self, text: str) -> bytes:
        return b"".join([b"".join(map(self.ids.__getitem__, WORDS.findall(piece.lower()))) if plain
                         else self.pack(self.library.encode(piece, add_special_tokens=False).ids)
                         for plain, piece in pieces(text)])


_PER_WORKER = PerWorker(Encoder)


def encoder(shared: Broadcast) -> Encoder:
    return _PER_WORKER(shared)


def _store(path: str):
    """The file system of a folder that all executors share (local mount, HDFS, object store)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{os.path.abspath(path)}")


def write_records(docs: DataFrame, shared: Broadcast, path: str, end_id: int = 2, partitions: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write ``path``/records in ascending order of doc_id, one file
    per range of ids, and the index ``path``/index. Returns the index as read back.

    One shuffle, by ranges of the id (a repeated id may span files); each task streams its range, so
    memory is bounded by a batch and no file waits for another."""
    spark = docs.sparkSession
    by = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *by).sortWithinPartitions(*by, "text")
    folder = f"{path}/records"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(folder)
        name = f"part-{TaskContext.get().partitionId():06d}.rec"
        draft, out, offset, before = f"{top}/_{name}-{uuid.uuid4().hex}", None, 0, 0
        enc = encoder(shared)
        end, width = enc.pack([end_id]), enc.width
        for batch in batches:
            if out is None and batch.num_rows:
                store.create_dir(top, recursive=True)
                out = store.open_output_stream(draft)
            at, sizes, keys, starts, tokens = [], [], batch.column(0).to_pylist(), [], []
            for key, text in zip(keys, batch.column(1)):
                ids = enc.encode(text.as_py() or "") + end
                got = frame(payload(key, ids, width))
                out.write(got)
                at.append(offset), sizes.append(len(got)), starts.append(before), tokens.append(len(ids) // width)
                offset, before = offset + len(got), before + len(ids) // width
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), *(pa.array(x, pa.int64()) for x in (at, sizes, keys, starts, tokens))],
                names=["file", "offset", "size", "doc_id", "before", "n_tokens"])
        if out is not None:
            out.close()
            store.move(draft, f"{top}/{name}")  # whole files only, whichever attempt is last

    ranged.mapInArrow(run, INDEX).write.mode("overwrite").parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def read_records(spark: SparkSession, path: str, index: DataFrame | None = None) -> DataFrame:
    """Fetch records by offset: file, offset, before, doc_id (as stored) and ids (binary, uint32) for each
    row of ``index`` (all by default), checked. Rows may come in any order and partitioning."""
    index = index if index is not None else spark.read.parquet(f"{path}/index")
    folder = f"{path}/records"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(folder)
        name, source = None, None
        for batch in batches:
            keys, ids = [], []
            for file, offset, size in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, store.open_input_file(f"{top}/{file}")
                source.seek(offset)
                key, data = parts(unframe(source.read(size)))
                keys.append(key), ids.append(data)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(keys, pa.int64()), pa.array(ids, pa.binary())],
                names=["file", "offset", "before", "doc_id", "ids"])

    return (index.select("file", "offset", "size", "before")
            .mapInArrow(run, "file string, offset bigint, before bigint, doc_id bigint, ids binary"))


def record_digest(docs: DataFrame, shared: Broadcast, path: str | None = None, end_id: int = 2) -> DataFrame:
    """Write, read back, and describe what the files hold: doc_id, start (ids of all records before this
    one), n_tokens, ids_crc32, and where the record lies. Running sums cross files through one row per
    file (as many as the write had tasks), never through one row per document."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "records")
    index = write_records(docs, shared, path, end_id)
    base, total = {}, 0
    for r in sorted(index.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect()):
        base[r.file], total = total, total + r.n

    def run(column: pa.Array) -> list:
        ids = column.to_pylist()
        return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())]

    firsts = spark.createDataFrame(sorted(base.items()), "file string, base bigint")
    read = arrow_columns(read_records(spark, path, index), "ids", run, "n_tokens bigint, ids_crc32 bigint",
                         keep=["file", "offset", "before", "doc_id"])
    return (read.join(F.broadcast(firsts), "file")
            .select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "file", "offset"))
