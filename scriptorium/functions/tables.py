"""Table functions for SQL users."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf, udtf

from ..operators import converters as CV


@udtf(returnType="block_idx int, type string, level int, text string", useArrow=True)
class ExplodeBlocks:
    """``LATERAL explode_blocks(html)``: the blocks of one row's HTML."""

    def __init__(self):
        self.conv = CV.HtmlConverter()

    def eval(self, html: str):
        for i, (t, lv, x) in enumerate(self.conv.convert(html)):
            yield i, t, lv, x


@arrow_udtf(returnType="doc_id long, block_idx int, type string, level int, text string")
class BlocksOfTable:
    """``blocks_of_table(TABLE(t))``: the blocks of a table's documents (doc_id, content as HTML text or UTF-8
    bytes), one Arrow batch at a time. A document that cannot be read gives one row ``(doc_id, -1, "error",
    NULL, message)``, the others go on; NULL or empty content gives no rows. Columns are found by name, others are left alone."""

    def __init__(self):
        self.conv = CV.HtmlConverter()

    def _blocks(self, content):
        try:
            text = content.decode("utf-8") if isinstance(content, (bytes, bytearray)) else content
            return [(i, *b) for i, b in enumerate(self.conv.convert(text))]
        except Exception as e:  # noqa: BLE001 - recorded as this document's row
            return [(-1, "error", None, f"{type(e).__name__}: {e}")]

    def eval(self, table):
        flat = [(row, *b) for row, content in enumerate(table.column("content").to_pylist()) for b in self._blocks(content)]
        rows, idx, kind, level, text = list(zip(*flat)) or [()] * 5
        yield pa.table({"doc_id": table.column("doc_id").take(pa.array(rows, pa.int32())).cast(pa.int64()), "block_idx": pa.array(idx, pa.int32()),
                        "type": pa.array(kind, pa.string()), "level": pa.array(level, pa.int32()), "text": pa.array(text, pa.string())})


def register_explode_blocks(spark: SparkSession) -> None:
    """``explode_blocks(html)`` for each row, ``blocks_of_table(TABLE(t))`` for whole tables."""
    spark.udtf.register("explode_blocks", ExplodeBlocks)
    spark.udtf.register("blocks_of_table", BlocksOfTable)
