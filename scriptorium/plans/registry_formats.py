"""Registered queries over files of many formats (P7d, P1b, F5b, K1b), the middle JSON read back as Variant (P4b) and the
table function for blocks (X3). Files are written from ``documents`` inside tasks, as real bytes."""

from __future__ import annotations

import io
import json
import os
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.tables import register_explode_blocks
from ..operators import documents as D
from ..operators import formats as FM
from ..session import load, scratch_path, spread
from ..sources.objects import upload_objects
from ..streaming import jobs as J
from . import fixtures as fx
from .catalog import ORACLE, register
from .registry_documents import _doc_blocks, _html, _lines

# ------------------------------------------------------------------ files of many formats

_NS = ('xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" '
       'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" '
       'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"')
_SUFFIXES = ["csv", "json", "json", "xml", "docx", "pptx", "xlsx", "docx", "json"]
SLIDE = 5  # lines on a slide


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


def _relations(targets: list[str]) -> str:
    return "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="{t}"/>' for i, t in enumerate(targets)) + "</Relationships>"


def _docx(doc_id, lines):
    def p(text, style=""):
        return f'<w:p><w:pPr>{style}</w:pPr><w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'

    body = p(f"Document {doc_id}", '<w:pStyle w:val="Heading1"/>')
    body += "".join(p(x, "" if i % 3 else "<w:numPr/>") for i, x in enumerate(lines))
    rows = [("id", "lines"), (str(doc_id), str(len(lines)))]
    body += "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"
    return _zip({"word/document.xml": f"<w:document {_NS}><w:body>{body}</w:body></w:document>"})


def _pptx(doc_id, lines):
    def shape(text, kind=""):
        return f"<p:sp><p:nvPr>{kind}</p:nvPr><p:txBody>" + "".join(f"<a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p>" for t in text) + "</p:txBody></p:sp>"

    slides = [lines[i:i + SLIDE] for i in range(0, len(lines), SLIDE)]
    files = [f"slides/slide{len(slides) - i}.xml" for i in range(len(slides))]  # numbered backwards
    parts = {"ppt/presentation.xml": f"<p:presentation {_NS}>" + "".join(f'<p:sldId id="{i}" r:id="r{i}"/>' for i in range(len(slides))) + "</p:presentation>",
             "ppt/_rels/presentation.xml.rels": _relations(files)}
    for i, (name, text) in enumerate(zip(files, slides)):
        parts["ppt/" + name] = f"<p:sld {_NS}>" + shape([f"Slide {i + 1}"], '<p:ph type="title"/>') + shape(text) + "</p:sld>"
    return _zip(parts)


def _xlsx(doc_id, lines):
    def cell(ref, text, shared=None):
        if shared is not None:
            return f'<c r="{ref}" t="s"><v>{shared}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t>{escape(text)}</t></is></c>'

    rows = "".join(f'<row><c r="A{i + 2}"><v>{i}</v></c>' + cell(f"C{i + 2}", x, i // 2 if i % 2 == 0 else None) + "</row>" for i, x in enumerate(lines))
    header = "<row>" + cell("A1", "n") + cell("C1", "line") + "</row>"
    strings = "".join(f"<si><t>{escape(x)}</t></si>" for x in lines[::2])
    return _zip({"xl/workbook.xml": f'<workbook {_NS}><sheets><sheet name="Lines" r:id="r0"/><sheet name="Empty" r:id="r1"/></sheets></workbook>',
                 "xl/_rels/workbook.xml.rels": _relations(["worksheets/sheet1.xml", "/xl/worksheets/sheet2.xml"]),
                 "xl/sharedStrings.xml": f"<sst>{strings}</sst>",
                 "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{header}{rows}</sheetData></worksheet>",
                 "xl/worksheets/sheet2.xml": "<worksheet><sheetData/></worksheet>"})


def _file(doc_id: int, lines: list[str]) -> bytes:
    kind = doc_id % 9
    if kind == 0:
        quoted = [f'{i},"{x.replace(chr(34), chr(34) * 2)}\n{i}"\r\n' for i, x in enumerate(lines)]
        return ("\ufeffn,line,\r\n\r\n" + "".join(quoted)).encode()
    if kind == 1:
        return json.dumps(lines).encode()
    if kind == 2:
        return json.dumps({f"{i:06d}": x for i, x in enumerate(lines)}, ensure_ascii=False).encode()
    if kind == 3:
        return (f'<?xml version="1.0"?><doc id="{doc_id}"><title>Document {doc_id}</title>'
                + "".join(f"<line>{escape(x)}<n>{i}</n> after</line>\n" for i, x in enumerate(lines)) + "</doc>").encode()
    if kind == 8:
        return ('{"lines": ' + json.dumps(lines)).encode()
    made = {4: _docx, 5: _pptx, 6: _xlsx, 7: _docx}[kind](doc_id, lines)
    return made if kind != 7 else made[:len(made) // 2]


def files_of_kinds(spark, sf):
    """Every document as a file (doc_id, file_name, content) of one of nine kinds, by id: CSV, JSON (array, object),
    XML, text document, slides, workbook, a zip file cut in half and malformed JSON."""
    suffix = F.element_at(F.array(*[F.lit(s) for s in _SUFFIXES]), (F.col("doc_id") % 9 + 1).cast("int"))
    # white space and characters that XML does not allow become one space
    line = lambda x: F.trim(F.regexp_replace(x, r"[\x00-\x20\x{FFFE}\x{FFFF}]+", " "))
    docs = load(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("."), suffix).alias("file_name"),
        F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line), lambda x: x != "").alias("lines"))

    def write(batches):
        for b in (x.slice(at, D.CONVERT_ROWS) for x in batches for at in range(0, x.num_rows, D.CONVERT_ROWS)):
            made = [_file(i, x) for i, x in zip(b.column("doc_id").to_pylist(), b.column("lines").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("file_name"), pa.array(made, pa.binary())], names=["doc_id", "file_name", "content"])

    return spread(docs).mapInArrow(write, "doc_id long, file_name string, content binary")


_FILES_SQL = """clines AS (
  SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY j) - 1 AS bigint) AS i, line
  FROM (SELECT doc_id, generate_subscripts(ls, 1) AS j,
               trim(regexp_replace(unnest(ls), '[\\x00-\\x20\\x{FFFE}\\x{FFFF}]+', ' ', 'g'), ' ') AS line
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
  WHERE line <> ''),
agg AS (
  SELECT d.doc_id, d.doc_id % 9 AS kind, count(l.i) AS n, (count(l.i) + 4) // 5 AS slides,
         coalesce(string_agg('| ' || i || ' | ' || replace(line, '|', '\\|') || ' ' || i || ' |', chr(10) ORDER BY i), '') AS csv_rows,
         coalesce(string_agg('| ' || i || ' |  | ' || replace(line, '|', '\\|') || ' |', chr(10) ORDER BY i), '') AS sheet_rows,
         string_agg('- ' || line, chr(10) || chr(10) ORDER BY i) AS items,
         string_agg(printf('%06d', i) || ': ' || line, chr(10) || chr(10) ORDER BY i) AS members,
         string_agg(line || chr(10) || chr(10) || i || chr(10) || chr(10) || 'after', chr(10) || chr(10) ORDER BY i) AS elements,
         string_agg(CASE WHEN i % 3 = 0 THEN '- ' ELSE '' END || line, chr(10) || chr(10) ORDER BY i) AS paragraphs,
         string_agg(CASE WHEN i % 5 = 0 THEN '# Slide ' || (i // 5 + 1) || chr(10) || chr(10) ELSE '' END || line, chr(10) || chr(10) ORDER BY i) AS slide_text
  FROM documents d LEFT JOIN clines l ON d.doc_id = l.doc_id GROUP BY d.doc_id)"""
_GAP = "chr(10) || chr(10)"


@register("P7d_formats", f"""
WITH {_FILES_SQL}
SELECT doc_id, CASE kind WHEN 0 THEN 'csv' WHEN 3 THEN 'xml' WHEN 1 THEN 'json' WHEN 2 THEN 'json' WHEN 8 THEN 'json' ELSE 'office' END AS converter,
       CASE WHEN kind >= 7 THEN 'failed' ELSE 'completed' END AS status,
       cast(CASE kind WHEN 0 THEN 1 WHEN 1 THEN n WHEN 2 THEN n WHEN 3 THEN 3 * n + 1 WHEN 4 THEN n + 2 WHEN 5 THEN n + slides WHEN 6 THEN 3 END AS int) AS n_blocks,
       md5(CASE kind WHEN 0 THEN '| n | line |  |' || chr(10) || '| --- | --- | --- |' || CASE WHEN n > 0 THEN chr(10) ELSE '' END || csv_rows
                     WHEN 1 THEN coalesce(items, '') WHEN 2 THEN coalesce(members, '')
                     WHEN 3 THEN 'Document ' || doc_id || coalesce({_GAP} || elements, '')
                     WHEN 4 THEN '# Document ' || doc_id || coalesce({_GAP} || paragraphs, '') || {_GAP}
                                 || '| id | lines |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || doc_id || ' | ' || n || ' |'
                     WHEN 5 THEN coalesce(slide_text, '')
                     WHEN 6 THEN '## Lines' || {_GAP} || '| n |  | line |' || chr(10) || '| --- | --- | --- |'
                                 || CASE WHEN n > 0 THEN chr(10) ELSE '' END || sheet_rows || {_GAP} || '## Empty' END) AS markdown_md5,
       CASE kind WHEN 7 THEN 'BadZipFile: File is not a zip file' WHEN 8 THEN 'ValueError: not valid JSON' END AS error_message
FROM agg""")
def p7d(spark, sf):
    """Files of nine kinds through the conversion batch: whole Markdown and failures."""
    out = D.convert_documents(files_of_kinds(spark, sf))
    return out.select("doc_id", "converter", "status", "n_blocks", F.md5("markdown").alias("markdown_md5"), "error_message")


@register("P1b_blocks_of_files", f"""
WITH {_FILES_SQL},
b AS (SELECT doc_id, unnest(CASE kind WHEN 0 THEN [('table', 1)] WHEN 1 THEN [('list_item', n)] WHEN 2 THEN [('paragraph', n)]
        WHEN 3 THEN [('paragraph', 3 * n + 1)]
        WHEN 4 THEN [('heading', 1), ('list_item', (n + 2) // 3), ('paragraph', n - (n + 2) // 3), ('table', 1)]
        WHEN 5 THEN [('heading', slides), ('paragraph', n)] WHEN 6 THEN [('heading', 2), ('table', 1)]
        ELSE [('error', 1)] END) AS x FROM agg)
SELECT doc_id, x[1] AS type, cast(x[2] AS bigint) AS n_blocks FROM b WHERE x[2] > 0""")
def p1b(spark, sf):
    """The same files to blocks: how many of each type, a file that cannot be read as one error."""
    return D.documents_to_blocks(files_of_kinds(spark, sf)).groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n_blocks"))


@register("F5b_sniff_office", """
SELECT doc_id, CASE doc_id % 9 WHEN 4 THEN 'docx' WHEN 5 THEN 'pptx' WHEN 6 THEN 'xlsx' WHEN 7 THEN 'zip' ELSE 'unsupported' END AS format,
       CASE WHEN doc_id % 9 BETWEEN 4 AND 7 THEN 'zip' ELSE 'unsupported' END AS signature FROM documents""")
def f5b(spark, sf):
    """Formats by the zip directory beside those by the leading bytes."""
    return files_of_kinds(spark, sf).select("doc_id", FM.sniff_office("content").alias("format"), C.sniff_format("content").alias("signature"))


INGEST_FILES = 2_000  # files a micro-batch


@register("K1b_ingest_tree", f"""
SELECT doc_id, converter, status, n_blocks, markdown_md5, error_message, status = 'completed' AS has_result, 'ingest' AS worker_id, 0 AS retry_count
FROM ({ORACLE["P7d_formats"]}) x""")
def k1b(spark, sf):
    """The files of nine kinds as a folder tree, read as a stream into outcomes and ledger; then the whole stream
    runs again without its checkpoint into the same folder, in one batch, which changes nothing."""
    root, out = scratch_path(spark, "tree"), scratch_path(spark, "ingested")
    name = F.concat((F.col("doc_id") / 1000).cast("long").cast("string"), F.lit("/"), F.col("file_name"))
    upload_objects(files_of_kinds(spark, sf).select(F.col("doc_id").alias("task_id"), F.col("file_name").alias("path"),
                                                    name.alias("object_name"), name.alias("url"), "content"), root)
    for files in (INGEST_FILES, None):
        J.ingest_tree(spark, root, out, scratch_path(spark, "ingest-ckpt"), fx.AS_OF, glob="doc*", max_files=files)
    ledger, results = J.read_ingested(spark, out)
    doc_id = F.regexp_extract("file_name", "^doc([0-9]+)", 1).cast("long").alias("doc_id")
    return (ledger.select("task_id", doc_id, "status", "error_message", F.col("result_path").isNotNull().alias("has_result"), "worker_id", "retry_count")
            .join(results.select("task_id", "converter", "n_blocks", F.md5("markdown").alias("markdown_md5")), "task_id").drop("task_id"))


# ------------------------------------------------------------------ middle JSON as data

_TYPED = """CASE WHEN regexp_matches(text, '^#{1,6} +') THEN 'heading' WHEN starts_with(text, '- ') OR starts_with(text, '* ') THEN 'list_item'
     WHEN starts_with(text, '|') THEN 'table' WHEN starts_with(text, '$$') AND ends_with(text, '$$') AND length(text) > 4 THEN 'equation' ELSE 'paragraph' END"""


@register("P4b_middle_json_variant", f"""
WITH {_lines()},
typed AS (SELECT doc_id, block_idx, text, {_TYPED} AS type FROM tblocks),
whole AS (SELECT doc_id, cast(block_idx // 20 AS int) AS page_idx, block_idx, type,
       md5(CASE type WHEN 'heading' THEN regexp_replace(text, '^#{{1,6}} +', '') WHEN 'list_item' THEN substr(text, 3)
                     WHEN 'equation' THEN substr(text, 3, length(text) - 4) ELSE text END) AS text_md5
  FROM typed WHERE doc_id % 7 <> 3)
SELECT *, false AS malformed FROM whole
UNION ALL SELECT DISTINCT doc_id, NULL, NULL, NULL, NULL, true FROM tblocks WHERE doc_id % 7 = 3""")
def p4b(spark, sf):
    """The middle JSON of every document read back to blocks; each seventh document's JSON is cut short."""
    made = D.middle_json(_doc_blocks(spark, sf)).select(
        "doc_id", F.when(F.col("doc_id") % 7 == 3, F.expr("left(middle_json, length(middle_json) - 2)")).otherwise(F.col("middle_json")).alias("middle_json"))
    return D.read_middle_json(made).select("doc_id", "page_idx", "block_idx", "type", F.md5("text").alias("text_md5"), "malformed")


# ------------------------------------------------------------------ X3

@register("X3_explode_blocks_udtf", f"""
WITH {_html()}
SELECT doc_id AS page_id, cast(n_heading + n_paragraph + n_list_item + n_text AS bigint) AS n_blocks,
       cast(n_heading AS bigint) AS n_heading FROM hcount
WHERE n_heading + n_paragraph + n_list_item + n_text > 0""")
def x3(spark, sf):
    register_explode_blocks(spark)
    view = "pages_" + os.urandom(4).hex()
    spread(load(spark, sf, "pages")).createOrReplaceTempView(view)
    return spark.sql(f"""SELECT p.page_id, count(*) AS n_blocks, count_if(b.type = 'heading') AS n_heading
                         FROM {view} p, LATERAL explode_blocks(p.html) b GROUP BY p.page_id""")


@register("X3b_blocks_of_table", f"""
WITH {_html()}
SELECT doc_id AS page_id, cast(n_heading + n_paragraph + n_list_item + n_text AS bigint) AS n_blocks, 0::bigint AS n_errors
FROM hcount WHERE n_heading + n_paragraph + n_list_item + n_text > 0 AND doc_id % 50 <> 0
UNION ALL SELECT page_id, 1, 1 FROM pages WHERE page_id % 50 = 0""")
def x3b(spark, sf):
    """The vectorised table function over a whole table; every fiftieth page's bytes are no UTF-8 and give
    an error row each."""
    register_explode_blocks(spark)
    view = "pages_" + os.urandom(4).hex()
    bad = F.concat(F.unhex(F.lit("FF")), F.encode("html", "UTF-8"))
    (spread(load(spark, sf, "pages")).select(F.col("page_id").alias("doc_id"), F.when(F.col("page_id") % 50 == 0, bad).otherwise(F.encode("html", "UTF-8")).alias("content"))
     .createOrReplaceTempView(view))
    return spark.sql(f"""SELECT doc_id AS page_id, count(*) AS n_blocks, count_if(type = 'error') AS n_errors
                         FROM blocks_of_table(TABLE({view})) GROUP BY doc_id""")
