"""CSV, JSON, XML and Office readers, the middle JSON as Variant, and the table function: edge cases."""

import csv
import io
import random
import zipfile

from pyspark.sql import functions as F

from scriptorium.functions.tables import register_explode_blocks
from scriptorium.operators import converters as CV
from scriptorium.operators import documents as D
from scriptorium.operators import formats as FM
from scriptorium.plans import registry_formats as RF

NS = RF._NS


def _zip(parts, comment=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
        z.comment = comment
    return out.getvalue()


def _outcomes(spark, files, schema="doc_id long, file_name string, content binary"):
    rows = D.convert_documents(spark.createDataFrame(files, schema)).collect()
    return {r.doc_id: r for r in rows}


def test_csv_rows_equal_the_csv_module(spark):
    rnd = random.Random(7)
    texts = []
    for _ in range(300):
        rows = [["".join(rnd.choice('ab",\n\r x') for _ in range(rnd.randrange(5))) for _ in range(rnd.randrange(1, 5))]
                for _ in range(rnd.randrange(1, 6))]
        out = io.StringIO()
        csv.writer(out, lineterminator=rnd.choice(["\n", "\r\n"])).writerows(rows)
        texts.append((rows, out.getvalue()))
    got = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "i long, t string").select("i", FM.csv_rows("t").alias("r")).collect()
    flat = lambda c: " ".join(c.replace("\r", " ").replace("\n", " ").split(" ")).strip(" ")
    squeeze = lambda c: " ".join(x for x in flat(c).split(" ") if x)
    for r in got:
        assert [list(x) for x in r.r] == [[squeeze(c) for c in row] for row in texts[r.i][0]], texts[r.i][1]


def test_csv_long_unclosed_ragged_and_empty(spark):
    many = "a,b\n" + "\n".join('"x ""y""",z' for _ in range(200_000))
    files = [(1, "a.csv", many.encode()), (2, "b.csv", b'p|q,r\n1\n2,3,4\n5,"open, end\nof'), (3, "c.csv", b""), (4, "d.csv", None), (5, "e.csv", b"\n\r\n")]
    got = _outcomes(spark, files)
    assert got[1].status == "completed" and got[1].markdown.count("\n") == 200_001
    assert got[2].markdown == "| p\\|q | r |  |\n| --- | --- | --- |\n| 1 |\n| 2 | 3 | 4 |\n| 5 | open, end of |"
    assert [(got[i].status, got[i].n_blocks, got[i].markdown) for i in (3, 4, 5)] == [("completed", 0, "")] * 3


def test_json_kinds(spark):
    files = [(1, "a.json", b'{"b": [1, {"x": null}], "a": "two\\n lines", "c": null}'), (2, "b.json", b'[1, "x", null, [true]]'), (3, "c.json", b'"only"'),
             (4, "d.json", b"{"), (5, "e.json", None), (6, "f.json", b"null"), (7, "g.json", b"{}"), (8, "h.json", b"")]
    got = _outcomes(spark, files)
    assert got[1].markdown == 'a: two lines\n\nb: [1,{"x":null}]\n\nc: null'
    assert got[2].markdown == "- 1\n\n- x\n\n- null\n\n- [true]"
    assert got[3].markdown == "only" and got[6].markdown == "null"
    assert [got[i].error_message for i in (4, 8)] == ["ValueError: not valid JSON"] * 2
    assert [(got[i].status, got[i].n_blocks) for i in (5, 7)] == [("completed", 0)] * 2


def test_texts_instead_of_bytes_and_a_callers_own_reader(spark):
    class Shout(CV.Converter):
        def convert(self, content):
            return [("paragraph", 0, content.upper())]

    docs = spark.createDataFrame([(1, "a.csv", "x,y"), (2, "a.xml", "<a>t<b/>u</a>"), (3, "a.txt", "PK plain")], "doc_id long, file_name string, content string")
    got = {r.doc_id: r for r in D.convert_documents(docs).collect()}
    assert [got[i].markdown for i in (1, 2, 3)] == ["| x | y |\n| --- | --- |", "t\n\nu", "PK plain"]
    own = {r.doc_id: r for r in D.convert_documents(docs, {"csv": Shout()}).collect()}
    assert own[1].markdown == "X,Y"


def test_office_and_xml_edges(spark):
    def p(t):
        return f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"

    nested = f"<w:tbl><w:tr><w:tc>{p('a')}<w:tbl><w:tr><w:tc>{p('in')}</w:tc></w:tr></w:tbl>{p('b|c')}</w:tc><w:tc>{p('')}</w:tc></w:tr></w:tbl>"
    twice = f"<w:p><AlternateContent><Choice><w:t>once</w:t></Choice><Fallback><w:t>never</w:t></Fallback></AlternateContent></w:p>"
    docx = _zip({"word/document.xml": f"<w:document {NS}><w:body>{nested}{twice}{p('end')}</w:body></w:document>"})
    rich = _zip({"xl/workbook.xml": f'<workbook {NS}><sheets><sheet name="S" r:id="r0"/></sheets></workbook>',
                 "xl/_rels/workbook.xml.rels": RF._relations(["worksheets/sheet1.xml"]),
                 "xl/sharedStrings.xml": "<sst><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si></sst>",
                 "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="AA1" t="s"><v>0</v></c></row><row/>'
                                             '<row><c><v>1.5</v></c><c t="b"><v>1</v></c><c><f>A1</f><v>3</v></c></row></sheetData></worksheet>'})
    files = [(1, "a.docx", docx), (2, "b.xlsx", rich), (3, "c.docx", _zip({"x.txt": "word/document.xml"})), (4, "d.xml", b"<a><b></a>"), (5, "e.xml", b""),
             (6, "f.xml", None), (7, "g.pdf", docx), (8, "misnamed.txt", docx), (9, None, docx), (10, "h.docx", None)]
    got = _outcomes(spark, files)
    assert got[1].markdown == "| a in b\\|c |  |\n| --- | --- |\n\nonce\n\nend"
    head = "| " + " | ".join([""] * 26 + ["rich"]) + " |"
    assert got[2].markdown.split("\n") == ["## S", "", head, "| " + " | ".join(["---"] * 27) + " |", "| 1.5 | TRUE | 3 |"]
    assert got[3].error_message == "ValueError: no Office document in the zip file"
    assert got[4].error_message.startswith("ParseError")
    assert [(got[i].status, got[i].n_blocks) for i in (5, 6, 10)] == [("completed", 0)] * 3
    assert got[7].error_message == "No converter for route page_image" and got[8].markdown == got[1].markdown
    sniffed = {r.doc_id: r.f for r in spark.createDataFrame(
        files + [(11, "", _zip({"word/document.xml": "<a/>"}, b"a comment")), (12, "", b"PK\x03\x04"), (13, "", _zip({"ppt/presentation.xml": "<a/>", "pad": "x" * 200_000}))],
        "doc_id long, file_name string, content binary").select("doc_id", FM.sniff_office("content").alias("f")).collect()}
    assert [sniffed[i] for i in (1, 2, 3, 4, 5, 11, 12, 13)] == ["docx", "xlsx", "zip", "unsupported", "unsupported", "docx", "zip", "pptx"]


def test_a_part_that_unpacks_to_too_much_fails_its_document(spark, monkeypatch):
    monkeypatch.setattr(FM, "MAX_PART_BYTES", 10)
    try:
        FM.OfficeConverter().convert(_zip({"word/document.xml": "<a>" + "x" * 100 + "</a>"}))
        raise AssertionError("read")
    except ValueError as e:
        assert "unpacks to more than 10 bytes" in str(e)


def test_blocks_of_unreadable_and_empty_files(spark):
    schema = "doc_id long, file_name string, content binary"
    files = spark.createDataFrame([(1, "a.json", b"{"), (1, "b.txt", b"\xff"), (None, "c.xml", b"<a>x</a>"), (2, "d.png", b"x")], schema)
    got = sorted([(r.doc_id or 0, r.block_idx, r.type, r.text[:20]) for r in D.documents_to_blocks(files).collect()])
    assert got == [(0, 0, "paragraph", "x"), (1, -1, "error", "UnicodeDecodeError: "), (1, -1, "error", "ValueError: not vali"),
                   (2, -1, "error", "No converter for rou")]
    empty = spark.createDataFrame([], schema)
    assert D.documents_to_blocks(empty).count() == 0 and D.convert_documents(empty).count() == 0


def test_middle_json_edges(spark):
    docs = spark.createDataFrame([
        (1, '{"pages":[{"page_idx":0,"blocks":[{"block_idx":0,"type":"paragraph","text":"a\\"b"},{"block_idx":"x"}]},{"page_idx":1}]}'),
        (2, '{"pages":'), (3, None), (4, "{}"), (5, '{"pages":[]}'), (6, '{"pages":7}')], "doc_id long, middle_json string")
    got = sorted((tuple(r) for r in D.read_middle_json(docs).collect()), key=repr)
    assert got == sorted([(1, 0, 0, "paragraph", 'a"b', False), (1, 0, None, None, None, False), (1, 1, None, None, None, False),
                          (2, None, None, None, None, True), (3, None, None, None, None, False), (4, None, None, None, None, False),
                          (5, None, None, None, None, False), (6, None, None, None, None, False)], key=repr)


def test_blocks_of_table_equals_p1_and_keeps_going(spark):
    register_explode_blocks(spark)
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    pages.select(F.lit("clash").alias("type"), "html", F.col("page_id").alias("doc_id"), F.col("html").alias("content"), F.lit(1).alias("text")).createOrReplaceTempView("t_pages")
    key = lambda r: (r.doc_id, r.block_idx, r.type, r.level, r.text)
    assert sorted(map(key, spark.sql("SELECT * FROM blocks_of_table(TABLE(t_pages))").collect())) == sorted(map(key, D.html_to_blocks(pages).collect()))
    spark.createDataFrame([(1, None), (2, bytearray(b"\xff")), (3, bytearray(b"<p>x</p>")), (None, bytearray(b""))], "doc_id long, content binary").createOrReplaceTempView("t_odd")
    got = [(r.doc_id, r.block_idx, r.type) for r in spark.sql("SELECT * FROM blocks_of_table(TABLE(t_odd)) ORDER BY doc_id").collect()]
    assert got == [(2, -1, "error"), (3, 0, "paragraph")]
