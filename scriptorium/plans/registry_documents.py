"""Registered document / artifact queries (A2, A5, A10, B4-B6, F*, J1, J4, P1-P8, S1, S2, W1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import converters as CV
from ..operators import documents as D
from ..session import load, scratch_path
from ..sources.files import scan_documents
from ..sources.objects import upload_objects
from . import fixtures as fx
from .catalog import register

PAGE_OFFSET = 1_000_000_000_000  # pages and documents share one id space in docs_in


# ------------------------------------------------------------------ inputs

def docs_in(spark, sf) -> DataFrame:
    """Documents to convert: every page as ``.html`` and every document under a name whose suffix
    follows the ledger fixture's rule, so all routes occur."""
    p = load(spark, sf, "pages").select(
        (F.col("page_id") + PAGE_OFFSET).alias("doc_id"),
        F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit(".html")).alias("file_name"),
        F.col("html").alias("content"))
    d = load(spark, sf, "documents")
    suffixes = F.array(*[F.lit(s) for s in (".pdf", ".PNG", ".docx", ".html", ".tar.gz", "", ".jpeg", ".txt")])
    d = d.select(
        "doc_id",
        F.concat(F.lit("doc"), F.col("doc_id").cast("string"),
                 F.element_at(suffixes, (F.col("doc_id") % 8 + 1).cast("int"))).alias("file_name"),
        F.col("text").alias("content"))
    return p.unionByName(d)


_DOCS_IN_SQL = f"""docs_in AS (
  SELECT page_id + {PAGE_OFFSET} AS doc_id, concat('page', cast(page_id AS varchar), '.html') AS file_name, html AS content FROM pages
  UNION ALL
  SELECT doc_id, concat('doc', cast(doc_id AS varchar),
         CASE doc_id % 8 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PNG' WHEN 2 THEN '.docx' WHEN 3 THEN '.html'
                         WHEN 4 THEN '.tar.gz' WHEN 5 THEN '' WHEN 6 THEN '.jpeg' ELSE '.txt' END), text FROM documents)"""

# suffix of the base name, the same rule as F1
_SUFFIX_SQL = "lower(regexp_extract(regexp_extract({x}, '[^/]*$'), '^.+(\\.[^.]+)$', 1))"


def _suffix(x: str) -> str:
    return _SUFFIX_SQL.format(x=x)


# text blocks: one per non-blank line after trimming spaces, tabs and CR
_LINES_SQL = """lines AS (
  SELECT doc_id, i, regexp_replace(l, '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g') AS line
  FROM (SELECT {id} AS doc_id, unnest(string_split({col}, chr(10))) AS l,
               generate_subscripts(string_split({col}, chr(10)), 1) AS i FROM {src})),
tblocks AS (
  SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS int) AS block_idx, line AS text
  FROM lines WHERE line <> '')"""


def _lines(src="documents", id_="doc_id", col="text") -> str:
    return _LINES_SQL.format(src=src, id=id_, col=col)


# HTML block counts by pattern (head, script, style and nav removed first); in the title the
# legacy named references decode with or without their semicolon, as HTML5 specifies
_HTML_SQL = """hb AS (
  SELECT {id} AS doc_id, {html} AS html,
         regexp_replace(regexp_replace(regexp_replace(regexp_replace({html},
             '<head[^>]*>[\\s\\S]*?</head>', '', 'g'), '<script[^>]*>[\\s\\S]*?</script>', '', 'g'),
             '<style[^>]*>[\\s\\S]*?</style>', '', 'g'), '<nav[^>]*>[\\s\\S]*?</nav>', '', 'g') AS body
  FROM {src}),
hcount AS (
  SELECT doc_id,
         len(regexp_extract_all(body, '<h[1-6][ >]')) AS n_heading,
         len(regexp_extract_all(body, '<p[ >]')) AS n_paragraph,
         len(regexp_extract_all(body, '<li[ >]')) AS n_list_item,
         len(regexp_extract_all(body, '<(div|footer)[ >]'))
           + CASE WHEN NOT contains(html, '<') AND regexp_matches(html, '\\S') THEN 1 ELSE 0 END AS n_text,
         trim(regexp_replace(
           regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
             regexp_replace(regexp_extract(body, '<h1[^>]*>([\\s\\S]*?)</h1>', 1), '<[^>]+>', '', 'g'),
             '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&copy;?', '©', 'g'), '&middot;?', '·', 'g'),
             '&amp;?', '&', 'g'),
           '\\s+', ' ', 'g')) AS title
  FROM hb)"""


def _html(src="pages", id_="page_id", html="html") -> str:
    return _HTML_SQL.format(src=src, id=id_, html=html)


# ------------------------------------------------------------------ P1-P8

@register("P1_html_to_blocks", f"""
WITH {_html()}
SELECT doc_id AS page_id, cast(n_heading + n_paragraph + n_list_item + n_text AS bigint) AS n_blocks,
       cast(n_heading AS bigint) AS n_heading, cast(n_paragraph AS bigint) AS n_paragraph,
       cast(n_list_item AS bigint) AS n_list_item, cast(n_text AS bigint) AS n_text,
       nullif(title, '') AS title
FROM hcount""")
def p1(spark, sf):
    pages = load(spark, sf, "pages")
    b = D.html_to_blocks(pages)
    t = F.col("type")
    agg = b.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_blocks"),
        F.count_if(t == "heading").alias("n_heading"),
        F.count_if(t == "paragraph").alias("n_paragraph"),
        F.count_if(t == "list_item").alias("n_list_item"),
        F.count_if(t == "text").alias("n_text"),
        F.min(F.when(F.col("type") == "heading", F.struct("block_idx", "text")))["text"].alias("title"),
    )
    out = pages.select("page_id").join(agg.withColumnRenamed("doc_id", "page_id"), "page_id", "left")
    return out.select("page_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in
                                   ("n_blocks", "n_heading", "n_paragraph", "n_list_item", "n_text")], "title")


def _doc_blocks(spark, sf):
    return D.to_blocks(load(spark, sf, "documents"), "doc_id", "text", "text")


_MD_LINE_SQL = """CASE WHEN regexp_matches(text, '^#{1,6} +') THEN regexp_replace(text, '^(#{1,6}) +', '\\1 ')
            WHEN starts_with(text, '- ') OR starts_with(text, '* ') THEN '- ' || substr(text, 3)
            ELSE text END"""


@register("P2_blocks_to_markdown", f"""
WITH {_lines()}
SELECT doc_id, string_agg({_MD_LINE_SQL}, chr(10) || chr(10) ORDER BY block_idx) AS markdown
FROM tblocks GROUP BY doc_id""")
def p2(spark, sf):
    return D.blocks_to_markdown(_doc_blocks(spark, sf))


@register("P3_content_list", f"""
WITH {_lines()}
SELECT doc_id, cast(count(*) AS int) AS n_blocks, md5(string_agg(text, chr(1) ORDER BY block_idx)) AS text_md5
FROM tblocks GROUP BY doc_id""")
def p3(spark, sf):
    cl = D.content_list(_doc_blocks(spark, sf))
    return cl.select("doc_id", "n_blocks",
                     F.md5(F.array_join(F.transform("content_list", lambda b: b["text"]), "\u0001")).alias("text_md5"))


@register("P4_middle_json", f"""
WITH {_lines()}
SELECT doc_id, cast(max(block_idx) // 20 + 1 AS int) AS n_pages, cast(count(*) AS int) AS n_blocks, true AS valid_json
FROM tblocks GROUP BY doc_id""")
def p4(spark, sf):
    m = D.middle_json(_doc_blocks(spark, sf), page_size=20)
    # the JSON text is engine-formatted: check its structure (pages, blocks) and that it parses
    parsed = F.from_json("middle_json", "doc_id long, pages array<struct<page_idx int, blocks array<struct<block_idx int>>>>")
    return m.select("doc_id", "n_pages",
                    F.aggregate(parsed["pages"], F.lit(0), lambda acc, p: acc + F.size(p["blocks"])).alias("n_blocks"),
                    (parsed.isNotNull() & (parsed["doc_id"] == F.col("doc_id"))).alias("valid_json"))


def _slice_params(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "lang")
    lang = F.col("lang")
    return d.filter(lang != "es").select(
        "doc_id",
        F.when(lang == "de", 1).otherwise(0).alias("start_page_id"),
        F.when(lang == "en", F.lit(0)).when(lang == "fr", F.lit(1)).alias("end_page_id"))


@register("P5_slice_pages", f"""
WITH {_lines()},
params AS (SELECT doc_id, CASE WHEN lang = 'de' THEN 1 ELSE 0 END AS start_page_id,
                  CASE WHEN lang = 'en' THEN 0 WHEN lang = 'fr' THEN 1 END AS end_page_id
           FROM documents WHERE lang <> 'es'),
paged AS (SELECT doc_id, block_idx, cast(block_idx // 5 AS int) AS page_idx FROM tblocks)
SELECT p.doc_id, p.block_idx, p.page_idx FROM paged p LEFT JOIN params q ON p.doc_id = q.doc_id
WHERE p.page_idx >= coalesce(q.start_page_id, 0) AND (q.end_page_id IS NULL OR p.page_idx <= q.end_page_id)""")
def p5(spark, sf):
    blocks = D.with_pages(_doc_blocks(spark, sf), page_size=5)
    return D.slice_pages(blocks, _slice_params(spark, sf)).select("doc_id", "block_idx", "page_idx")


def _md_blocks(spark, sf):
    return D.to_blocks(fx.md_docs(spark, sf), "doc_id", "md", "markdown")


@register("P6_element_toggles", """
WITH pieces AS (
  SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i
  FROM (SELECT doc_id, list_filter(list_transform(string_split(
                 regexp_replace(md, '(!\\[[^\\]]*\\]\\([^)]+\\)|\\$\\$.+?\\$\\$)', chr(1) || '\\1' || chr(1), 'g'), chr(1)),
                 lambda x: trim(x)), lambda x: x <> '') AS ps FROM md_docs)),
opts AS (SELECT page_id AS doc_id, starts_with(url, 'https') AS formula_enable FROM pages),
lines AS (
  SELECT p.doc_id, p.i, CASE WHEN starts_with(piece, '![') THEN regexp_replace(piece, '!\\[[^\\]]*\\]', '![]') ELSE piece END AS line
  FROM pieces p JOIN opts o ON p.doc_id = o.doc_id
  WHERE o.formula_enable OR NOT starts_with(piece, '$$'))
SELECT doc_id, cast(count(*) AS bigint) AS n_blocks, string_agg(line, chr(10) || chr(10) ORDER BY i) AS markdown
FROM lines GROUP BY doc_id""", ("md_docs",))
def p6(spark, sf):
    opts = load(spark, sf, "pages").select(F.col("page_id").alias("doc_id"),
                                           F.col("url").startswith("https").alias("formula_enable"),
                                           F.lit(True).alias("table_enable"))
    kept = D.element_toggles(_md_blocks(spark, sf), opts)
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_blocks")).join(D.blocks_to_markdown(kept), "doc_id")


_P7_SQL = f"""
WITH {_DOCS_IN_SQL},
{_html('docs_in', 'doc_id', 'content')},
{_lines('docs_in', 'doc_id', 'content')},
routed AS (
  SELECT doc_id, content, {_suffix('file_name')} AS suf,
         CASE WHEN {_suffix('file_name')} IN ('.pdf', '.png', '.jpg', '.jpeg', '.bmp', '.tiff', '.tif', '.webp')
              THEN 'page_image' ELSE 'text_like' END AS route
  FROM docs_in),
conv AS (
  SELECT doc_id, route, CASE WHEN route = 'page_image' THEN NULL WHEN suf IN ('.html', '.htm') THEN 'html'
                             WHEN suf IN ('.md', '.markdown') THEN 'markdown' ELSE 'text' END AS converter
  FROM routed),
tcount AS (SELECT doc_id, count(*) AS n FROM tblocks GROUP BY doc_id)
SELECT c.doc_id, c.route, c.converter,
       CASE WHEN c.converter IS NULL THEN 'failed' ELSE 'completed' END AS status,
       cast(CASE WHEN c.converter = 'html' THEN h.n_heading + h.n_paragraph + h.n_list_item + h.n_text
                 WHEN c.converter = 'text' THEN coalesce(t.n, 0) END AS int) AS n_blocks,
       CASE WHEN c.converter IS NULL THEN 'No converter for route ' || c.route END AS error_message
FROM conv c LEFT JOIN hcount h ON c.doc_id = h.doc_id LEFT JOIN tcount t ON c.doc_id = t.doc_id"""


@register("P7_convert_documents", _P7_SQL)
def p7(spark, sf):
    return D.convert_documents(docs_in(spark, sf)).drop("markdown")


def _task_files(spark, sf):
    """The uploaded file of each task ``t{k}``: the text of document ``k mod n``, as bytes."""
    d = load(spark, sf, "documents")
    num = F.substring("task_id", 2, 1 << 20).cast("bigint")
    t = fx.tasks(spark, sf).select("task_id", (num % d.agg(F.count(F.lit(1))).scalar()).alias("doc_id"))
    return t.join(d.select("doc_id", F.encode("text", "UTF-8").alias("content")), "doc_id").select("task_id", "content")


_CONVERTED_SQL = f"""conv AS (
  SELECT t.task_id, c.n_blocks, c.md,
         {_suffix('t.file_name')} IN ('.pdf', '.png', '.jpg', '.jpeg', '.bmp', '.tiff', '.tif', '.webp') AS image
  FROM tasks t JOIN (SELECT doc_id, count(*) AS n_blocks,
                            string_agg(CASE type WHEN 'heading' THEN repeat('#', level) || ' ' || text WHEN 'list_item' THEN '- ' || text
                              WHEN 'equation' THEN '$$' || text || '$$' ELSE text END, chr(10) || chr(10) ORDER BY block_idx) AS md
                     FROM (SELECT d.doc_id, b.block_idx, b.type, b.level, b.text FROM documents d LEFT JOIN doc_blocks b ON d.doc_id = b.doc_id)
                     GROUP BY doc_id) c
    ON cast(substr(t.task_id, 2) AS bigint) % (SELECT count(*) FROM documents) = c.doc_id
  WHERE t.status = 'processing')"""


def _convert_tasks(spark, sf):
    # every text file goes through the plain-text converter here; P7 covers the choice by suffix
    return D.convert_tasks(fx.tasks(spark, sf), _task_files(spark, sf), fx.AS_OF, "/results", {"html": "text"})


@register("P7b_results", f"""
WITH {_CONVERTED_SQL}
SELECT task_id, CASE WHEN image THEN 'failed' ELSE 'completed' END AS status,
       CASE WHEN NOT image THEN '/results/' || task_id END AS result_path,
       CASE WHEN image THEN 'No converter for route page_image' END AS error_message,
       CASE WHEN NOT image THEN cast(n_blocks AS int) END AS n_blocks, CASE WHEN NOT image THEN md5(md) END AS markdown_md5
FROM conv""", ("tasks", "doc_blocks"))
def p7b_results(spark, sf):
    results, _ = _convert_tasks(spark, sf)
    return results.select("task_id", "status", "result_path", "error_message", "n_blocks", F.md5("markdown").alias("markdown_md5"))


@register("P7c_ledger", f"""
WITH {_CONVERTED_SQL}
SELECT t.task_id, CASE WHEN c.image IS NULL THEN t.status WHEN c.image THEN 'failed' ELSE 'completed' END AS status,
       CASE WHEN NOT c.image THEN '/results/' || t.task_id ELSE t.result_path END AS result_path,
       CASE WHEN c.image THEN 'No converter for route page_image' ELSE t.error_message END AS error_message,
       CASE WHEN c.image IS NULL THEN t.completed_at ELSE TIMESTAMP '1998-06-01 00:00:00' END AS completed_at,
       t.worker_id, t.retry_count
FROM tasks t LEFT JOIN conv c ON t.task_id = c.task_id""", ("tasks", "doc_blocks"))
def p7c_ledger(spark, sf):
    _, ledger = _convert_tasks(spark, sf)
    return ledger.select("task_id", "status", "result_path", "error_message", "completed_at", "worker_id", "retry_count")


@register("P8_images_map", """
WITH img AS (SELECT task_id, regexp_extract(path, '[^/]*$') AS k, 'data:image/jpeg;base64,' || base64(content) AS v
             FROM result_files WHERE regexp_matches(path, '/images/[^/]*\\.jpg$'))
SELECT task_id, cast(count(*) AS int) AS n_images, string_agg(k, ',' ORDER BY k) AS names,
       md5(string_agg(v, '|' ORDER BY k)) AS uri_md5
FROM img GROUP BY task_id""", ("result_files",))
def p8(spark, sf):
    m = D.images_map(fx.result_files(spark, sf))
    keys = F.array_sort(F.map_keys("images"))
    return m.select("task_id", F.size("images").alias("n_images"), F.array_join(keys, ",").alias("names"),
                    F.md5(F.array_join(F.transform(keys, lambda k: F.element_at("images", k)), "|")).alias("uri_md5"))


# ------------------------------------------------------------------ S1, S2

@register("S1_route_and_union", f"""
WITH {_DOCS_IN_SQL},
{_lines('docs_in', 'doc_id', 'content')},
d AS (SELECT doc_id, CASE WHEN {_suffix('file_name')} IN ('.pdf', '.png', '.jpg', '.jpeg', '.bmp', '.tiff', '.tif', '.webp')
                     THEN 'page_image' ELSE 'text_like' END AS route FROM docs_in),
tcount AS (SELECT doc_id, count(*) AS n FROM tblocks GROUP BY doc_id)
SELECT d.doc_id, d.route, CASE WHEN d.route = 'text_like' THEN 'text' END AS converter,
       CASE WHEN d.route = 'text_like' THEN 'completed' ELSE 'failed' END AS status,
       cast(CASE WHEN d.route = 'text_like' THEN coalesce(t.n, 0) END AS int) AS n_blocks,
       CASE WHEN d.route = 'page_image' THEN 'No converter for route page_image' END AS error_message
FROM d LEFT JOIN tcount t ON d.doc_id = t.doc_id""")
def s1(spark, sf):
    docs = docs_in(spark, sf)
    return D.route_and_union(docs, {"text_like": "text", "page_image": None})


class StrictText(CV.TextConverter):
    """Plain text that refuses every text whose length is divisible by 13."""

    name = "strict"

    def convert(self, content):
        if len(content or "") % 13 == 0:
            raise ValueError("refused")
        return super().convert(content)


@register("S1b_repeated_and_raising", f"""
WITH {_DOCS_IN_SQL},
{_lines('docs_in', 'doc_id', 'content')},
d AS (SELECT *, {_suffix('file_name')} IN ('.pdf', '.png', '.jpg', '.jpeg', '.bmp', '.tiff', '.tif', '.webp') AS page,
             length(content) % 13 = 0 AS raises FROM docs_in),
tcount AS (SELECT doc_id, count(*) AS n FROM tblocks GROUP BY doc_id)
SELECT CASE WHEN d.doc_id % 7 <> 0 THEN d.doc_id // 2 END AS doc_id, d.file_name IS NOT NULL AND page AS on_page_route,
       CASE WHEN page OR raises THEN 'failed' ELSE 'completed' END AS status,
       cast(CASE WHEN NOT page AND NOT raises THEN coalesce(t.n, 0) END AS int) AS n_blocks,
       CASE WHEN page THEN 'No converter for route page_image' WHEN raises THEN 'ValueError: refused' END AS error_message
FROM d LEFT JOIN tcount t ON d.doc_id = t.doc_id""")
def s1b(spark, sf):
    """S1 where ids are NULL or repeat and converters raise: one outcome for every row."""
    docs = docs_in(spark, sf).withColumn("doc_id", F.when(F.col("doc_id") % 7 != 0, F.floor(F.col("doc_id") / 2)))
    out = D.route_and_union(docs, {"text_like": StrictText, "page_image": None})
    return out.select("doc_id", (F.col("route") == "page_image").alias("on_page_route"), "status", "n_blocks", "error_message")


@register("S2_split_outcomes", f"""
WITH {_DOCS_IN_SQL}
SELECT doc_id, 'page_image' AS route, 'No converter for route page_image' AS error_message FROM docs_in
WHERE {_suffix('file_name')} IN ('.pdf', '.png', '.jpg', '.jpeg', '.bmp', '.tiff', '.tif', '.webp')""")
def s2(spark, sf):
    outcomes = D.convert_documents(docs_in(spark, sf)).drop("markdown")
    _, dead = D.split_outcomes(outcomes)
    return dead.select("doc_id", "route", "error_message")


# ------------------------------------------------------------------ artifacts

@register("W1_first_artifact", """
SELECT task_id, kind, arg_min(path, path) AS path, arg_min(size, path) AS size FROM artifacts
WHERE NOT (kind = 'md' AND regexp_matches(regexp_extract(regexp_extract(path, '[^/]*$'), '^(.+?)(\\.[^.]+)?$', 1), '_(layout|span|origin)$'))
GROUP BY task_id, kind""", ("artifacts",))
def w1(spark, sf):
    return D.first_artifact(fx.artifacts(spark, sf))


@register("J1_tasks_with_artifacts", """
SELECT t.task_id, t.status, a.kind, a.path FROM tasks t LEFT JOIN artifacts a ON t.task_id = a.task_id""",
          ("tasks", "artifacts"))
def j1(spark, sf):
    t = fx.tasks(spark, sf)
    return D.tasks_with_artifacts(t.select("task_id", "status"), fx.artifacts(spark, sf, t).select("task_id", "kind", "path"))


_IMG_SQL = f"""img AS (SELECT task_id, path, size FROM artifacts
         WHERE {_suffix('path')} IN ('.png', '.jpg', '.jpeg', '.gif', '.bmp', '.webp', '.svg') AND contains(path, '/images/'))"""


@register("A5_image_inventory", f"""
WITH {_IMG_SQL},
per AS (SELECT task_id, count(*) AS image_count, string_agg(path, ',' ORDER BY path) AS image_paths FROM img GROUP BY task_id)
SELECT t.task_id, coalesce(p.image_count, 0) AS image_count, p.image_paths FROM tasks t LEFT JOIN per p ON t.task_id = p.task_id""",
          ("tasks", "artifacts"))
def a5(spark, sf):
    t = fx.tasks(spark, sf)
    inv = D.image_inventory(t, fx.artifacts(spark, sf, t))
    return inv.select("task_id", "image_count",
                      F.array_join(F.transform("images", lambda i: i["path"]), ",").alias("image_paths"))


@register("A5b_image_base64", f"""
WITH img AS (SELECT task_id, path, base64(content) AS b64 FROM result_files
             WHERE {_suffix('path')} IN ('.png', '.jpg', '.jpeg', '.gif', '.bmp', '.webp', '.svg') AND contains(path, '/images/'))
SELECT t.task_id, count(i.path) AS image_count, md5(string_agg(i.b64, '|' ORDER BY i.path)) AS base64_md5
FROM tasks t LEFT JOIN img i ON t.task_id = i.task_id GROUP BY t.task_id""", ("tasks", "result_files"))
def a5b(spark, sf):
    inv = D.image_inventory(fx.tasks(spark, sf), fx.result_files(spark, sf), include_base64=True)
    return inv.select("task_id", "image_count",
                      F.md5(F.array_join(F.transform("images", lambda i: i["base64"]), "|")).alias("base64_md5"))


ENDPOINT, BUCKET = "objects.local:9000", "doc-images"


@register("A10_upload_objects", f"""
WITH {_IMG_SQL}
SELECT task_id, path,
       'images/' || sha256(task_id || '/' || regexp_extract(path, '[^/]*$')) || {_suffix('path')} AS object_name,
       'http://{ENDPOINT}/{BUCKET}/images/' || sha256(task_id || '/' || regexp_extract(path, '[^/]*$')) || {_suffix('path')} AS url
FROM img""", ("artifacts",))
def a10(spark, sf):
    a = fx.artifacts(spark, sf)
    img = a.filter(C.file_suffix("path").isin(C.IMAGE_EXTENSIONS) & F.col("path").contains("/images/"))
    return D.plan_object_urls(img.select("task_id", "path"), ENDPOINT, BUCKET)


@register("A2_scan_artifacts", f"""
SELECT task_id, path,
  CASE WHEN contains(path, '/images/') AND {_suffix('path')} IN ('.png', '.jpg', '.jpeg', '.gif', '.bmp', '.webp', '.svg') THEN 'image'
       WHEN regexp_matches(regexp_extract(path, '[^/]*$'), '_content_list\\.json$') THEN 'content_list'
       WHEN regexp_matches(regexp_extract(path, '[^/]*$'), '_middle\\.json$') THEN 'middle_json'
       WHEN regexp_matches(regexp_extract(path, '[^/]*$'), '_model\\.json$') THEN 'model_output'
       WHEN regexp_matches(regexp_extract(path, '[^/]*$'), '(_|^)layout\\.pdf$') THEN 'layout_pdf'
       WHEN regexp_matches(regexp_extract(path, '[^/]*$'), '(_|^)span\\.pdf$') THEN 'span_pdf'
       WHEN regexp_matches(regexp_extract(path, '[^/]*$'), '(_|^)origin\\.pdf$') THEN 'origin_pdf'
       WHEN regexp_matches(regexp_extract(path, '[^/]*$'), '\\.md$') THEN 'md'
       ELSE 'other' END AS kind
FROM artifacts""", ("artifacts",))
def a2(spark, sf):
    listing = fx.artifacts(spark, sf).select("task_id", "path")
    return listing.select("task_id", "path", D.classify_artifact(F.col("path")).alias("kind"))


@register("B4_task_status_view", """
WITH md AS (SELECT task_id, regexp_extract(min(path), '[^/]*$') AS markdown_file, arg_min(content, path) AS content
            FROM result_files WHERE kind = 'md' GROUP BY task_id),
im AS (SELECT DISTINCT task_id FROM result_files WHERE kind = 'image'),
j AS (SELECT t.*, md.markdown_file, md.content, im.task_id IS NOT NULL AS has_images,
             t.status = 'completed' AND t.result_path IS NOT NULL AND md.markdown_file IS NOT NULL AS ok
      FROM tasks t LEFT JOIN md ON t.task_id = md.task_id LEFT JOIN im ON t.task_id = im.task_id)
SELECT task_id, status, file_name, backend, priority, error_message, result_path, created_at, started_at, completed_at,
       worker_id, retry_count, CASE WHEN ok THEN markdown_file END AS data_markdown_file,
       CASE WHEN ok THEN decode(content) END AS data_content, CASE WHEN ok THEN false END AS data_images_uploaded,
       CASE WHEN ok THEN has_images END AS data_has_images,
       CASE WHEN status = 'completed' AND result_path IS NULL
            THEN 'Task completed but result files have been cleaned up (older than retention period)' END AS message
FROM j""", ("tasks", "result_files"))
def b4(spark, sf):
    return D.task_status_view(fx.tasks(spark, sf), fx.result_files(spark, sf))


_B5_KINDS = ["md", "content_list", "middle_json", "model_output"]


def _b5_sql() -> str:
    firsts, cols = [], []
    for k in _B5_KINDS:
        cond = f"kind = '{k}'"
        if k == "md":
            cond += " AND NOT regexp_matches(regexp_extract(path, '[^/]*$'), '_(layout|span|origin)\\.md$')"
        firsts += [(f"decode(arg_min({e}, path) FILTER (WHERE {cond}))" if n == "content" else
                    f"arg_min({e}, path) FILTER (WHERE {cond})") + f" AS {k}_{n}" for n, e in (
            ("file", "regexp_extract(path, '[^/]*$')"), ("size", "size"), ("modified_at", "modified_at"), ("content", "content"))]
        there = "ok" if k == "md" else f"ok AND json_valid({k}_content)"
        cols += [f"CASE WHEN {there} THEN {k}_{n} END AS {k}_{n}" for n in ("content", "file", "size", "modified_at")]
    return f"""
WITH f AS (SELECT task_id, {', '.join(firsts)},
                  count(*) FILTER (WHERE {_suffix('path')} IN ('.png', '.jpg', '.jpeg', '.gif', '.bmp', '.webp', '.svg')
                                   AND contains(path, '/images/')) AS n_images,
                  string_agg(path || ' ' || size, ',' ORDER BY path)
                    FILTER (WHERE {_suffix('path')} IN ('.png', '.jpg', '.jpeg', '.gif', '.bmp', '.webp', '.svg')
                            AND contains(path, '/images/')) AS image_list
           FROM result_files GROUP BY task_id),
b AS (SELECT t.task_id, t.status, t.result_path, f.task_id IS NOT NULL AS has_files, f.* EXCLUDE (task_id),
             t.status = 'completed' AND t.result_path IS NOT NULL AND f.task_id IS NOT NULL AS ok
      FROM tasks t LEFT JOIN f ON t.task_id = f.task_id)
SELECT task_id, status,
       CASE WHEN status <> 'completed' THEN 'Task is in ' || status || ' status, data not available yet'
            WHEN result_path IS NULL THEN 'Task completed but result files have been cleaned up (older than retention period)'
            WHEN NOT has_files THEN 'Result directory does not exist' END AS message,
       {', '.join(cols)}, CASE WHEN ok THEN n_images END AS images_count, CASE WHEN ok THEN image_list END AS image_list
FROM b"""


@register("B5_project_fields", _b5_sql(), ("tasks", "result_files"))
def b5(spark, sf):
    out = D.project_fields(fx.tasks(spark, sf), fx.result_files(spark, sf), D.DEFAULT_FIELDS, include_metadata=True)
    listed = F.array_join(F.transform("images", lambda i: F.concat(i["path"], F.lit(" "), i["size"].cast("string"))), ",")
    return out.withColumn("image_list", listed).drop("images")


@register("B6_response_flags", """
SELECT d.doc_id, d.text AS markdown,
       CASE WHEN coalesce(l.quality = 1, false) THEN json_object('n_chars', d.n_chars)::varchar END AS layout,
       CASE WHEN coalesce(l.toxic = 0, false) THEN json_object('lang', d.lang, 'source', d.source)::varchar END AS info,
       CASE WHEN coalesce(l.quality = 1 AND l.toxic = 0, false) THEN json_object('n_chars', d.n_chars)::varchar END AS content_list,
       CASE WHEN coalesce(l.toxic = 1, false) THEN '[]' END AS images
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def b6(spark, sf):
    d = load(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("markdown"),
        F.to_json(F.struct("n_chars")).alias("content_list_json"),
        F.to_json(F.struct("lang", "source")).alias("info_json"),
        F.lit("[]").alias("images_json"))
    lb = load(spark, sf, "labels")
    flags = lb.select("doc_id", (F.col("quality") == 1).alias("return_layout"), (F.col("toxic") == 0).alias("return_info"),
                      ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("return_content_list"),
                      (F.col("toxic") == 1).alias("return_images"))
    return D.response_flags(d, flags)


# ------------------------------------------------------------------ image references

def _images_for_refs(spark, sf):
    m = fx.md_docs(spark, sf).filter(F.col("image_name").isNotNull())
    return m.select("doc_id", F.col("image_name").alias("name"),
                    C.object_url(ENDPOINT, BUCKET, C.object_name(F.col("doc_id"), F.col("image_name"))).alias("url"))


_IS_IMAGE_SQL = f"{_suffix('path')} IN ('.png', '.jpg', '.jpeg', '.gif', '.bmp', '.webp', '.svg') AND contains(path, '/images/')"


@register("A10b_upload_copies", f"""
SELECT task_id, path, CASE WHEN num % 11 > 0 THEN 'http://{ENDPOINT}/{BUCKET}/' || object_name END AS url,
       CASE WHEN num % 11 = 0 THEN 'ValueError: no content' END AS error,
       CASE WHEN num % 11 > 0 THEN size END AS stored_size, CASE WHEN num % 11 > 0 THEN sha256(content) END AS stored_sha256
FROM (SELECT *, cast(substr(task_id, 2) AS bigint) AS num,
             'images/' || sha256(task_id || '/' || regexp_extract(path, '[^/]*$')) || {_suffix('path')} AS object_name
      FROM result_files WHERE {_IS_IMAGE_SQL})""", ("result_files",))
def a10b(spark, sf):
    """Uploaded for real and read back from where they were copied; every eleventh task's bytes are missing."""
    files = fx.result_files(spark, sf).filter(D.is_image("path"))
    lost = F.substring("task_id", 2, 1 << 20).cast("bigint") % 11 == 0
    files = files.select("task_id", "path", F.when(~lost, F.col("content")).alias("content"))
    root = scratch_path(spark, "objects")
    done = upload_objects(D.plan_object_urls(files, ENDPOINT, BUCKET), root)
    stored = scan_documents(spark, f"{root}/images").select(
        F.concat(F.lit("images/"), "file_name").alias("object_name"), F.col("length").alias("stored_size"), F.sha2("content", 256).alias("stored_sha256"))
    return done.join(stored, "object_name", "left").select("task_id", "path", "url", "error", "stored_size", "stored_sha256")


@register("A5c_inventory_urls", f"""
WITH img AS (SELECT task_id, path, cast(substr(task_id, 2) AS bigint) AS num,
                    'images/' || sha256(task_id || '/' || regexp_extract(path, '[^/]*$')) || {_suffix('path')} AS object_name
             FROM result_files WHERE {_IS_IMAGE_SQL})
SELECT t.task_id, count(i.path) AS image_count,
       string_agg(CASE WHEN num % 11 > 0 THEN 'http://{ENDPOINT}/{BUCKET}/' || object_name WHEN num % 11 = 0 THEN '-' END, '|' ORDER BY i.path) AS urls
FROM tasks t LEFT JOIN img i ON t.task_id = i.task_id GROUP BY t.task_id""", ("tasks", "result_files"))
def a5c(spark, sf):
    """The inventory with the URLs of uploaded images; a failed object keeps its place without one."""
    files = fx.result_files(spark, sf).filter(D.is_image("path"))
    lost = F.substring("task_id", 2, 1 << 20).cast("bigint") % 11 == 0
    files = files.select("task_id", "path", F.when(~lost, F.col("content")).alias("content"))
    done = upload_objects(D.plan_object_urls(files, ENDPOINT, BUCKET), scratch_path(spark, "objects"))
    inv = D.image_inventory(fx.tasks(spark, sf), done, uploaded=True)
    return inv.select("task_id", "image_count", F.array_join(F.transform("images", lambda i: F.coalesce(i["url"], F.lit("-"))), "|").alias("urls"))


_REFS_SQL = """refs AS (
  SELECT doc_id, generate_subscripts(m, 1) - 1 AS ref_idx, unnest(m) AS match, unnest(a) AS alt, unnest(p) AS path
  FROM (SELECT doc_id, regexp_extract_all(md, '!\\[([^\\]]*)\\]\\(([^)]+)\\)', 0) AS m,
               regexp_extract_all(md, '!\\[([^\\]]*)\\]\\(([^)]+)\\)', 1) AS a,
               regexp_extract_all(md, '!\\[([^\\]]*)\\]\\(([^)]+)\\)', 2) AS p FROM md_docs)),
imgs AS (SELECT doc_id, image_name AS name,
                'http://""" + ENDPOINT + "/" + BUCKET + """/images/' || sha256(cast(doc_id AS varchar) || '/' || image_name) ||
                lower(regexp_extract(image_name, '^.+(\\.[^.]+)$', 1)) AS url
         FROM md_docs WHERE image_name IS NOT NULL)"""


@register("J4_resolve_image_refs", f"""
WITH {_REFS_SQL}
SELECT r.doc_id, cast(r.ref_idx AS int) AS ref_idx, r.match, r.alt, r.path, regexp_extract(r.path, '[^/]*$') AS name, i.url
FROM refs r LEFT JOIN imgs i ON r.doc_id = i.doc_id AND regexp_extract(r.path, '[^/]*$') = i.name""", ("md_docs",))
def j4(spark, sf):
    return D.resolve_image_refs(fx.md_docs(spark, sf), _images_for_refs(spark, sf))


@register("F7_extract_image_refs", f"""
WITH {_REFS_SQL}
SELECT doc_id, cast(ref_idx AS int) AS ref_idx, alt, path, regexp_extract(path, '[^/]*$') AS name FROM refs""", ("md_docs",))
def f7(spark, sf):
    m = fx.md_docs(spark, sf)
    return m.select("doc_id", F.posexplode(C.image_refs("md")).alias("ref_idx", "r")).select(
        "doc_id", "ref_idx", "r.alt", "r.path", "r.name")


@register("F8_rewrite_image_refs", f"""
WITH {_REFS_SQL},
res AS (SELECT r.doc_id, r.match, '<img src="' || i.url || '" alt="' || r.alt || '">' AS html
        FROM refs r JOIN imgs i ON r.doc_id = i.doc_id AND regexp_extract(r.path, '[^/]*$') = i.name)
SELECT m.doc_id, coalesce(replace(m.md, res.match, res.html), m.md) AS md_out FROM md_docs m LEFT JOIN res ON m.doc_id = res.doc_id""",
          ("md_docs",))
def f8(spark, sf):
    m = fx.md_docs(spark, sf)
    resolved = D.resolve_image_refs(m, _images_for_refs(spark, sf))
    return D.rewrite_image_refs(m, resolved)


@register("F14_formula_spans", """
SELECT doc_id, array_to_string(regexp_extract_all(md, '\\$\\$(.+?)\\$\\$', 1), '|') AS display,
       array_to_string(regexp_extract_all(regexp_replace(md, '\\$\\$(.+?)\\$\\$', ' ', 'g'), '\\$([^$]+?)\\$', 1), '|') AS inline
FROM md_docs""", ("md_docs",))
def f14(spark, sf):
    m = fx.md_docs(spark, sf)
    s = C.formula_spans("md")
    return m.select("doc_id", F.array_join(s["display"], "|").alias("display"), F.array_join(s["inline"], "|").alias("inline"))
