"""Registered scalar-function queries (F1-F6, F9-F13, F15, F16) over the ledger and text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import ledger as L
from ..session import load
from . import fixtures as fx
from .oracle import AS_OF_SQL
from .catalog import register
from .registry_documents import BUCKET, ENDPOINT, _suffix

_NAME = "file_name"


@register("F1_file_suffix", f"SELECT task_id, {_suffix('file_name')} AS suffix FROM tasks", ("tasks",))
def f1(spark, sf):
    return fx.tasks(spark, sf).select("task_id", C.file_suffix(_NAME).alias("suffix"))


@register("F2_file_stem",
          "SELECT task_id, regexp_extract(file_name, '^(.+?)(\\.[^.]+)?$', 1) AS stem FROM tasks", ("tasks",))
def f2(spark, sf):
    return fx.tasks(spark, sf).select("task_id", C.file_stem(_NAME).alias("stem"))


@register("F3_pdf_name_v1", "SELECT task_id, split_part(file_name, '.', 1) || '.pdf' AS pdf_name FROM tasks", ("tasks",))
def f3(spark, sf):
    return fx.tasks(spark, sf).select("task_id", C.pdf_name_v1(_NAME).alias("pdf_name"))


_ROUTE_SQL = (f"CASE WHEN {_suffix('file_name')} IN ('.pdf', '.png', '.jpg', '.jpeg', '.bmp', '.tiff', '.tif', '.webp') "
              "THEN 'page_image' ELSE 'text_like' END")


@register("F4_route_by_suffix", f"SELECT task_id, {_ROUTE_SQL} AS route FROM tasks", ("tasks",))
def f4(spark, sf):
    return fx.tasks(spark, sf).select("task_id", C.route_by_suffix(_NAME).alias("route"))


def task_bytes(spark, sf):
    """Uploaded bytes per task: a leading signature chosen by the declared suffix, then the name."""
    t = fx.tasks(spark, sf)
    suf = C.file_suffix(_NAME)
    magic = (F.when(suf == ".pdf", "255044462D").when(suf == ".png", "89504E470D0A1A0A")
             .when(suf == ".jpeg", "FFD8FFE0").when(suf == ".docx", "504B030414").otherwise(""))
    return t.select("task_id", F.concat(F.unhex(magic), F.encode(_NAME, "UTF-8")).alias("content"))


_BYTES_SQL = f"""b AS (SELECT task_id, unhex(CASE {_suffix('file_name')} WHEN '.pdf' THEN '255044462D' WHEN '.png' THEN '89504E470D0A1A0A'
        WHEN '.jpeg' THEN 'FFD8FFE0' WHEN '.docx' THEN '504B030414' ELSE '' END) || encode(file_name) AS content FROM tasks)"""


@register("F5_sniff_format", f"""
WITH {_BYTES_SQL}, h AS (SELECT task_id, left(hex(content), 16) AS head FROM b)
SELECT task_id, CASE WHEN starts_with(head, '25504446') THEN 'pdf' WHEN starts_with(head, 'FFD8FF') THEN 'jpg'
                     WHEN starts_with(head, '89504E47') THEN 'png' WHEN starts_with(head, 'D0CF11E0') THEN 'ole'
                     WHEN starts_with(head, '504B0304') THEN 'zip' ELSE 'unsupported' END AS format FROM h""", ("tasks",))
def f5(spark, sf):
    return task_bytes(spark, sf).select("task_id", C.sniff_format("content").alias("format"))


@register("F6_b64", """
SELECT task_id, base64(encode(file_name)) AS b64, decode(from_base64(base64(encode(file_name)))) AS round_trip,
       'data:image/jpeg;base64,' || base64(encode(file_name)) AS data_uri FROM tasks""", ("tasks",))
def f6(spark, sf):
    t = fx.tasks(spark, sf).select("task_id", F.encode(_NAME, "UTF-8").alias("raw"))
    b = C.b64_encode("raw")
    return t.select("task_id", b.alias("b64"), F.decode(C.b64_decode(b), "UTF-8").alias("round_trip"),
                    C.data_uri("raw").alias("data_uri"))


@register("F9_split_fields", """
WITH s AS (SELECT doc_id, list_transform(string_split(text, ','), lambda x: regexp_replace(x, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g')) AS f
           FROM documents)
SELECT doc_id, len(f) AS n_fields, md5(array_to_string(f, '|')) AS fields_md5 FROM s""")
def f9(spark, sf):
    d = load(spark, sf, "documents")
    f = C.split_fields("text")
    return d.select("doc_id", F.size(f).cast("long").alias("n_fields"), F.md5(F.array_join(f, "|")).alias("fields_md5"))


@register("F10_cutoff", f"""
SELECT task_id, {AS_OF_SQL} - INTERVAL 7 DAY AS cutoff, completed_at < {AS_OF_SQL} - INTERVAL 7 DAY AS before_cutoff,
       started_at < {AS_OF_SQL} - INTERVAL 60 MINUTE AS started_before FROM tasks""", ("tasks",))
def f10(spark, sf):
    now = fx.ts_lit(fx.AS_OF)
    cut = C.days_before(now, 7)
    return fx.tasks(spark, sf).select("task_id", cut.alias("cutoff"), (F.col("completed_at") < cut).alias("before_cutoff"),
                                      (F.col("started_at") < C.minutes_before(now, 60)).alias("started_before"))


@register("F11_iso_time", """
SELECT event_id, CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
                      ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS iso FROM events""")
def f11(spark, sf):
    return load(spark, sf, "events").select("event_id", C.iso_time("ts").alias("iso"))


_WID = "'^([^-]+)-(.*)-([^-]+)-(\\d+)$'"


@register("F12_worker_id_parts", f"""
SELECT task_id, worker_id,
       CASE WHEN regexp_matches(worker_id, {_WID}) THEN regexp_extract(worker_id, {_WID}, 1) END AS prefix,
       CASE WHEN regexp_matches(worker_id, {_WID}) THEN regexp_extract(worker_id, {_WID}, 2) END AS host,
       CASE WHEN regexp_matches(worker_id, {_WID}) THEN regexp_extract(worker_id, {_WID}, 3) END AS device,
       CASE WHEN regexp_matches(worker_id, {_WID}) THEN regexp_extract(worker_id, {_WID}, 4) END AS pid,
       concat_ws('-', 'wk', 'host-' || cast(retry_count AS varchar), 'cuda:0', cast(1000 + priority AS varchar)) AS composed
FROM tasks""", ("tasks",))
def f12(spark, sf):
    t = fx.tasks(spark, sf)
    p = C.worker_id_parts("worker_id")
    return t.select("task_id", "worker_id", p["prefix"].alias("prefix"), p["host"].alias("host"),
                    p["device"].alias("device"), p["pid"].alias("pid"),
                    C.worker_id(F.lit("wk"), F.concat(F.lit("host-"), F.col("retry_count").cast("string")),
                                F.lit("cuda:0"), F.col("priority") + 1000).alias("composed"))


@register("F13_object_url", f"""
SELECT task_id, path, 'http://{ENDPOINT}/{BUCKET}/' || path AS url FROM artifacts""", ("artifacts",))
def f13(spark, sf):
    a = fx.artifacts(spark, sf)
    return a.select("task_id", "path", C.object_url(ENDPOINT, BUCKET, F.col("path")).alias("url"))


@register("F15_resolve_parse_mode", f"""
WITH o AS (SELECT task_id, coalesce(json_extract_string(options, '$.method'), 'auto') AS method,
                  {_suffix('file_name')} IN ('.png', '.jpg', '.jpeg') AS needs_ocr FROM tasks)
SELECT task_id, CASE WHEN method IN ('ocr', 'txt') THEN method WHEN needs_ocr THEN 'ocr' ELSE 'txt' END AS parse_mode
FROM o""", ("tasks",))
def f15(spark, sf):
    t = L.decode_options(fx.tasks(spark, sf))
    needs = C.file_suffix(_NAME).isin(".png", ".jpg", ".jpeg")
    return t.select("task_id", C.resolve_parse_mode(F.col("method"), needs).alias("parse_mode"))


@register("F16_status_message", """
WITH h AS (SELECT DISTINCT task_id FROM artifacts)
SELECT t.task_id,
       CASE WHEN t.status <> 'completed' THEN 'Task is in ' || t.status || ' status, data not available yet'
            WHEN t.result_path IS NULL THEN 'Task completed but result files have been cleaned up (older than retention period)'
            WHEN h.task_id IS NULL THEN 'Result directory does not exist' END AS message
FROM tasks t LEFT JOIN h ON t.task_id = h.task_id""", ("tasks", "artifacts"))
def f16(spark, sf):
    t = fx.tasks(spark, sf)
    has = fx.artifacts(spark, sf, t).select("task_id").distinct().withColumn("has_files", F.lit(True))
    j = t.join(has, "task_id", "left")
    return j.select("task_id", C.status_message(F.col("status"), F.col("result_path"), F.col("has_files")).alias("message"))
