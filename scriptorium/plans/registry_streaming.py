"""Registered streaming, source/sink and plug-in queries (K1-K3, K6, K8, A1, A3, A4, A6, A8, A9,
W3, X1). Streams run with ``availableNow`` into a sink in the shared folder and are read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import converters as CV
from ..operators import documents as D
from ..operators import ledger as L
from ..session import load, scratch_path
from ..sources import files as SF
from ..sources import stores as ST
from ..sources.objects import upload_objects
from ..streaming import jobs as J
from ..streaming import state as KS
from . import fixtures as fx
from .catalog import register
from .registry import FOLD_SQL
from .registry_documents import _P7_SQL, _html, docs_in

NOW_TOPIC = "2024-01-31 00:00:00"


@register("K1_ingest_stream", _P7_SQL)
def k1(spark, sf):
    docs = docs_in(spark, sf)
    files = max(4, 2 * docs.rdd.getNumPartitions())  # grows with the input (its splits; no job runs), in two micro-batches
    src = J.stage(docs, "docs-in", partitions=files)
    out, ck = scratch_path(spark, "k1-out"), scratch_path(spark, "k1-ckpt")
    J.ingest_stream(spark, src, out, ck, available_now=True, max_files=files // 2)
    return spark.read.parquet(out).drop("markdown", "batch_id")


@register("K2_live_ledger", FOLD_SQL, ("task_events",))
def k2(spark, sf):
    src = J.stage(fx.task_events(spark, sf), "task-events")
    schema = spark.read.parquet(src).schema
    out, ck = scratch_path(spark, "k2-out"), scratch_path(spark, "k2-ckpt")
    stream = J.live_ledger(J.file_stream(spark, src, schema))
    J.run_available_now(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
                        .outputMode("append"))
    return J.final_states(spark.read.parquet(out))


@register("K3_queue_monitor", """
WITH w AS (SELECT time_bucket(INTERVAL 300 SECOND, ts) AS window_start, event_type, count(*) AS count FROM events GROUP BY 1, 2)
SELECT window_start, window_start + INTERVAL 300 SECOND AS window_end, event_type, count FROM w
WHERE window_start + INTERVAL 300 SECOND <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def k3(spark, sf):
    schema = load(spark, sf, "events").schema
    out, ck = scratch_path(spark, "k3-out"), scratch_path(spark, "k3-ckpt")
    stream = J.queue_monitor(J.file_stream(spark, sf, schema, glob="events.parquet"))
    J.run_available_now(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
                        .outputMode("append"))
    return spark.read.parquet(out)


_STATUS_DEPTH_SQL = FOLD_SQL[:FOLD_SQL.index("last AS (")] + """steps AS (
  SELECT f.task_id, f.rn, e.ts, f.status, f.applied, lag(f.status) OVER w AS previous, lag(f.applied) OVER w AS before
  FROM fold f LEFT JOIN ev e ON f.task_id = e.task_id AND f.rn = e.rn WINDOW w AS (PARTITION BY f.task_id ORDER BY f.rn)),
moves AS (SELECT ts, status, 1 AS step FROM steps WHERE applied > before
          UNION ALL SELECT ts, previous, -1 FROM steps WHERE applied > before AND previous IS NOT NULL),
d AS (SELECT time_bucket(INTERVAL 300 SECOND, ts) + INTERVAL 300 SECOND AS window_end, status, sum(step) AS change
      FROM moves GROUP BY 1, 2)
SELECT window_end, status,
       cast(sum(change) OVER (PARTITION BY status ORDER BY window_end ROWS UNBOUNDED PRECEDING) AS bigint) AS depth
FROM d QUALIFY window_end <= (SELECT max(ts) FROM moves) - INTERVAL 10 MINUTE"""


@register("K3b_status_depth", _STATUS_DEPTH_SQL, ("task_events",))
def k3b(spark, sf):
    src = J.stage(fx.task_events(spark, sf), "task-events")
    ledger, out = scratch_path(spark, "k3b-ledger"), scratch_path(spark, "k3b-out")
    jobs = [(J.live_ledger(J.file_stream(spark, src, spark.read.parquet(src).schema)), ledger),
            (lambda: J.status_deltas(J.file_stream(spark, ledger, J.OUTCOME)), out)]
    for stream, path in jobs:
        stream = stream() if callable(stream) else stream
        J.run_available_now(stream.writeStream.format("parquet").option("path", path)
                            .option("checkpointLocation", scratch_path(spark, "k3b-ckpt")).outputMode("append"))
    return J.status_depth(spark.read.parquet(out))


_WAITED_SQL = FOLD_SQL.replace("FROM task_events)", "FROM task_events WHERE ts <= (SELECT max(ts) FROM task_events) - INTERVAL 2 DAY)", 1)


@register("K2b_live_ledger_event_time", _WAITED_SQL, ("task_events",))
def k2b(spark, sf):
    """Four slices in several micro-batches; events with odd ids arrive a day late, within the watermark.
    Covers events up to max(ts) minus the watermark delay of two days: later ones still wait in the state
    when the replay ends."""
    stream = _disordered(spark, sf, lambda events: J.live_ledger(events, order="event_time", watermark="2 days", retain_hours=24 * 30))
    return J.final_states(stream)


def _disordered(spark, sf, job):
    """What ``job`` makes of the task events in four slices over several micro-batches, odd ids a day late."""
    ev = fx.task_events(spark, sf)
    lo, hi = ev.agg(F.min("ts"), F.max("ts")).first()
    step = (hi - lo) / 4
    arrives = F.col("ts") + F.make_dt_interval(days=(F.col("event_id") % 2).cast("int"))
    edge = [F.lit((lo + step * i).isoformat(sep=" ")).cast("timestamp_ntz") for i in (1, 2, 3)]
    cond = [arrives < edge[0], (arrives >= edge[0]) & (arrives < edge[1]), (arrives >= edge[1]) & (arrives < edge[2]), arrives >= edge[2]]
    files = spark.sparkContext.defaultParallelism
    src = J.stage_slices(ev, "task-events", cond, files)
    return _replayed(spark, job(J.file_stream(spark, src, ev.schema, max_files=files)))


def _replayed(spark, stream):
    out, ck = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ckpt")
    J.run_available_now(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode("append"))
    return spark.read.schema(stream.schema).parquet(out)


# events that the watermark of two days has passed when the replay ends (watermarks are whole milliseconds)
_PASSED = "ts < date_trunc('milliseconds', (SELECT max(ts) FROM task_events)) - INTERVAL 2 DAY"
_PASSED_SQL = FOLD_SQL.replace("FROM task_events)", f"FROM task_events WHERE {_PASSED})", 1)
# the same with a reset at started + 60 minutes wherever the next event, or the end, comes later than that
_AUTO_SQL = _PASSED_SQL.replace("FROM fold f JOIN ev e", """FROM (SELECT f.task_id, f.rn, f.started, f.completed,
             CASE WHEN stale THEN 'pending' ELSE f.status END AS status, CASE WHEN stale THEN NULL ELSE f.worker END AS worker,
             f.retries + CASE WHEN stale THEN 1 ELSE 0 END AS retries, f.applied + CASE WHEN stale THEN 1 ELSE 0 END AS applied,
             f.resets + CASE WHEN stale THEN 1 ELSE 0 END AS resets
          FROM (SELECT f.*, coalesce(f.status = 'processing' AND f.started + INTERVAL 60 MINUTE < n.ts, false) AS stale
                FROM fold f JOIN ev n ON n.task_id = f.task_id AND n.rn = f.rn + 1) f) f JOIN ev e""")
_AUTO_SQL = (_AUTO_SQL.replace("CAST(0 AS BIGINT) AS applied\n  FROM ev", "CAST(0 AS BIGINT) AS applied, CAST(0 AS BIGINT) AS resets\n  FROM ev")
             .replace("applied + CASE WHEN ok THEN 1 ELSE 0 END\n  FROM", "applied + CASE WHEN ok THEN 1 ELSE 0 END, resets\n  FROM")
             .replace("f.retries, f.applied,\n           coalesce", "f.retries, f.applied, f.resets,\n           coalesce"))
_AUTO_SQL = _AUTO_SQL[:_AUTO_SQL.index("SELECT task_id, status,\n       CASE WHEN status IN")] + f""",
final AS (SELECT *, coalesce(status = 'processing' AND started + INTERVAL 60 MINUTE <
                             date_trunc('milliseconds', (SELECT max(ts) FROM task_events)) - INTERVAL 2 DAY, false) AS stale FROM last)
SELECT task_id, CASE WHEN stale THEN 'pending' ELSE status END AS status,
       CASE WHEN NOT stale AND status IN ('processing', 'completed', 'failed') THEN worker END AS worker_id, started AS started_at,
       completed AS completed_at, retries + CASE WHEN stale THEN 1 ELSE 0 END AS retry_count,
       applied + CASE WHEN stale THEN 1 ELSE 0 END AS applied, n_events + resets - applied AS rejected,
       resets + CASE WHEN stale THEN 1 ELSE 0 END AS timeout_resets
FROM final"""


@register("K4_stale_timer", _AUTO_SQL, ("task_events",))
def k4(spark, sf):
    """Final states where event-time timers reset stale tasks, out-of-order input over several micro-batches."""
    out = _disordered(spark, sf, lambda events: KS.ordered_ledger(events, auto_reset=True, watermark="2 days"))
    resets = out.groupBy("task_id").agg(F.count_if(F.col("op") == KS.TIMEOUT_RESET).alias("timeout_resets"))
    return J.final_states(out).join(resets, "task_id")


@register("K5_late_completions", _PASSED_SQL[:_PASSED_SQL.index("last AS (")] + """steps AS (
  SELECT f.task_id, e.event_id, e.ts, e.op, f.rn, f.applied, lag(f.status) OVER w AS refused_by, lag(f.applied) OVER w AS before
  FROM fold f LEFT JOIN ev e ON f.task_id = e.task_id AND f.rn = e.rn WINDOW w AS (PARTITION BY f.task_id ORDER BY f.rn))
SELECT event_id, task_id, ts, op, refused_by FROM steps WHERE op IN ('complete', 'fail') AND applied = before""", ("task_events",))
def k5(spark, sf):
    """Completions that the guard refuses, out-of-order input over several micro-batches."""
    return KS.rejected_completions(_disordered(spark, sf, lambda events: KS.ordered_ledger(events, watermark="2 days")))


@register("K8c_silence_starts", """
WITH n AS (SELECT worker_id, ts, lead(ts) OVER (PARTITION BY worker_id ORDER BY ts, event_id) AS nxt FROM task_events)
SELECT worker_id, ts AS silent_from FROM n
WHERE (nxt IS NULL OR nxt - ts > INTERVAL 900 SECOND)
  AND ts + INTERVAL 900 SECOND + INTERVAL 1 MICROSECOND <= date_trunc('milliseconds', (SELECT max(ts) FROM task_events)) - INTERVAL 2 DAY""",
          ("task_events",))
def k8c(spark, sf):
    """The starts of decided silences equal those of the batch form."""
    return _disordered(spark, sf, lambda events: KS.silence_starts(events, watermark="2 days")).select("worker_id", "silent_from")


@register("K8b_heartbeat_windows", """
WITH w AS (SELECT worker_id, time_bucket(INTERVAL 900 SECOND, ts) AS window_start, count(*) AS count
           FROM task_events GROUP BY 1, 2)
SELECT worker_id, window_start, count FROM w
WHERE window_start + INTERVAL 900 SECOND <= (SELECT max(ts) FROM task_events) - INTERVAL 15 MINUTE""", ("task_events",))
def k8b(spark, sf):
    src = J.stage(fx.task_events(spark, sf), "heartbeats")
    out, ck = scratch_path(spark, "k8-out"), scratch_path(spark, "k8-ckpt")
    stream = J.heartbeat_windows(J.file_stream(spark, src, spark.read.parquet(src).schema))
    J.run_available_now(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
                        .outputMode("append"))
    return spark.read.parquet(out)


@register("K7b_wait_deadline_stream", """
WITH s AS (SELECT task_id, min(ts) FILTER (WHERE op = 'submit') AS submitted_at FROM task_events GROUP BY task_id),
t AS (SELECT e.task_id, min(e.ts) AS terminal_at FROM task_events e JOIN s ON e.task_id = s.task_id
      WHERE e.op IN ('complete', 'fail', 'cancel') AND e.ts >= s.submitted_at GROUP BY e.task_id)
SELECT s.task_id, s.submitted_at,
       CASE WHEN coalesce(t.terminal_at - s.submitted_at <= INTERVAL 600 SECOND, false) THEN 'reached' ELSE 'timeout' END AS outcome
FROM s LEFT JOIN t ON s.task_id = t.task_id
WHERE date_trunc('milliseconds', s.submitted_at + INTERVAL 600 SECOND) < date_trunc('milliseconds', (SELECT max(ts) FROM task_events)) - INTERVAL 2 DAY""",
          ("task_events",))
def k7b(spark, sf):
    """Every task whose deadline the watermark has passed, out-of-order input over several micro-batches."""
    return _disordered(spark, sf, lambda events: KS.wait_deadline_stream(events, 600, watermark="2 days"))


@register("K6a_message_size_guard", """
SELECT key, partition, "offset", cast(strlen(value) AS int) AS size,
       CASE WHEN strlen(value) > 5242880 THEN 'dead_letter' ELSE 'ok' END AS route FROM topic""", ("topic",))
def k6a(spark, sf):
    return J.message_size_guard(fx.topic(spark, sf)).select("key", "partition", "offset", "size", "route")


@register("K6b_topic_partition", """
SELECT DISTINCT task_id AS key, cast(('0x' || substr(md5(task_id), 1, 8))::bigint % 3 AS int) AS partition FROM task_events""",
          ("task_events",))
def k6b(spark, sf):
    keys = fx.task_events(spark, sf).select(F.col("task_id").alias("key")).distinct()
    return J.topic_partition(keys, 3).select("key", "partition")


@register("K6c_topic_retention", f"""
WITH r AS (SELECT * FROM topic WHERE timestamp >= TIMESTAMP '{NOW_TOPIC}' - INTERVAL 72 HOUR),
s AS (SELECT key, partition, "offset",
             sum(strlen(value)) OVER (PARTITION BY partition ORDER BY "offset" DESC ROWS UNBOUNDED PRECEDING) AS bytes_from_newest
      FROM r)
SELECT key, partition, "offset", cast(bytes_from_newest AS bigint) AS bytes_from_newest FROM s WHERE bytes_from_newest <= {1 << 30}""",
          ("topic",))
def k6c(spark, sf):
    return J.topic_retention(fx.topic(spark, sf), NOW_TOPIC).select("key", "partition", "offset", "bytes_from_newest")


@register("K8_heartbeat_monitor", f"""
WITH n AS (SELECT worker_id, ts, lead(ts) OVER (PARTITION BY worker_id ORDER BY ts, event_id) AS nxt FROM task_events
           WHERE ts <= TIMESTAMP '{NOW_TOPIC}')
SELECT worker_id, ts AS silent_from, nxt AS silent_until FROM n
WHERE coalesce(nxt, TIMESTAMP '{NOW_TOPIC}') - ts > INTERVAL 900 SECOND""", ("task_events",))
def k8(spark, sf):
    return J.silent_gaps(fx.task_events(spark, sf), NOW_TOPIC, 900)


@register("W3_queue_depth", """
WITH t AS (SELECT * FROM tasks WHERE status <> 'cancelled'),
d AS (SELECT date_trunc('minute', created_at) AS minute, 1 AS dp, 0 AS dr FROM t
      UNION ALL SELECT date_trunc('minute', started_at), -1, 1 FROM t WHERE started_at IS NOT NULL
      UNION ALL SELECT date_trunc('minute', completed_at), 0, -1 FROM t WHERE completed_at IS NOT NULL),
m AS (SELECT minute, sum(dp) AS pending_delta, sum(dr) AS processing_delta FROM d GROUP BY minute)
SELECT minute, cast(pending_delta AS bigint) AS pending_delta, cast(processing_delta AS bigint) AS processing_delta,
       cast(sum(pending_delta) OVER (ORDER BY minute ROWS UNBOUNDED PRECEDING) AS bigint) AS pending_depth,
       cast(sum(processing_delta) OVER (ORDER BY minute ROWS UNBOUNDED PRECEDING) AS bigint) AS processing_depth
FROM m""", ("tasks",))
def w3(spark, sf):
    return L.queue_depth(fx.tasks(spark, sf))


# ------------------------------------------------------------------ sources and sinks

def _staged_pages(spark, sf) -> str:
    """Every page as a file (its HTML and a line end) of a tree with a folder for each thousand ids."""
    path = scratch_path(spark, "pages-files")
    page = F.col("page_id")
    name = F.concat((page / 1000).cast("long").cast("string"), F.lit("/page"), page.cast("string"), F.lit(".html"))
    upload_objects(load(spark, sf, "pages").select(page.alias("task_id"), name.alias("path"), name.alias("object_name"), name.alias("url"),
                                                   F.encode(F.concat("html", F.lit("\n")), "UTF-8").alias("content")), path)
    return path


def _page_id():
    return F.regexp_extract("path", r"/page(\d+)\.html$", 1).cast("long").alias("page_id")


@register("A1_scan_documents", "SELECT page_id, cast(strlen(html) + 1 AS bigint) AS length FROM pages")
def a1(spark, sf):
    docs = SF.scan_documents(spark, _staged_pages(spark, sf), "*.html")
    return docs.select(_page_id(), F.octet_length("content").cast("long").alias("length"))


@register("A4_file_metadata", "SELECT page_id, cast(strlen(html) + 1 AS bigint) AS size, true AS has_modified_at FROM pages")
def a4(spark, sf):
    files = SF.with_file_metadata(SF.scan_documents(spark, _staged_pages(spark, sf), "*.html", with_content=False))
    # the modification time depends on when the files were written: checked for presence only
    return files.select(_page_id(), "size", F.col("modified_at").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}").alias("has_modified_at"))


@register("A2b_scan_result_tree", """
SELECT task_id, kind, regexp_extract(path, '[^/]*$') AS file_name, size, md5(content) AS content_md5
FROM result_files WHERE size > 0""", ("result_files",))
def a2b(spark, sf):
    """The result files written out as a tree and listed again (file sources leave out empty files)."""
    root = scratch_path(spark, "results-tree")
    name = F.regexp_replace("path", "^/out/", "")
    upload_objects(fx.result_files(spark, sf).filter("size > 0").select("task_id", "path", name.alias("object_name"), name.alias("url"), "content"), root)
    tree = SF.scan_artifacts(spark, root)
    return tree.select("task_id", "kind", C.basename("path").alias("file_name"), "size", F.md5("content").alias("content_md5"))


@register("A3_read_json_artifact", """
WITH x AS (SELECT 'e' || cast(event_id AS varchar) AS id, props AS j FROM events
           UNION ALL SELECT 'd' || cast(doc_id AS varchar), text FROM documents),
v AS (SELECT id, j, json_valid(j) AND regexp_matches(j, '^\\s*\\{') AS ok FROM x)
SELECT id, CASE WHEN ok THEN TRY_CAST(json_extract(j, '$.k') AS BIGINT) END AS k, NOT ok AS bad_json FROM v""")
def a3(spark, sf):
    e = load(spark, sf, "events").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.col("props").alias("j"))
    d = load(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("j"))
    p = SF.parse_json_artifact(e.unionByName(d), "j", "k bigint")
    return p.select("id", F.col("parsed.k").alias("k"), "bad_json")


@register("A6_write_results", _P7_SQL)
def a6(spark, sf):
    root = scratch_path(spark, "results")
    SF.write_results(D.convert_documents(docs_in(spark, sf)), root, "0", key="doc_id")
    back = SF.read_results(spark, root)
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "route", "converter", "status", "n_blocks", "error_message")


@register("A8_topic_io", 'SELECT key, value, topic, partition, "offset", timestamp, 0 AS "timestampType" FROM topic', ("topic",))
def a8(spark, sf):
    path, out, ck = scratch_path(spark, "topic"), scratch_path(spark, "topic-out"), scratch_path(spark, "topic-ckpt")
    J.write_topic(fx.topic(spark, sf), path)
    stream = J.read_topic(spark, path)
    J.run_available_now(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck))
    return spark.read.parquet(out).select("key", "value", "topic", "partition", "offset", "timestamp", "timestampType")


@register("A9_graph_files", """
WITH nodes AS (SELECT 'c' || cast(c_custkey AS varchar) AS node_id FROM customer
               UNION ALL SELECT 'n' || cast(n_nationkey AS varchar) FROM nation
               UNION ALL SELECT 'r' || cast(r_regionkey AS varchar) FROM region),
edges AS (SELECT 'c' || cast(c_custkey AS varchar) AS src, 'n' || cast(c_nationkey AS varchar) AS dst, 'IN_NATION' AS rel FROM customer
          UNION ALL SELECT 'n' || cast(n_nationkey AS varchar), 'r' || cast(n_regionkey AS varchar), 'IN_REGION' FROM nation)
SELECT e.src, e.dst, e.rel, (e.src IN (SELECT node_id FROM nodes)) AND (e.dst IN (SELECT node_id FROM nodes)) AS valid FROM edges e""")
def a9(spark, sf):
    nodes, edges = ST.graph_from_tables(load(spark, sf, "customer"), load(spark, sf, "nation"), load(spark, sf, "region"))
    path = scratch_path(spark, "graph")
    ST.export_graph(nodes, edges, path, "json")
    _, e = ST.import_graph(spark, path, "json")
    return e.select("src", "dst", "rel", "valid")


# ------------------------------------------------------------------ plug-ins

@register("X1_converter_plugin", f"""
WITH {_html()}
SELECT doc_id, cast(n_heading + n_paragraph + n_list_item + n_text AS bigint) AS n_blocks FROM hcount
WHERE n_heading + n_paragraph + n_list_item + n_text > 0""")
def x1(spark, sf):
    pages = load(spark, sf, "pages")
    b = D.to_blocks(pages, "page_id", "html", CV.HtmlConverter())
    return b.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_blocks"))
