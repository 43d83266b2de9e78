"""Registered queries: one per operator ID of SURVEY section 2, each with its DuckDB oracle.

Every query reads the given tables (or what Spark derives from them) in full. Arrays and maps are
rendered to text in the *check projection* only, so both engines hash identical scalars; the
operators themselves return the native types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators import ledger as L
from ..operators.transitions import fold_transitions
from ..session import load, scratch_path
from ..sources.files import scan_documents
from ..sources.objects import retire_results
from . import fixtures as fx
from .catalog import ORACLE, QUERIES, Query, register  # noqa: F401  (re-exported)
from .oracle import AS_OF_SQL

AS_OF = fx.AS_OF


def _tasks(spark, sf):
    return fx.tasks(spark, sf)


_LEDGER_NAMES = ("task_id", "file_name", "status", "priority", "backend", "options", "result_path", "error_message",
                 "created_at", "started_at", "completed_at", "worker_id", "retry_count")


def _ledger_sql(**changed: str) -> str:
    """Select list of the ledger ``t``, with some columns replaced by expressions."""
    return ", ".join(f"{changed.get(c, 't.' + c)} AS {c}" for c in _LEDGER_NAMES)


_LEDGER_COLS = ", ".join(_LEDGER_NAMES)


def _ledger_cols(df):
    return df.select(*_LEDGER_NAMES)


# ------------------------------------------------------------------ aggregations

@register("G1_queue_stats", "SELECT status, count(*) AS count FROM tasks GROUP BY status", ("tasks",))
def g1(spark, sf):
    return L.queue_stats(_tasks(spark, sf))


@register("G2_queue_stats_total",
          "SELECT status, count(*) AS count, cast(grouping(status) AS int) AS is_total FROM tasks GROUP BY ROLLUP (status)",
          ("tasks",))
def g2(spark, sf):
    return L.queue_stats_total(_tasks(spark, sf))


@register("G3_queue_snapshot", f"""
SELECT {AS_OF_SQL} AS as_of,
       count(*) FILTER (WHERE status = 'pending') AS pending,
       count(*) FILTER (WHERE status = 'processing') AS processing,
       count(*) FILTER (WHERE status = 'completed') AS completed,
       count(*) FILTER (WHERE status = 'failed') AS failed
FROM tasks""", ("tasks",))
def g3(spark, sf):
    return L.queue_snapshot(_tasks(spark, sf), AS_OF)


def _segment_batches(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = load(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return (o.join(c, o.o_custkey == c.c_custkey)
            .select(F.col("c_mktsegment").alias("batch_id"),
                    F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("task_id")).distinct())


@register("G4_batch_outcome", """
WITH b AS (SELECT DISTINCT c.c_mktsegment AS batch_id, concat('t', cast(o.o_orderkey AS varchar)) AS task_id
           FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)
SELECT b.batch_id, count(*) AS submitted,
       count(*) FILTER (WHERE t.status = 'completed') AS completed,
       count(*) FILTER (WHERE t.status = 'failed') AS failed,
       count(*) FILTER (WHERE t.status IS NOT NULL AND t.status NOT IN ('completed', 'failed')) AS unfinished,
       count(*) FILTER (WHERE t.status IS NULL) AS not_found
FROM b LEFT JOIN tasks t ON b.task_id = t.task_id GROUP BY b.batch_id""", ("tasks",))
def g4(spark, sf):
    return L.batch_outcome(_tasks(spark, sf), _segment_batches(spark, sf))


def _lat_sql(name, a, b):
    e = f"date_diff('second', {a}, {b})"
    return (f"count({e}) AS {name}_n, min({e}) AS {name}_min, round(avg({e}), 6) AS {name}_avg, "
            f"quantile_disc({e}, 0.5) AS {name}_p50, quantile_disc({e}, 0.95) AS {name}_p95, max({e}) AS {name}_max")


@register("G5_latency_metrics", f"""
SELECT backend, {_lat_sql('response', 'created_at', 'started_at')}, {_lat_sql('run', 'started_at', 'completed_at')}
FROM tasks WHERE started_at IS NOT NULL GROUP BY backend""", ("tasks",))
def g5(spark, sf):
    return L.latency_metrics(_tasks(spark, sf))


@register("G6_worker_health", f"""
SELECT worker_id, max(greatest(started_at, completed_at)) AS last_seen,
       count(*) FILTER (WHERE status = 'processing') AS in_flight,
       count(*) FILTER (WHERE status = 'completed') AS completed,
       count(*) FILTER (WHERE status = 'failed') AS failed,
       max(greatest(started_at, completed_at)) >= {AS_OF_SQL} - INTERVAL 900 SECOND AS healthy
FROM tasks WHERE worker_id IS NOT NULL GROUP BY worker_id""", ("tasks",))
def g6(spark, sf):
    return L.worker_health(_tasks(spark, sf), AS_OF)


# ------------------------------------------------------------------ projections / filters

_LANG_SQL = "coalesce(nullif(regexp_extract(url, '/([a-z]{2})/', 1), ''), 'ch')"


def page_files(spark, sf) -> DataFrame:
    """Pages seen as uploaded files (name, path, byte length, language from the URL)."""
    p = load(spark, sf, "pages")
    return p.select(
        F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit(".html")).alias("file_name"),
        F.col("url").alias("file_path"),
        F.octet_length("html").cast("long").alias("content_length"),
        F.nullif(F.regexp_extract("url", "/([a-z]{2})/", 1), F.lit("")).alias("lang"),
    )


@register("B1_submit_batch", f"""
SELECT sha256(url || '|' || cast(strlen(html) AS varchar)) AS task_id,
       concat('page', cast(page_id AS varchar), '.html') AS file_name, url AS file_path,
       'pending' AS status, 0 AS priority, 'pipeline' AS backend,
       json_object('lang', {_LANG_SQL}, 'method', 'auto', 'formula_enable', true, 'table_enable', true)::varchar AS options,
       NULL::varchar AS result_path, NULL::varchar AS error_message, {AS_OF_SQL} AS created_at,
       NULL::timestamp AS started_at, NULL::timestamp AS completed_at, NULL::varchar AS worker_id, 0 AS retry_count
FROM pages""")
def b1(spark, sf):
    return L.submit_batch(page_files(spark, sf), AS_OF)


def _lookup_ids(spark, sf):
    li = (load(spark, sf, "lineitem").filter(F.col("l_returnflag") == "R")
          .select(F.concat(F.lit("t"), F.col("l_orderkey").cast("string")).alias("task_id")))
    ev = fx.task_events(spark, sf).filter(F.col("op") == "cancel").select("task_id")
    return li.unionByName(ev).distinct()


_LOOKUP_IDS_SQL = """ids AS (SELECT DISTINCT task_id FROM (
    SELECT concat('t', cast(l_orderkey AS varchar)) AS task_id FROM lineitem WHERE l_returnflag = 'R'
    UNION ALL SELECT task_id FROM task_events WHERE op = 'cancel'))"""


@register("B2_lookup_tasks", f"""
WITH {_LOOKUP_IDS_SQL}
SELECT ids.task_id, t.file_name, t.status, t.priority, t.backend, t.result_path, t.created_at,
       t.worker_id, t.retry_count, t.task_id IS NOT NULL AS found
FROM ids LEFT JOIN tasks t ON ids.task_id = t.task_id""", ("tasks", "task_events"))
def b2(spark, sf):
    t = _tasks(spark, sf).select("task_id", "file_name", "status", "priority", "backend", "result_path",
                                 "created_at", "worker_id", "retry_count")
    return L.lookup_tasks(t, _lookup_ids(spark, sf))


@register("B3_list_tasks", """
SELECT * FROM tasks WHERE status = 'pending' ORDER BY created_at DESC, task_id LIMIT 100""", ("tasks",))
def b3(spark, sf):
    return L.list_tasks(_tasks(spark, sf), "pending", 100)


@register("B7_decode_options", """
SELECT task_id, coalesce(json_extract_string(options, '$.lang'), 'ch') AS lang,
       coalesce(json_extract_string(options, '$.method'), 'auto') AS method,
       coalesce(cast(json_extract(options, '$.formula_enable') AS boolean), true) AS formula_enable,
       coalesce(cast(json_extract(options, '$.table_enable') AS boolean), true) AS table_enable
FROM tasks""", ("tasks",))
def b7(spark, sf):
    return L.decode_options(_tasks(spark, sf)).select("task_id", "lang", "method", "formula_enable", "table_enable")


def v1_params(spark, sf) -> DataFrame:
    """v1 request parameters as the strings a client sends, derived from ``events``."""
    e = load(spark, sf, "events")
    et = F.col("event_type")
    return e.select(
        F.col("event_id").alias("request_id"),
        F.get_json_object("props", "$.k").alias("start_page_id"),
        F.when(et.isin("view", "click"), F.lit("")).otherwise(F.col("user_id").cast("string")).alias("end_page_id"),
        F.when(et == "signup", "txt").when(et == "error", "").when(et == "view", "auto").alias("parse_method"),
        F.when(F.col("value") > 50, "False").otherwise("true").alias("is_json_md_dump"),
        F.when(et == "click", "TRUE").otherwise("no").alias("return_layout"),
        (F.col("value") > 20).cast("string").alias("return_info"),
        F.lit(None).cast("string").alias("return_content_list"),
        F.upper((F.col("value") > 80).cast("string")).alias("return_images"),
    )


_V1_PARAMS_SQL = """params AS (
  SELECT event_id AS request_id, json_extract_string(props, '$.k') AS start_page_id,
         CASE WHEN event_type IN ('view', 'click') THEN '' ELSE cast(user_id AS varchar) END AS end_page_id,
         CASE WHEN event_type = 'signup' THEN 'txt' WHEN event_type = 'error' THEN '' WHEN event_type = 'view' THEN 'auto' END AS parse_method,
         CASE WHEN value > 50 THEN 'False' ELSE 'true' END AS is_json_md_dump,
         CASE WHEN event_type = 'click' THEN 'TRUE' ELSE 'no' END AS return_layout,
         cast(value > 20 AS varchar) AS return_info, NULL::varchar AS return_content_list,
         upper(cast(value > 80 AS varchar)) AS return_images
  FROM events)"""


@register("B8_coerce_params", f"""
WITH {_V1_PARAMS_SQL}
SELECT request_id, coalesce(TRY_CAST(start_page_id AS INTEGER), 0) AS start_page_id,
       TRY_CAST(nullif(trim(end_page_id), '') AS INTEGER) AS end_page_id,
       coalesce(nullif(parse_method, ''), 'ocr') AS parse_method,
       coalesce(lower(is_json_md_dump) = 'true', false) AS is_json_md_dump,
       coalesce(lower(return_layout) = 'true', false) AS return_layout,
       coalesce(lower(return_info) = 'true', false) AS return_info,
       coalesce(lower(return_content_list) = 'true', false) AS return_content_list,
       coalesce(lower(return_images) = 'true', false) AS return_images
FROM params""")
def b8(spark, sf):
    return L.coerce_params(v1_params(spark, sf))


@register("B9_terminal_filter",
          "SELECT task_id, status FROM tasks WHERE status IN ('completed', 'failed', 'cancelled')", ("tasks",))
def b9(spark, sf):
    return L.terminal_filter(_tasks(spark, sf)).select("task_id", "status")


# ------------------------------------------------------------------ ordering, claims, windows

@register("O1_claim_order", """
SELECT task_id, priority, created_at,
       cast(row_number() OVER (ORDER BY priority DESC, created_at, task_id) AS bigint) AS claim_rank
FROM tasks WHERE status = 'pending'""", ("tasks",))
def o1(spark, sf):
    return L.claim_order(_tasks(spark, sf))


WORKERS = ["w0", "w1", "w2", "w3"]


_CLAIMS_SQL = f"""
WITH top AS (SELECT task_id, priority, created_at FROM tasks WHERE status = 'pending'
             ORDER BY priority DESC, created_at, task_id LIMIT 100),
r AS (SELECT task_id, cast(row_number() OVER (ORDER BY priority DESC, created_at, task_id) AS bigint) AS claim_rank FROM top),
c AS (SELECT task_id, claim_rank, 'w' || cast((claim_rank - 1) % 4 AS varchar) AS worker_id, {AS_OF_SQL} AS started_at FROM r)"""


@register("U1_claim_batch", f"{_CLAIMS_SQL} SELECT * FROM c", ("tasks",))
def u1(spark, sf):
    return L.claim_batch(_tasks(spark, sf), WORKERS, 100, AS_OF)[1]


_CLAIMED = _ledger_sql(status="CASE WHEN c.task_id IS NULL THEN t.status ELSE 'processing' END",
                       started_at="CASE WHEN c.task_id IS NULL THEN t.started_at ELSE c.started_at END",
                       worker_id="coalesce(c.worker_id, t.worker_id)")


@register("U1b_ledger", f"{_CLAIMS_SQL} SELECT {_CLAIMED} FROM tasks t LEFT JOIN c ON t.task_id = c.task_id", ("tasks",))
def u1b(spark, sf):
    return _ledger_cols(L.claim_batch(_tasks(spark, sf), WORKERS, 100, AS_OF)[0])


FOLD_SQL = """
WITH RECURSIVE ev AS (
  SELECT task_id, ts, event_id, op, worker_id,
         row_number() OVER (PARTITION BY task_id ORDER BY ts, event_id) AS rn,
         count(*) OVER (PARTITION BY task_id) AS n_events
  FROM task_events),
fold AS (
  SELECT DISTINCT task_id, CAST(0 AS BIGINT) AS rn, NULL::varchar AS status, NULL::varchar AS worker,
         NULL::timestamp AS started, NULL::timestamp AS completed, CAST(0 AS BIGINT) AS retries, CAST(0 AS BIGINT) AS applied
  FROM ev
  UNION ALL
  SELECT task_id, rn,
         CASE WHEN ok THEN CASE op WHEN 'submit' THEN 'pending' WHEN 'claim' THEN 'processing'
              WHEN 'complete' THEN 'completed' WHEN 'fail' THEN 'failed' WHEN 'cancel' THEN 'cancelled'
              ELSE 'pending' END ELSE status END,
         CASE WHEN ok AND op = 'claim' THEN e_worker WHEN ok AND op IN ('reset', 'cancel', 'submit') THEN NULL ELSE worker END,
         CASE WHEN ok AND op = 'claim' THEN ts ELSE started END,
         CASE WHEN ok AND op IN ('complete', 'fail') THEN ts ELSE completed END,
         retries + CASE WHEN ok AND op = 'reset' THEN 1 ELSE 0 END,
         applied + CASE WHEN ok THEN 1 ELSE 0 END
  FROM (
    SELECT f.task_id, e.rn, e.op, e.ts, e.worker_id AS e_worker, f.status, f.worker, f.started, f.completed,
           f.retries, f.applied,
           coalesce(CASE e.op
             WHEN 'submit' THEN f.status IS NULL
             WHEN 'claim' THEN f.status = 'pending'
             WHEN 'cancel' THEN f.status = 'pending'
             WHEN 'reset' THEN f.status = 'processing' AND f.started < e.ts - INTERVAL 60 MINUTE
             ELSE f.status = 'processing' AND (e.worker_id IS NULL OR e.worker_id = f.worker) END, false) AS ok
    FROM fold f JOIN ev e ON e.task_id = f.task_id AND e.rn = f.rn + 1) s),
last AS (SELECT f.*, ev.n_events FROM fold f JOIN (SELECT DISTINCT task_id, n_events FROM ev) ev
         ON f.task_id = ev.task_id AND f.rn = ev.n_events)
SELECT task_id, status,
       CASE WHEN status IN ('processing', 'completed', 'failed') THEN worker END AS worker_id,
       started AS started_at, completed AS completed_at, retries AS retry_count, applied,
       n_events - applied AS rejected
FROM last"""


@register("U2_fold_transitions", FOLD_SQL, ("task_events",))
def u2(spark, sf):
    return fold_transitions(fx.task_events(spark, sf))


HOT_EVENTS_SQL = """SELECT event_id, CASE WHEN event_id % 5 < 2 THEN 'hot' ELSE task_id END AS task_id, ts, op, worker_id FROM task_events"""


@register("U2b_fold_hot_task", FOLD_SQL.replace("FROM task_events)", f"FROM ({HOT_EVENTS_SQL}) h)"), ("task_events",))
def u2b(spark, sf):
    """U2 with two fifths of all events in one task."""
    e = fx.task_events(spark, sf)
    return fold_transitions(e.withColumn("task_id", F.when(F.col("event_id") % 5 < 2, "hot").otherwise(F.col("task_id"))))


@register("U3_reset_stale", f"""
WITH s AS (SELECT *, coalesce(status = 'processing' AND started_at < {AS_OF_SQL} - INTERVAL 60 MINUTE, false) AS stale FROM tasks)
SELECT task_id, file_name, CASE WHEN stale THEN 'pending' ELSE status END AS status, priority, backend, options,
       result_path, error_message, created_at, started_at, completed_at,
       CASE WHEN stale THEN NULL ELSE worker_id END AS worker_id,
       CASE WHEN stale THEN retry_count + 1 ELSE retry_count END AS retry_count
FROM s""", ("tasks",))
def u3(spark, sf):
    return _ledger_cols(L.reset_stale(_tasks(spark, sf), AS_OF, 60))


def _existing_dirs(spark, sf, ledger=None):
    return fx.artifacts(spark, sf, ledger).select("task_id").distinct()


@register("U4_retire_artifacts", f"""
WITH c AS (SELECT task_id, result_path FROM tasks
           WHERE status IN ('completed', 'failed') AND completed_at < {AS_OF_SQL} - INTERVAL 7 DAY AND result_path IS NOT NULL),
d AS (SELECT DISTINCT task_id FROM artifacts)
SELECT c.task_id, c.result_path, d.task_id IS NOT NULL AS deleted FROM c LEFT JOIN d ON c.task_id = d.task_id""",
          ("tasks", "artifacts"))
def u4(spark, sf):
    t = _tasks(spark, sf)
    return L.retire_artifacts(t, AS_OF, 7, deleted=_existing_dirs(spark, sf, t))[1]


_RETIRED = f"""t.status IN ('completed', 'failed') AND t.completed_at < {AS_OF_SQL} - INTERVAL 7 DAY
    AND t.task_id IN (SELECT task_id FROM artifacts)"""


@register("U4b_ledger", f"SELECT {_ledger_sql(result_path=f'CASE WHEN {_RETIRED} THEN NULL ELSE t.result_path END')} FROM tasks t",
          ("tasks", "artifacts"))
def u4b(spark, sf):
    t = _tasks(spark, sf)
    return _ledger_cols(L.retire_artifacts(t, AS_OF, 7, deleted=_existing_dirs(spark, sf, t))[0])


@register("U4c_delete_folders", f"""
WITH c AS (SELECT task_id, cast(substr(task_id, 2) AS bigint) AS num, status IN ('completed', 'failed')
                  AND completed_at < {AS_OF_SQL} - INTERVAL 7 DAY AND result_path IS NOT NULL AS old,
                  result_path IS NOT NULL AS has, task_id IN (SELECT task_id FROM artifacts) AS there FROM tasks)
SELECT task_id, coalesce(old AND there AND num % 5 > 0, false) AS deleted,
       CASE WHEN old AND NOT there THEN 'missing' WHEN old AND num % 5 = 0 THEN 'NotADirectoryError: not a folder' END AS error,
       has AND NOT coalesce(old AND there AND num % 5 > 0, false) AS keeps_path,
       coalesce(there AND NOT (old AND num % 5 > 0), false) AS on_disk FROM c""", ("tasks", "artifacts"))
def u4c(spark, sf):
    """U4 over a tree of result folders: those of old tasks are deleted (a plain file in a folder's place cannot
    be), the whole step is run again as after a lost driver, and the tree is listed."""
    root = scratch_path(spark, "result-tree")
    tree = fx.result_tree(spark, sf, root)
    ledger, _ = retire_results(tree, AS_OF, root)
    ledger, outcomes = retire_results(tree, AS_OF, root)
    left = scan_documents(spark, root, with_content=False).select(F.regexp_extract("path", "/(t[0-9]+)(/|$)", 1).alias("task_id"), F.lit(True).alias("on_disk"))
    return (ledger.select("task_id", "result_path").join(outcomes.select("task_id", "deleted", "error"), "task_id", "left")
            .join(left, "task_id", "left")
            .select("task_id", F.coalesce("deleted", F.lit(False)).alias("deleted"), "error", F.col("result_path").isNotNull().alias("keeps_path"),
                    F.coalesce("on_disk", F.lit(False)).alias("on_disk")))


@register("U5_purge_records", f"""
SELECT {_LEDGER_COLS} FROM tasks
WHERE NOT coalesce(status IN ('completed', 'failed') AND completed_at < {AS_OF_SQL} - INTERVAL 30 DAY, false)""",
          ("tasks",))
def u5(spark, sf):
    return _ledger_cols(L.purge_records(_tasks(spark, sf), AS_OF, 30))


@register("U6_first_claim_wins", """
SELECT task_id, event_id, ts, worker_id FROM (
  SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts, event_id) AS rn FROM task_events WHERE op = 'claim')
WHERE rn = 1""", ("task_events",))
def u6(spark, sf):
    return L.first_claim_wins(fx.task_events(spark, sf).filter(F.col("op") == "claim"))


@register("W4_attempt_number", """
SELECT event_id, task_id, ts, cast(row_number() OVER (PARTITION BY task_id ORDER BY ts, event_id) AS bigint) AS attempt
FROM task_events WHERE op = 'claim'""", ("task_events",))
def w4(spark, sf):
    return L.attempt_number(fx.task_events(spark, sf))


# ------------------------------------------------------------------ joins on the ledger

def _cancel_req(spark, sf):
    li = load(spark, sf, "lineitem").filter(F.col("l_linestatus") == "O")
    a = li.select(F.concat(F.lit("t"), F.col("l_orderkey").cast("string")).alias("task_id"))
    b = fx.task_events(spark, sf).filter(F.col("op") == "cancel").select("task_id")
    return a.unionByName(b)


_CANCEL_SQL = """
WITH req AS (SELECT DISTINCT task_id FROM (
    SELECT concat('t', cast(l_orderkey AS varchar)) AS task_id FROM lineitem WHERE l_linestatus = 'O'
    UNION ALL SELECT task_id FROM task_events WHERE op = 'cancel'))"""


@register("J2_cancel_requests", _CANCEL_SQL + """
SELECT req.task_id, t.status AS previous_status,
       CASE WHEN t.status IS NULL THEN 'not_found' WHEN t.status = 'pending' THEN 'cancelled' ELSE 'rejected' END AS outcome,
       CASE WHEN t.status IS NULL THEN 'Task not found' WHEN t.status = 'pending' THEN 'Task cancelled successfully'
            ELSE 'Cannot cancel task in ' || t.status || ' status' END AS message
FROM req LEFT JOIN tasks t ON req.task_id = t.task_id""", ("tasks", "task_events"))
def j2(spark, sf):
    return L.cancel_requests(_tasks(spark, sf), _cancel_req(spark, sf))[1]


_CANCELLED = _ledger_sql(status="CASE WHEN t.status = 'pending' AND t.task_id IN (SELECT task_id FROM req) THEN 'cancelled' ELSE t.status END")


@register("J2b_ledger", f"{_CANCEL_SQL} SELECT {_CANCELLED} FROM tasks t", ("tasks", "task_events"))
def j2b(spark, sf):
    return _ledger_cols(L.cancel_requests(_tasks(spark, sf), _cancel_req(spark, sf))[0])


def worker_results(spark, sf) -> DataFrame:
    """Worker result messages derived from ``lineitem``: one message per (order, line) - every line
    reports on its order's task, so all but the first per task are duplicates (the line table
    repeats some pairs, so they are merged first and the message id is unique, as the operator
    requires). Even lines carry no worker id."""
    li = (load(spark, sf, "lineitem")
          .groupBy("l_orderkey", "l_linenumber")
          .agg(F.min("l_shipdate").alias("l_shipdate"), F.min("l_suppkey").alias("l_suppkey"),
               F.max("l_returnflag").alias("l_returnflag")))
    s = F.col("l_suppkey")
    failed = F.col("l_returnflag") == "R"
    return li.select(
        F.concat(F.lit("t"), F.col("l_orderkey").cast("string")).alias("task_id"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("result_id"),
        F.col("l_shipdate").alias("ts"),
        F.when(failed, "failed").otherwise("completed").alias("status"),
        F.when(F.col("l_linenumber") % 2 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("wk-host-"), (s % 3).cast("string"), F.lit("-cuda:"), (s % 2).cast("string"),
                             F.lit("-"), (1000 + s % 7).cast("string"))).alias("worker_id"),
        F.when(~failed, F.concat(F.lit("/out/t"), F.col("l_orderkey").cast("string"))).alias("result_path"),
        F.when(failed, F.lit("parse error")).alias("error_message"),
    )


_RESULTS_SQL = """li AS (SELECT l_orderkey, l_linenumber, min(l_shipdate) AS l_shipdate, min(l_suppkey) AS l_suppkey,
              max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY l_orderkey, l_linenumber),
res AS (
  SELECT concat('t', cast(l_orderkey AS varchar)) AS task_id, l_orderkey * 100 + l_linenumber AS result_id,
         l_shipdate AS ts, CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'completed' END AS status,
         CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE 'wk-host-' || cast(l_suppkey % 3 AS varchar) || '-cuda:' ||
              cast(l_suppkey % 2 AS varchar) || '-' || cast(1000 + l_suppkey % 7 AS varchar) END AS worker_id
  FROM li)"""


@register("J3_apply_results", f"""
WITH {_RESULTS_SQL},
first AS (SELECT r.task_id, arg_min(r.result_id, (r.ts, r.result_id)) AS first_id FROM res r JOIN tasks t ON r.task_id = t.task_id
          WHERE t.status = 'processing' AND (r.worker_id IS NULL OR r.worker_id IS NOT DISTINCT FROM t.worker_id) GROUP BY r.task_id)
SELECT r.task_id, r.result_id, r.status, r.worker_id,
       CASE WHEN t.status IS NULL THEN 'not_found' WHEN t.status <> 'processing' THEN 'status ' || t.status
            WHEN r.worker_id IS NOT NULL AND r.worker_id IS DISTINCT FROM t.worker_id THEN 'worker mismatch'
            WHEN r.result_id <> f.first_id THEN 'duplicate' END AS reason
FROM res r LEFT JOIN first f ON r.task_id = f.task_id LEFT JOIN tasks t ON r.task_id = t.task_id""", ("tasks",))
def j3(spark, sf):
    out = L.result_outcomes(_tasks(spark, sf), worker_results(spark, sf))
    return out.select("task_id", "result_id", "status", "worker_id", "reason")


_ACCEPTED = _ledger_sql(
    status="coalesce(a.status, t.status)", completed_at="CASE WHEN a.status IS NULL THEN t.completed_at ELSE cast(a.ts AS timestamp) END",
    result_path="CASE WHEN a.status = 'completed' THEN '/out/' || a.task_id ELSE t.result_path END",
    error_message="CASE WHEN a.status = 'failed' THEN 'parse error' ELSE t.error_message END")


@register("J3b_ledger", f"""
WITH {_RESULTS_SQL},
a AS (SELECT r.* FROM res r JOIN tasks t ON r.task_id = t.task_id
      WHERE t.status = 'processing' AND (r.worker_id IS NULL OR r.worker_id IS NOT DISTINCT FROM t.worker_id)
      QUALIFY row_number() OVER (PARTITION BY r.task_id ORDER BY r.ts, r.result_id) = 1)
SELECT {_ACCEPTED} FROM tasks t LEFT JOIN a ON t.task_id = a.task_id""", ("tasks",))
def j3b(spark, sf):
    return _ledger_cols(L.apply_results(_tasks(spark, sf), worker_results(spark, sf))[0])


@register("J5_missing_results", """
SELECT task_id, result_path, 'Task completed but result files have been cleaned up (older than retention period)' AS reason
FROM tasks WHERE status = 'completed' AND result_path IS NULL
UNION ALL
SELECT task_id, result_path, 'Result directory does not exist' AS reason FROM tasks t
WHERE status = 'completed' AND result_path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM artifacts a WHERE a.task_id = t.task_id)""",
          ("tasks", "artifacts"))
def j5(spark, sf):
    t = _tasks(spark, sf)
    return L.missing_results(t, fx.artifacts(spark, sf, t))


@register("G7_affected_rows", f"""
SELECT 'U1' AS mutation, count(*) AS affected_rows FROM ({ORACLE["U1_claim_batch"]}) x
UNION ALL SELECT 'U2', cast(sum(applied) AS bigint) FROM ({ORACLE["U2_fold_transitions"]}) x
UNION ALL SELECT 'U3', count(*) FROM tasks WHERE status = 'processing' AND started_at < {AS_OF_SQL} - INTERVAL 60 MINUTE
UNION ALL SELECT 'U4', count(*) FROM ({ORACLE["U4_retire_artifacts"]}) x WHERE deleted
UNION ALL SELECT 'U5', count(*) FROM tasks WHERE status IN ('completed', 'failed') AND completed_at < {AS_OF_SQL} - INTERVAL 30 DAY
UNION ALL SELECT 'J2', count(*) FROM ({ORACLE["J2_cancel_requests"]}) x WHERE outcome = 'cancelled'
UNION ALL SELECT 'J3', count(*) FROM ({ORACLE["J3_apply_results"]}) x WHERE reason IS NULL""", ("tasks",))
def g7(spark, sf):
    """Each mutation writes its new ledger and counts the rows it changed in the same pass."""
    t = _tasks(spark, sf)

    def watched(name, mutate):
        seen = Observation(name)
        return mutate(seen), seen

    runs = {
        "U1": watched("U1", lambda o: L.claim_batch(t, WORKERS, 100, AS_OF, affected=o)[0]),
        "U2": watched("U2", lambda o: fold_transitions(fx.task_events(spark, sf), affected=o)),
        "U3": L.reset_stale_observed(t, AS_OF, 60),
        "U4": watched("U4", lambda o: L.retire_artifacts(t, AS_OF, 7, deleted=_existing_dirs(spark, sf, t), affected=o)[0]),
        "U5": L.purge_records_observed(t, AS_OF, 30),
        "J2": watched("J2", lambda o: L.cancel_requests(t, _cancel_req(spark, sf), affected=o)[0]),
        "J3": watched("J3", lambda o: L.apply_results(t, worker_results(spark, sf), affected=o)[0]),
    }
    counts = []
    for name, (ledger, seen) in runs.items():
        ledger.write.parquet(scratch_path(spark, f"ledger-{name}"))
        counts.append((name, seen.get["affected_rows"]))
    return spark.createDataFrame(counts, "mutation string, affected_rows long")


@register("K7_wait_deadline", """
WITH s AS (SELECT task_id, min(ts) FILTER (WHERE op = 'submit') AS submitted_at FROM task_events GROUP BY task_id),
t AS (SELECT e.task_id, min(e.ts) AS terminal_at FROM task_events e JOIN s ON e.task_id = s.task_id
      WHERE e.op IN ('complete', 'fail', 'cancel') AND e.ts >= s.submitted_at GROUP BY e.task_id)
SELECT s.task_id, s.submitted_at, t.terminal_at,
       CASE WHEN coalesce(t.terminal_at - s.submitted_at <= INTERVAL 600 SECOND, false) THEN 'reached' ELSE 'timeout' END AS outcome
FROM s LEFT JOIN t ON s.task_id = t.task_id WHERE s.submitted_at IS NOT NULL""", ("task_events",))
def k7(spark, sf):
    return L.wait_deadline(fx.task_events(spark, sf), 600)


from . import registry_documents  # noqa: E402,F401  (registers document queries)
from . import registry_formats  # noqa: E402,F401
from . import registry_functions  # noqa: E402,F401
from . import registry_retrieval  # noqa: E402,F401
from . import registry_streaming  # noqa: E402,F401
