"""Task-ledger operators: stats, lookups, guarded updates and the state machine.

Parquet has no UPDATE, so every mutation is a function ``ledger -> ledger'`` (plus a change set);
the caller writes the new snapshot. Every clock is an argument; nothing reads the wall clock.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.scale import running_count

# fixed values: columns and statuses of the ledger
LEDGER_COLUMNS = [
    "task_id", "file_name", "file_path", "status", "priority", "backend", "options", "result_path",
    "error_message", "created_at", "started_at", "completed_at", "worker_id", "retry_count",
]
STATUSES = ["pending", "processing", "completed", "failed", "cancelled"]
# fixed values: submit defaults and option defaults
DEFAULT_BACKEND = "pipeline"
DEFAULT_PRIORITY = 0
DEFAULT_OPTIONS = {"lang": "ch", "method": "auto", "formula_enable": True, "table_enable": True}
OPTIONS_SCHEMA = "lang string, method string, formula_enable boolean, table_enable boolean"
LIST_LIMIT_DEFAULT, LIST_LIMIT_MAX = 100, 1000


def _ts(now) -> Column:
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp_ntz")


# ---------------------------------------------------------------- aggregations

def queue_stats(tasks: DataFrame) -> DataFrame:
    """G1: rows per status; statuses without rows are absent. Partial + final hash aggregate."""
    return tasks.groupBy("status").agg(F.count(F.lit(1)).alias("count"))


def queue_stats_total(tasks: DataFrame) -> DataFrame:
    """Per-status counts plus the grand total row (``is_total = 1``, status NULL)."""
    return (tasks.rollup("status")
            .agg(F.count(F.lit(1)).alias("count"), F.grouping("status").cast("int").alias("is_total")))


def queue_snapshot(tasks: DataFrame, as_of) -> DataFrame:
    """One wide row with 0 defaults; ``cancelled`` is not part of the monitor's view."""
    s = F.col("status")
    return tasks.agg(
        *[F.count_if(s == st).alias(st) for st in ("pending", "processing", "completed", "failed")]
    ).select(_ts(as_of).alias("as_of"), "pending", "processing", "completed", "failed")


def batch_outcome(tasks: DataFrame, batch_ids: DataFrame) -> DataFrame:
    """Per batch, submitted / completed / failed / other / not_found (ids missing from the
    ledger are reported, not dropped). ``batch_ids`` has (batch_id, task_id)."""
    j = batch_ids.join(tasks.select("task_id", "status"), "task_id", "left")
    s = F.col("status")
    return j.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("submitted"),
        F.count_if(s == "completed").alias("completed"),
        F.count_if(s == "failed").alias("failed"),
        F.count_if(s.isNotNull() & ~s.isin("completed", "failed")).alias("unfinished"),
        F.count_if(s.isNull()).alias("not_found"),
    )


def latency_metrics(tasks: DataFrame, by: Sequence[str] = ("backend",)) -> DataFrame:
    """Response latency (created -> started) and run time (started -> completed), seconds.
    Latencies are whole seconds, so rows are first counted per (group, second) with map-side partial
    sums; the exact quantiles then come from the cumulative counts of that small table."""
    resp = F.timestamp_diff("SECOND", "created_at", "started_at")
    run = F.timestamp_diff("SECOND", "started_at", "completed_at")
    each = F.array(*[F.struct(F.lit(m).alias("_m"), e.alias("_v")) for m, e in (("response", resp), ("run", run))])
    counts = (tasks.filter(F.col("started_at").isNotNull()).select(*by, F.inline(each))
              .groupBy(*by, "_m", "_v").agg(F.count("_v").alias("_n"), F.sum("_v").alias("_s")))
    group = Window.partitionBy(*by, "_m")
    counts = (counts.withColumn("_upto", F.sum("_n").over(group.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("_all", F.sum("_n").over(group)))
    aggs = []
    for name in ("response", "run"):
        def of(value, more=F.lit(True), name=name):
            return F.when((F.col("_m") == name) & F.col("_v").isNotNull() & more, F.col(value))

        aggs += [
            F.coalesce(F.sum(of("_n")), F.lit(0)).alias(f"{name}_n"),
            F.min(of("_v")).alias(f"{name}_min"),
            F.round(F.sum(of("_s")) / F.sum(of("_n")), 6).alias(f"{name}_avg"),
            *[F.min(of("_v", F.col("_upto") * 100 >= F.col("_all") * p)).alias(f"{name}_p{p}") for p in (50, 95)],
            F.max(of("_v")).alias(f"{name}_max"),
        ]
    return counts.groupBy(*by).agg(*aggs)


def worker_health(tasks: DataFrame, as_of, max_age_seconds: int = 900) -> DataFrame:
    """Per worker: last seen, in-flight / completed / failed counts and health."""
    seen = F.greatest("started_at", "completed_at")
    s = F.col("status")
    agg = (tasks.filter(F.col("worker_id").isNotNull())
           .groupBy("worker_id")
           .agg(F.max(seen).alias("last_seen"),
                F.count_if(s == "processing").alias("in_flight"),
                F.count_if(s == "completed").alias("completed"),
                F.count_if(s == "failed").alias("failed")))
    limit = _ts(as_of) - F.make_dt_interval(secs=F.lit(max_age_seconds))
    return agg.withColumn("healthy", F.col("last_seen") >= limit)


# ---------------------------------------------------------------- projections

def task_key(path: str, length: str) -> Column:
    """B1's task id: a hash of a file's path and length."""
    return F.sha2(F.concat_ws("|", path, F.col(length).cast("string")), 256)


def submit_batch(files: DataFrame, now, defaults: dict | None = None) -> DataFrame:
    """B1: new pending ledger rows. ``files`` has file_name, file_path, content_length and may carry
    backend / priority / lang / method / formula_enable / table_enable. The id is a hash of path and
    length, so replaying a submission yields the same ids."""
    d = {**DEFAULT_OPTIONS, "backend": DEFAULT_BACKEND, "priority": DEFAULT_PRIORITY, **(defaults or {})}
    cols = set(files.columns)

    def opt(name):
        return F.coalesce(F.col(name), F.lit(d[name])) if name in cols else F.lit(d[name])

    options = F.to_json(F.struct(opt("lang").alias("lang"), opt("method").alias("method"),
                                 opt("formula_enable").alias("formula_enable"),
                                 opt("table_enable").alias("table_enable")))
    return files.select(
        task_key("file_path", "content_length").alias("task_id"),
        "file_name", "file_path",
        F.lit("pending").alias("status"),
        opt("priority").cast("int").alias("priority"),
        opt("backend").alias("backend"),
        options.alias("options"),
        F.lit(None).cast("string").alias("result_path"),
        F.lit(None).cast("string").alias("error_message"),
        _ts(now).alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("started_at"),
        F.lit(None).cast("timestamp_ntz").alias("completed_at"),
        F.lit(None).cast("string").alias("worker_id"),
        F.lit(0).alias("retry_count"),
    )


def lookup_tasks(tasks: DataFrame, ids: DataFrame) -> DataFrame:
    """B2: fetch by id; a missing id comes back with ``found = false`` (the 404 case)."""
    t = tasks.withColumn("_found", F.lit(True))
    return (ids.select("task_id").join(t, "task_id", "left")
            .withColumn("found", F.coalesce(F.col("_found"), F.lit(False))).drop("_found"))


def list_tasks(tasks: DataFrame, status: str | None = None, limit: int = LIST_LIMIT_DEFAULT) -> DataFrame:
    """Newest first, at most ``limit`` (max 1000). Negative limits are rejected (SQLite would
    read them as "no limit"). ``task_id`` breaks ties so the result is deterministic."""
    if limit < 0 or limit > LIST_LIMIT_MAX:
        raise ValueError(f"limit must be within 0..{LIST_LIMIT_MAX}, got {limit}")
    df = tasks if status is None else tasks.filter(F.col("status") == status)
    return df.orderBy(F.col("created_at").desc(), F.col("task_id")).limit(limit)


def decode_options(tasks: DataFrame) -> DataFrame:
    """JSON options to typed columns with the worker's defaults; malformed JSON -> defaults."""
    o = F.from_json("options", OPTIONS_SCHEMA)
    return tasks.select(
        "*",
        F.coalesce(o["lang"], F.lit(DEFAULT_OPTIONS["lang"])).alias("lang"),
        F.coalesce(o["method"], F.lit(DEFAULT_OPTIONS["method"])).alias("method"),
        F.coalesce(o["formula_enable"], F.lit(True)).alias("formula_enable"),
        F.coalesce(o["table_enable"], F.lit(True)).alias("table_enable"),
    )


def coerce_params(params: DataFrame) -> DataFrame:
    """v1 string parameters to typed values. ``is_json_md_dump`` keeps its plain meaning
    (true when the text is "true"); the original inverted it."""
    def flag(c):
        return F.coalesce(F.lower(F.col(c)) == "true", F.lit(False))

    return params.select(
        "request_id",
        F.coalesce(F.expr("try_cast(start_page_id AS int)"), F.lit(0)).alias("start_page_id"),
        F.expr("try_cast(nullif(trim(end_page_id), '') AS int)").alias("end_page_id"),
        F.coalesce(F.nullif(F.col("parse_method"), F.lit("")), F.lit("ocr")).alias("parse_method"),
        flag("is_json_md_dump").alias("is_json_md_dump"),
        flag("return_layout").alias("return_layout"),
        flag("return_info").alias("return_info"),
        flag("return_content_list").alias("return_content_list"),
        flag("return_images").alias("return_images"),
    )


def terminal_filter(tasks: DataFrame) -> DataFrame:
    """B9."""
    return tasks.filter(C.is_terminal("status"))


# ---------------------------------------------------------------- ordering and claims

def claim_sort() -> list[Column]:
    return [F.col("priority").desc(), F.col("created_at").asc(), F.col("task_id").asc()]


def claim_order(tasks: DataFrame) -> DataFrame:
    """O1: pending rows with their claim rank (priority DESC, created_at, task_id). The rank is a
    distributed ordinal (range-partitioned sort), not a single-partition window."""
    pending = tasks.filter(F.col("status") == "pending").select("task_id", "priority", "created_at")
    ranked = running_count(pending.withColumn("_neg_pri", -F.col("priority")), [],
                           ["_neg_pri", "created_at", "task_id"], "claim_rank")
    return ranked.drop("_neg_pri")


def claim_batch(tasks: DataFrame, workers: Sequence[str], n: int, now, affected=None) -> tuple[DataFrame, DataFrame]:
    """The first ``n`` pending rows in claim order go round-robin to ``workers``.

    Top-n is a TakeOrderedAndProject (per-partition top-n, then merge), so only n rows ever meet in
    one place; the round-robin window and the join back run on those n rows. Returns
    ``(ledger', claims)``. No task is claimed twice; no better pending row is skipped."""
    if n < 0:
        raise ValueError("n must be >= 0")
    w_arr = F.array(*[F.lit(w) for w in workers])
    top = tasks.filter(F.col("status") == "pending").orderBy(*claim_sort()).limit(n).select(
        "task_id", "priority", "created_at")
    rn = F.row_number().over(Window.orderBy(*claim_sort())).cast("long")
    claims = (top.withColumn("claim_rank", rn)
              .withColumn("worker_id", F.element_at(w_arr, (F.pmod(F.col("claim_rank") - 1, F.lit(len(workers))) + 1).cast("int")))
              .withColumn("started_at", _ts(now))
              .select("task_id", "claim_rank", "worker_id", "started_at"))
    c = claims.select("task_id", F.col("worker_id").alias("_w"), F.col("started_at").alias("_s"))
    ledger = (counted(tasks.join(c, "task_id", "left"), F.col("_w").isNotNull(), affected)
              .withColumn("status", F.when(F.col("_w").isNotNull(), "processing").otherwise(F.col("status")))
              .withColumn("worker_id", F.coalesce("_w", "worker_id"))
              .withColumn("started_at", F.when(F.col("_w").isNotNull(), F.col("_s")).otherwise(F.col("started_at")))
              .drop("_w", "_s"))
    return ledger.select(*tasks.columns), claims


def first_claim_wins(claims: DataFrame) -> DataFrame:
    """Duplicate claims of one task collapse to the earliest (ts, event_id). ``min_by`` is a
    hash aggregate with a map-side partial step, so a task with millions of claims is pre-reduced
    in every map task instead of being sorted in one."""
    first = F.min_by(F.struct("event_id", "ts", "worker_id"), F.struct("ts", "event_id"))
    return claims.groupBy("task_id").agg(first.alias("c")).select("task_id", "c.event_id", "c.ts", "c.worker_id")


def attempt_number(events: DataFrame) -> DataFrame:
    """1-based ordinal of each claim of a task (skew-safe ordinal)."""
    claims = events.filter(F.col("op") == "claim").select("event_id", "task_id", "ts")
    return running_count(claims, ["task_id"], ["ts", "event_id"], "attempt")


# ---------------------------------------------------------------- guarded updates

def reset_stale(tasks: DataFrame, now, minutes: int = 60) -> DataFrame:
    """Processing rows started strictly before ``now - minutes`` go back to pending, worker
    cleared, retry + 1; started_at is kept. A narrow projection: no shuffle."""
    stale = (F.col("status") == "processing") & (F.col("started_at") < C.minutes_before(_ts(now), minutes))
    stale = F.coalesce(stale, F.lit(False))
    return tasks.select(*[
        F.when(stale, "pending").otherwise(F.col("status")).alias("status") if c == "status" else
        F.when(stale, F.lit(None).cast("string")).otherwise(F.col("worker_id")).alias("worker_id") if c == "worker_id" else
        F.when(stale, F.col("retry_count") + 1).otherwise(F.col("retry_count")).alias("retry_count") if c == "retry_count" else
        F.col(c) for c in tasks.columns])


def retire_candidates(tasks: DataFrame, now, days: int = 7) -> DataFrame:
    """U4 step 1: completed/failed, finished strictly before ``now - days`` and still holding a
    result path. ``days = 0`` disables retention."""
    if days <= 0:
        return tasks.limit(0).select("task_id", "result_path")
    cond = (F.col("status").isin("completed", "failed") & (F.col("completed_at") < C.days_before(_ts(now), days))
            & F.col("result_path").isNotNull())
    return tasks.filter(cond).select("task_id", "result_path")


def retire_artifacts(tasks: DataFrame, now, days: int = 7,
                     deleted: DataFrame | None = None, affected=None) -> tuple[DataFrame, DataFrame]:
    """U4: returns ``(ledger', manifest)``. The manifest lists result dirs to delete; ``deleted``
    (task_id) acknowledges the dirs that existed and were removed, and only those rows lose their
    result path. Without acknowledgements the ledger is unchanged."""
    manifest = retire_candidates(tasks, now, days)
    if deleted is None:
        return counted(tasks, F.lit(False), affected), manifest.withColumn("deleted", F.lit(False))
    ack = deleted.select("task_id").distinct().withColumn("_ack", F.lit(True))
    man = (manifest.join(ack, "task_id", "left")
           .withColumn("deleted", F.coalesce("_ack", F.lit(False))).drop("_ack"))
    gone = man.filter("deleted").select("task_id", F.lit(True).alias("_gone"))
    ledger = (counted(tasks.join(gone, "task_id", "left"), F.col("_gone"), affected)
              .withColumn("result_path", F.when(F.col("_gone"), F.lit(None).cast("string")).otherwise(F.col("result_path")))
              .drop("_gone").select(*tasks.columns))
    return ledger, man


def purge_records(tasks: DataFrame, now, days: int = 30) -> DataFrame:
    """Drop completed/failed rows finished strictly before ``now - days``. A NULL
    completed_at makes the condition NULL, and NULL keeps the row (cancelled rows are never
    purged)."""
    cond = F.col("status").isin("completed", "failed") & (F.col("completed_at") < C.days_before(_ts(now), days))
    return tasks.filter(~F.coalesce(cond, F.lit(False)))


def cancel_requests(tasks: DataFrame, requests: DataFrame, affected=None) -> tuple[DataFrame, DataFrame]:
    """Per request ``not_found`` / ``cancelled`` (was pending) / ``rejected`` (message names the
    status). Returns ``(ledger', outcomes)``; the guard and the update are one decision, so a claim
    cannot slip in between."""
    req = requests.select("task_id").distinct()
    j = req.join(tasks.select("task_id", "status"), "task_id", "left")
    outcome = (F.when(F.col("status").isNull(), "not_found")
               .when(F.col("status") == "pending", "cancelled").otherwise("rejected"))
    # fixed values: the messages
    message = (F.when(F.col("status").isNull(), "Task not found")
               .when(F.col("status") == "pending", "Task cancelled successfully")
               .otherwise(F.concat(F.lit("Cannot cancel task in "), F.col("status"), F.lit(" status"))))
    outcomes = j.select("task_id", F.col("status").alias("previous_status"), outcome.alias("outcome"),
                        message.alias("message"))
    done = outcomes.filter(F.col("outcome") == "cancelled").select("task_id", F.lit(True).alias("_c"))
    ledger = (counted(tasks.join(done, "task_id", "left"), F.col("_c"), affected)
              .withColumn("status", F.when(F.col("_c"), "cancelled").otherwise(F.col("status")))
              .drop("_c").select(*tasks.columns))
    return ledger, outcomes


def _claimed(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Results beside status and owner of their task; ``reason`` says why a result is not eligible."""
    return results.join(tasks.selectExpr("task_id", "status AS _cur", "worker_id AS _owner"), "task_id", "left").withColumn("reason", F.expr(
        "CASE WHEN _cur IS NULL THEN 'not_found' WHEN _cur <> 'processing' THEN concat('status ', _cur) "
        "WHEN worker_id IS NOT NULL AND NOT worker_id <=> _owner THEN 'worker mismatch' END"))


def result_outcomes(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """J3 outcome per worker result: ``reason`` is NULL when accepted, else why it was rejected.
    Results (task_id, result_id, ts, status completed|failed, worker_id?, result_path?,
    error_message?) are eligible only when the task is processing and, if a worker is named, owned by
    it; of the eligible results of a task the first (by ts, result_id) is accepted, so a result from the
    wrong worker never blocks the owner's. ``result_id`` must be unique per message (it is the message
    id); redelivered copies of one message are the caller's ``dropDuplicates(["result_id"])``."""
    j = _claimed(tasks, results)
    first = j.filter("reason IS NULL").groupBy("task_id").agg(F.expr("min_by(result_id, struct(ts, result_id)) AS _first"))
    late = F.expr("CASE WHEN reason IS NULL AND result_id <> _first THEN 'duplicate' ELSE reason END")
    return j.join(first, "task_id", "left").withColumn("reason", late).drop("_first", "_cur", "_owner")


def apply_results(tasks: DataFrame, results: DataFrame, affected=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Returns ``(ledger', accepted, rejected)``; accepted + rejected = input. Callers that
    need both sides should persist ``result_outcomes`` once and split it."""
    out = result_outcomes(tasks, results)
    accepted, rejected = out.filter("reason IS NULL").drop("reason"), out.filter("reason IS NOT NULL")
    # the accepted result of a task is its first eligible one, which an aggregate finds without joining it back to the results
    upd = (_claimed(tasks, results).filter("reason IS NULL").groupBy("task_id")
           .agg(F.expr("min_by(struct(status AS _new, ts AS _ts, result_path AS _rp, error_message AS _err), struct(ts, result_id)) AS _u"))
           .select("task_id", "_u.*"))
    new = {"status": "coalesce(_new, status) AS status",
           "completed_at": "CASE WHEN _new IS NOT NULL THEN _ts ELSE completed_at END AS completed_at",
           "result_path": "CASE WHEN _new = 'completed' THEN coalesce(_rp, result_path) ELSE result_path END AS result_path",
           "error_message": "CASE WHEN _new = 'failed' THEN coalesce(_err, error_message) ELSE error_message END AS error_message"}
    ledger = counted(tasks.join(upd, "task_id", "left"), F.col("_new").isNotNull(), affected)
    return ledger.selectExpr(*[new.get(c, f"`{c}`") for c in tasks.columns]), accepted, rejected


def missing_results(tasks: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Completed tasks whose results cannot be served: NULL path (cleaned up) or a path with no
    files on record (directory does not exist, found by anti join)."""
    done = tasks.filter(F.col("status") == "completed").select("task_id", "result_path")
    cleaned = done.filter(F.col("result_path").isNull()).withColumn("reason", F.lit(C.MSG_CLEANED))
    absent = (done.filter(F.col("result_path").isNotNull())
              .join(artifacts.select("task_id"), "task_id", "left_anti")
              .withColumn("reason", F.lit(C.MSG_NO_DIR)))
    return cleaned.unionByName(absent)


def wait_deadline(events: DataFrame, seconds: int = 600) -> DataFrame:
    """K7 (batch): per task, did a terminal event arrive within ``seconds`` of the first submit?
    Equality counts as reached (the client checks terminal before timeout). Partial aggregation
    makes it safe for tasks with very many events."""
    op = F.col("op")
    agg = events.groupBy("task_id").agg(F.min(F.when(op == "submit", F.col("ts"))).alias("submitted_at"))
    term = (events.filter(op.isin("complete", "fail", "cancel"))
            .join(agg.select("task_id", "submitted_at"), "task_id")
            .filter(F.col("ts") >= F.col("submitted_at"))
            .groupBy("task_id").agg(F.min("ts").alias("terminal_at")))
    out = agg.filter(F.col("submitted_at").isNotNull()).join(term, "task_id", "left")
    waited = F.timestamp_diff("MICROSECOND", "submitted_at", "terminal_at")
    reached = F.coalesce(waited <= F.lit(seconds * 1_000_000), F.lit(False))
    return out.select("task_id", "submitted_at", "terminal_at",
                      F.when(reached, "reached").otherwise("timeout").alias("outcome"))


def queue_depth(tasks: DataFrame) -> DataFrame:
    """Pending / processing depth per minute from the ledger's transition times (+1 at
    submit, pending->processing at start, -1 at finish). Deltas are pre-aggregated per minute, then
    running totals are taken over minutes with the chunked ``running_sum`` (no single-partition
    window). Cancelled rows carry no exit time and are left out."""
    from ..plans.scale import running_sum

    steps = F.array(*[F.struct(F.date_trunc("minute", c).alias("minute"), F.lit(dp).alias("dp"), F.lit(dr).alias("dr"))
                      for c, dp, dr in (("created_at", 1, 0), ("started_at", -1, 1), ("completed_at", 0, -1))])
    d = (tasks.filter(F.col("status") != "cancelled").select(F.inline(steps))
         .filter(F.col("minute").isNotNull() | (F.col("dp") == 1)))  # one scan; steps not taken yet fall away
    m = d.groupBy("minute").agg(F.sum("dp").alias("pending_delta"), F.sum("dr").alias("processing_delta"))
    m = running_sum(m, [], ["minute"], {"pending_depth": "pending_delta", "processing_depth": "processing_delta"})
    return m.select("minute", "pending_delta", "processing_delta", "pending_depth", "processing_depth")


def counted(df: DataFrame, changed: Column, affected=None) -> DataFrame:
    """``affected`` (an ``Observation``) counts the rows of a new ledger that a mutation changed, in the pass
    that writes it. The count stands on the mutation's last step, behind every join, so a lost executor's
    earlier stages may run again without counting twice. Read ``affected.get["affected_rows"]`` after the action."""
    return df if affected is None else df.observe(affected, F.count_if(changed).alias("affected_rows"))


def observed(df: DataFrame, changed: Column, name: str):
    """Attach an ``Observation`` counting the rows a mutation changed; returns both."""
    obs = Observation(name)
    return counted(df, changed, obs), obs


def reset_stale_observed(tasks: DataFrame, now, minutes: int = 60):
    """U3 + G7: ``(ledger', observation)``; ``observation.get['affected_rows']`` after an action."""
    stale = F.coalesce((F.col("status") == "processing") & (F.col("started_at") < C.minutes_before(_ts(now), minutes)),
                       F.lit(False))
    flagged = tasks.withColumn("_chg", stale)
    out, obs = observed(flagged, F.col("_chg"), "reset_stale")
    return reset_stale(out.drop("_chg"), now, minutes), obs


def purge_records_observed(tasks: DataFrame, now, days: int = 30):
    """U5 + G7: rows deleted are counted on the way through the filter."""
    cond = F.coalesce(F.col("status").isin("completed", "failed") & (F.col("completed_at") < C.days_before(_ts(now), days)),
                      F.lit(False))
    out, obs = observed(tasks, cond, "purge_records")
    return purge_records(out, now, days), obs
