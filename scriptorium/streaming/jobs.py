"""Structured Streaming jobs.

Every job is a ``readStream -> transformations -> writeStream`` with a checkpoint in the shared
folder; tests and the registry run them with ``availableNow`` and read the sink back. Event times
in the inputs are TIMESTAMP_NTZ, which watermarks reject, so they are cast to TIMESTAMP (session
time zone UTC) on the way in and back on the way out.
"""

from __future__ import annotations

import hashlib
import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions import columns as C
from ..functions.columns import TERMINAL_STATUSES
from ..operators import documents as D
from ..operators import ledger as L
from ..operators.transitions import new_state, transition  # shared transition table
from ..plans.scale import next_match
from ..session import scratch_path

TOPIC_SCHEMA = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("value", T.StringType()),
    T.StructField("topic", T.StringType()), T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()), T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("timestampType", T.IntegerType()),
])
# fixed values: largest message, retention by age and by size
MESSAGE_MAX_BYTES = 5_242_880
RETENTION_HOURS, RETENTION_BYTES = 72, 1 << 30
POLL = "500 milliseconds"


def run_available_now(stream_writer, timeout_s: int | None = None) -> None:
    """Run a stream over what is available; waits without limit unless the caller sets one."""
    q = stream_writer.trigger(availableNow=True).start()
    if timeout_s is None:
        q.awaitTermination()
    elif not q.awaitTermination(timeout_s):
        q.stop()
        raise TimeoutError("stream did not finish")
    if q.exception() is not None:
        raise q.exception()


def file_stream(spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None,
                max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def _quiet_workers() -> None:
    """pandas warns (FutureWarning) when PySpark's state serializer concatenates the empty frames
    of groups that emit nothing; harmless, but one line per group in the executor logs."""
    import warnings

    warnings.filterwarnings("ignore", category=FutureWarning, module="pyspark")


def _ltz(c: str):
    return F.col(c).cast("timestamp")


# ------------------------------------------------------------------ K3 / K8 (windowed counts)

def queue_monitor(events: DataFrame, every: str = "300 seconds", watermark: str = "10 minutes") -> DataFrame:
    """K3: counts per event type and tumbling window; append mode emits a window once the
    watermark (max event time - delay) has passed its end."""
    e = events.withColumn("ts", _ltz("ts")).withWatermark("ts", watermark)
    return (e.groupBy(F.window("ts", every), "event_type").count()
            .select(F.col("window.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("window.end").cast("timestamp_ntz").alias("window_end"), "event_type", "count"))


def heartbeat_windows(events: DataFrame, every: str = "900 seconds", watermark: str = "15 minutes") -> DataFrame:
    """K8 (stream form): events per worker and 900 s window; a worker missing from a window was
    silent for it."""
    e = events.withColumn("ts", _ltz("ts")).withWatermark("ts", watermark)
    return (e.groupBy("worker_id", F.window("ts", every)).count()
            .select("worker_id", F.col("window.start").cast("timestamp_ntz").alias("window_start"), "count"))


def silent_gaps(events: DataFrame, as_of, max_silence_seconds: int = 900) -> DataFrame:
    """K8 (batch form): every stretch longer than ``max_silence_seconds`` between consecutive events of
    one worker up to ``as_of``, and the open one since its last event (``silent_until`` NULL): a worker
    that never came back is reported too. The successor comes from ``next_match`` (range-chunked), so a
    worker with a third of all events is still spread over many tasks."""
    end = F.lit(as_of).cast("timestamp_ntz")
    e = events.filter(F.col("ts") <= end).select("worker_id", "ts", "event_id")
    nxt = next_match(e, ["worker_id"], ["ts", "event_id"], F.lit(True), ["ts"], "next_")
    gap = F.timestamp_diff("MICROSECOND", "ts", F.coalesce("next_ts", end))
    return (nxt.filter(gap > F.lit(max_silence_seconds * 1_000_000))
            .select("worker_id", F.col("ts").alias("silent_from"), F.col("next_ts").alias("silent_until")))


# ------------------------------------------------------------------ K2 (stateful ledger)

BUCKETS = 1024  # keys that tasks are dealt over
_FIELDS = ["status", "worker", "started_us", "completed_us", "retries", "applied", "rejected", "last_us"]
_BUCKET_STATE = "records string"  # the tasks of a bucket as JSON
OUTCOME = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("task_id", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()), T.StructField("op", T.StringType()),
    T.StructField("applied", T.BooleanType()), T.StructField("status", T.StringType()),
    T.StructField("worker_id", T.StringType()), T.StructField("started_at", T.TimestampNTZType()),
    T.StructField("completed_at", T.TimestampNTZType()), T.StructField("retry_count", T.LongType()),
    T.StructField("previous_status", T.StringType()),
])


def _ledger_fn(stale_minutes: int, strict: bool, stale_timer: bool = False, event_time: bool = False,
               retain_ms: int | None = None, report_late: bool = False):
    """A call for a key costs more than a task's few events, so a key is a bucket of tasks: its state is one text with a
    record for each (the fields of ``_FIELDS``, events or ids that are kept, the task's timer in milliseconds) and its
    timeout is the first of their timers. A call runs the tasks that have events or whose timer has fired."""
    import json

    stale_us = stale_minutes * 60 * 1_000_000
    timers = event_time or stale_timer or bool(retain_ms)
    cols = [f.name for f in OUTCOME.fields]

    def _frame(recs):
        out = pd.DataFrame(recs, columns=["event_id", "task_id", "ts_us", "op", "applied", "status", "worker_id",
                                          "started_us", "completed_us", "retry_count", "previous_status"])
        out["event_id"] = pd.array([r[0] for r in recs], dtype="Int64")
        for c, src in (("ts", "ts_us"), ("started_at", "started_us"), ("completed_at", "completed_us")):
            out[c] = pd.to_datetime(pd.to_numeric(out[src], errors="coerce"), unit="us")
        return out[cols]

    def _events(pdfs):
        """The events of each task."""
        found: dict = {}
        for ev in pdfs:
            ts = ev["ts"]
            if getattr(ts.dt, "tz", None) is not None:
                ts = ts.dt.tz_convert("UTC").dt.tz_localize(None)
            workers, tasks = (ev[c].astype(object).where(ev[c].notna(), None).tolist() for c in ("worker_id", "task_id"))
            ids = [None if null else i for i, null in zip(ev["event_id"].tolist(), ev["no_id"].tolist())]
            for task, *event in zip(tasks, ids, ts.astype("datetime64[us]").astype("int64").tolist(), ev["op"].tolist(), workers):
                found.setdefault(task, []).append(tuple(event))
        return found

    def _in_order(events):
        return sorted(events, key=lambda e: (e[1], e[0] is not None, e[0] or 0))

    def step(task, old, events, wm_ms, recs):
        """The record of ``task`` after ``events`` (None: its timer has fired) and its rows in ``recs``; None: no state."""
        fired = events is None
        s = dict(zip(_FIELDS, old)) if old else {**new_state(), "last_us": 0}
        held = old[-2] if old else []
        events, due_ms, first = events or [], None, len(recs)

        def record(eid, t, op, ok, before):
            recs.append((eid, task, t, op, ok, s["status"], s["worker"], s["started_us"], s["completed_us"], s["retries"], before))

        def apply(batch):
            for eid, t, op, w in _in_order(batch):
                if retain_ms and s["status"] in TERMINAL_STATUSES and t > s["last_us"] + retain_ms * 1000:
                    s.update(new_state())  # forgotten, whether or not its timer fired yet
                s["last_us"] = max(s["last_us"], t)
                before = s["status"]
                record(eid, t, op, transition(s, op, t, w, stale_us, strict), before)

        if event_time:
            # events wait until the watermark passes them, then apply in event-time order
            waiting = held + events
            apply([e for e in waiting if e[1] <= wm_ms * 1000])
            held = [e for e in waiting if e[1] > wm_ms * 1000]
            due_ms = min(e[1] for e in held) // 1000 if held else None
        elif report_late:
            # the ids of events ahead of the watermark are kept, so redeliveries are told from new events
            seen = dict(held)
            fresh = {e[0]: e for e in events if e[0] not in seen}
            for eid, t, op, _ in _in_order(e for e in fresh.values() if e[1] < wm_ms * 1000):
                s["rejected"] += 1
                record(eid, t, op, False, s["status"])
            apply([e for e in fresh.values() if e[1] >= wm_ms * 1000])
            seen.update((e[0], e[1]) for e in fresh.values())
            held = [x for x in seen.items() if x[1] >= wm_ms * 1000]
        else:
            apply(events)
        if stale_timer and s["status"] == "processing":
            due_ms = int((s["started_us"] + stale_us) // 1000) + 1
            if due_ms <= wm_ms:  # K4: the task sat in processing past started_at + T; no timer can be set behind the watermark
                due_us = s["started_us"] + stale_us
                s.update(status="pending", worker=None, retries=s["retries"] + 1, applied=s["applied"] + 1)
                record(-1, due_us, "timeout_reset", True, "processing")
                due_ms = None
        if retain_ms and due_ms is None and s["status"] in TERMINAL_STATUSES:
            due_ms = s["last_us"] // 1000 + retain_ms + 1
            if fired and due_ms <= wm_ms and len(recs) == first:
                return None
        return [*(s[n] for n in _FIELDS), held, None if due_ms is None else max(due_ms, wm_ms + 1)]

    def fn(key, pdfs, state):
        _quiet_workers()
        tasks = {task: record for task, *record in json.loads(state.get[0])} if state.exists else {}
        wm_ms = state.getCurrentWatermarkMs() if timers or report_late else 0
        new = {} if state.hasTimedOut else _events(pdfs)
        fired = [t for t, record in tasks.items() if timers and record[-1] is not None and record[-1] < wm_ms and t not in new]
        recs: list = []
        for task, events in [*new.items(), *((t, None) for t in fired)]:
            record = step(task, tasks.get(task), events, wm_ms, recs)
            if record is None:
                del tasks[task]
            else:
                tasks[task] = record
        if tasks:
            state.update((json.dumps([[task, *record] for task, record in tasks.items()]),))
            first = min((record[-1] for record in tasks.values() if record[-1] is not None), default=None)
            if timers and first is not None:
                state.setTimeoutTimestamp(first)
        elif state.exists:
            state.remove()
        if recs:
            yield _frame(recs)

    return fn


def live_ledger(events: DataFrame, stale_minutes: int = 60, strict: bool = True, stale_timer: bool = False,
                watermark: str = "10 minutes", order: str = "arrival", retain_hours: int | None = None,
                report_late: bool = False) -> DataFrame:
    """K2/K4/K5: per-event outcome of the state machine, state kept per task across micro-batches; tasks are dealt by a
    hash of their id over ``BUCKETS`` keys.
    A late completion after a reset or re-claim is rejected by the same guard as in batch (K5).
    Redelivered events (same ``event_id``) are dropped within the watermark.

    ``order="arrival"`` (default): events are applied as they arrive, sorted by (ts, event_id)
    within a micro-batch; O(1) state per task. ``order="event_time"``: events are buffered in the
    task's record until the watermark passes them and are then applied in event-time order, so
    out-of-order arrival within the watermark delay gives the batch result; the buffer is bounded by
    the task's events within that delay. With ``stale_timer`` (K4, arrival order) an event-time timer
    resets a task that stays in processing past ``started_at + stale_minutes``.

    Events behind the watermark are dropped, unless ``report_late`` (arrival order, no timers): then
    they come out as rejected rows and change no state; the state holds the ids of the task's events
    within the watermark delay. ``retain_hours`` forgets a finished task once no event came for so long, as
    U5 purges its ledger row: its state is removed, and a later submit of that id starts a new task."""
    if order not in ("arrival", "event_time"):
        raise ValueError(f"unknown order {order}")
    event_time = order == "event_time"
    if event_time and stale_timer:
        raise ValueError("stale_timer is supported with order='arrival'")
    if report_late and (event_time or stale_timer or retain_hours):
        raise ValueError("report_late is supported with order='arrival' and without timers")
    ev = events.withColumn("ts", _ltz("ts")).withWatermark("ts", watermark)
    if not report_late:
        ev = ev.dropDuplicatesWithinWatermark(["event_id"])
    out_ltz = T.StructType([T.StructField(f.name, T.TimestampType() if f.dataType == T.TimestampNTZType() else f.dataType)
                            for f in OUTCOME.fields])
    timeout = GroupStateTimeout.EventTimeTimeout if (stale_timer or event_time or retain_hours) else GroupStateTimeout.NoTimeout
    fn = _ledger_fn(stale_minutes, strict, stale_timer, event_time, retain_hours and retain_hours * 3_600_000, report_late)
    # a null id would make pandas hold the ids of its whole bucket as floats
    dealt = ev.select(F.coalesce("event_id", F.lit(0)).alias("event_id"), F.col("event_id").isNull().alias("no_id"), "task_id", "ts", "op", "worker_id",
                      F.pmod(F.xxhash64("task_id"), F.lit(BUCKETS)).alias("bucket"))
    res = dealt.groupBy("bucket").applyInPandasWithState(fn, out_ltz, _BUCKET_STATE, "append", timeout)
    return res.select(*[F.col(f.name).cast("timestamp_ntz").alias(f.name) if f.dataType == T.TimestampNTZType()
                        else F.col(f.name) for f in OUTCOME.fields])


def status_deltas(outcomes: DataFrame, every: str = "300 seconds", watermark: str = "10 minutes") -> DataFrame:
    """K3 over the live ledger: change of the number of tasks in each status per window, from the applied
    events of ``live_ledger``; in a stream, windows come out once the watermark has passed their end."""
    steps = F.inline(F.array(F.struct(F.col("status").alias("status"), F.lit(1).alias("step")),
                             F.struct(F.col("previous_status").alias("status"), F.lit(-1).alias("step"))))
    moves = (outcomes.filter("applied").withColumn("ts", _ltz("ts")).withWatermark("ts", watermark)
             .select("ts", steps).filter(F.col("status").isNotNull()))
    return (moves.groupBy(F.window("ts", every), "status").agg(F.sum("step").alias("change"))
            .select(F.col("window.end").cast("timestamp_ntz").alias("window_end"), "status", "change"))


def status_depth(deltas: DataFrame) -> DataFrame:
    """Tasks in each status at the end of every window that moved one (others keep the last depth)."""
    from ..plans.scale import running_sum

    return running_sum(deltas, ["status"], ["window_end"], "change", "depth").select("window_end", "status", "depth")


def final_states(outcomes: DataFrame) -> DataFrame:
    """Final ledger row per task from per-event outcomes (the U2 shape). ``max_by`` is a hash
    aggregate with a partial step, safe for very busy tasks."""
    last = F.max_by(F.struct("status", "worker_id", "started_at", "completed_at", "retry_count"), F.struct("ts", "event_id"))
    return (outcomes.groupBy("task_id")
            .agg(last.alias("l"), F.count_if("applied").alias("applied"), F.count_if(~F.col("applied")).alias("rejected"))
            .select("task_id", "l.status",
                    F.when(F.col("l.status").isin("processing", "completed", "failed"), F.col("l.worker_id")).alias("worker_id"),
                    "l.started_at", "l.completed_at", "l.retry_count", "applied", "rejected"))


# ------------------------------------------------------------------ K6 (topic policies), A8

def message_size_guard(topic: DataFrame, max_bytes: int = MESSAGE_MAX_BYTES) -> DataFrame:
    """``route`` = ok / dead_letter by value size; callers write the two filters to two sinks."""
    size = F.octet_length("value")
    return topic.withColumn("size", size).withColumn(
        "route", F.when(F.col("size") > max_bytes, "dead_letter").otherwise("ok"))


def topic_partition(df: DataFrame, n: int = 3, key: str = "key") -> DataFrame:
    """Partition from the first 32 bits of md5(key), modulo n."""
    return df.withColumn("partition", F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint"), F.lit(n)).cast("int"))


def topic_retention(topic: DataFrame, now, hours: int = RETENTION_HOURS, max_bytes: int = RETENTION_BYTES) -> DataFrame:
    """Keep records not older than ``hours`` (strict: older is dropped) and within the newest
    ``max_bytes`` of their partition. The per-partition byte budget is a running total from the
    newest offset, computed with ``running_sum`` (three partitions = three huge keys)."""
    from ..plans.scale import running_sum

    now_c = now if not isinstance(now, str) else F.lit(now).cast("timestamp_ntz")
    recent = topic.filter(F.col("timestamp") >= now_c - F.make_dt_interval(hours=F.lit(hours)))
    sized = recent.withColumn("_bytes", F.octet_length("value").cast("long")).withColumn("_neg_off", -F.col("offset"))
    run = running_sum(sized, ["partition"], ["_neg_off"], "_bytes", "bytes_from_newest")
    return run.filter(F.col("bytes_from_newest") <= max_bytes).drop("_bytes", "_neg_off")


def write_topic(df: DataFrame, path: str) -> None:
    """A8 sink: records in the topic envelope, one folder per partition."""
    out = df
    if "timestampType" not in out.columns:
        out = out.withColumn("timestampType", F.lit(0))
    out.select([f.name for f in TOPIC_SCHEMA.fields]).write.mode("append").partitionBy("partition").parquet(path)


def read_topic(spark: SparkSession, path: str) -> DataFrame:
    """A8 source: streaming read of a file-backed topic with the standard envelope. On a cluster
    the same envelope comes from ``readStream.format("kafka")``."""
    return spark.readStream.schema(TOPIC_SCHEMA).option("basePath", path).parquet(path)


# ------------------------------------------------------------------ K1 (ingest)

DOC_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("file_name", T.StringType()),
                           T.StructField("content", T.StringType())])


def ingest_stream(spark: SparkSession, in_path: str, out_path: str, ckpt: str, available_now: bool = True,
                  max_files: int | None = None):
    """K1: new document files -> convert -> outcomes appended per micro-batch. Each batch is
    written to its own ``batch_id=`` folder with overwrite, so a replayed batch replaces itself
    (idempotent sink)."""
    docs = file_stream(spark, in_path, DOC_SCHEMA, max_files=max_files)

    def sink(batch: DataFrame, batch_id: int):
        D.convert_documents(batch).write.mode("overwrite").parquet(os.path.join(out_path, f"batch_id={batch_id}"))

    w = docs.writeStream.foreachBatch(sink).option("checkpointLocation", ckpt)
    if available_now:
        run_available_now(w)
        return None
    return w.trigger(processingTime=POLL).start()


FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"  # of Spark's binaryFile source


def ingest_tree(spark: SparkSession, in_path: str, out_path: str, ckpt: str, now, glob: str = "*", max_files: int | None = None,
                available_now: bool = True):
    """K1 over raw files: the files of a folder tree, as they appear, are submitted (B1), claimed, converted
    and their outcomes applied (J3). Each micro-batch writes two folders, ``results`` and ``ledger``, named by
    the stream's checkpoint and the batch, so a batch that runs again replaces itself; contents are read once and
    not shuffled. A task's id follows from the file's place in the tree and its length, so a file that comes again
    (a lost checkpoint) has the same id, and ``read_ingested`` keeps its first outcome. Empty files are not
    listed by Spark's file sources. ``max_files`` bounds a micro-batch, not what is read in all."""
    base = in_path.rstrip("/").split("://")[-1] + "/"
    run = "r" + hashlib.sha256(ckpt.encode()).hexdigest()[:12]
    reader = spark.readStream.schema(FILE_SCHEMA).format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    files = (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(in_path)

    routing = D.routing(T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("file_name", T.StringType()), T.StructField("content", T.BinaryType())]))

    def sink(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        results, ledger = (os.path.join(out_path, kind, f"run={run}", f"batch_id={batch_id}") for kind in ("results", "ledger"))
        inner = F.substring_index("path", base, -1)
        files = batch.select(inner.alias("file_path"), C.basename("path").alias("file_name"), F.col("length").alias("content_length"), "content")
        tasks = (L.submit_batch(files.drop("content"), now).withColumn("status", F.lit("processing"))
                 .withColumn("started_at", F.lit(now).cast("timestamp_ntz")).withColumn("worker_id", F.lit("ingest"))
                 .coalesce(spark.sparkContext.defaultParallelism).persist())  # file entries without contents, for two joins
        content = files.select(L.task_key("file_path", "content_length").alias("doc_id"), "file_name", "content")
        outcomes = D.convert_documents(content, routing=routing).withColumnRenamed("doc_id", "task_id").withColumn("created_at", F.lit(now).cast("timestamp_ntz"))
        outcomes.write.mode("overwrite").parquet(results)
        done = spark.read.schema(outcomes.schema).parquet(results).select(
            "task_id", F.col("task_id").alias("result_id"), F.lit(now).cast("timestamp_ntz").alias("ts"), "status", F.lit("ingest").alias("worker_id"),
            F.when(F.col("status") == "completed", F.lit(results)).alias("result_path"), "error_message")
        try:
            L.apply_results(tasks, done)[0].write.mode("overwrite").parquet(ledger)
        finally:
            tasks.unpersist()

    w = files.writeStream.foreachBatch(sink).option("checkpointLocation", ckpt)
    if available_now:
        run_available_now(w)
        return None
    return w.trigger(processingTime=POLL).start()


def read_ingested(spark: SparkSession, out_path: str) -> tuple[DataFrame, DataFrame]:
    """``(ledger, results)`` of ``ingest_tree``: one row per task, its earliest."""
    def first(kind):
        rows = spark.read.parquet(os.path.join(out_path, kind))
        cols = [c for c in rows.columns if c not in ("task_id", "run", "batch_id")]
        return rows.groupBy("task_id").agg(F.min_by(F.struct(*cols), F.struct("created_at", "run", "batch_id")).alias("r")).select("task_id", "r.*")

    return first("ledger"), first("results")


def stage(df: DataFrame, label: str, partitions: int | None = None) -> str:
    """Write a derived table once to the shared folder and return its path."""
    path = scratch_path(df.sparkSession, label)
    (df.repartition(partitions) if partitions else df).write.parquet(path)
    return path


def stage_slices(df: DataFrame, label: str, slices: list, files: int) -> str:
    """Write the rows of each condition in ``slices`` one after the other, ``files`` files each, so that a
    stream with ``max_files=files`` reads about one slice per micro-batch, in this order."""
    path = scratch_path(df.sparkSession, label)
    for cond in slices:
        df.filter(cond).repartition(files).write.mode("append").parquet(path)
    return path


# ------------------------------------------------------------------ K7 (stream form)

DEADLINE_OUT = T.StructType([T.StructField("task_id", T.StringType()), T.StructField("submitted_at", T.TimestampType()),
                             T.StructField("outcome", T.StringType())])
