"""Streams against their batch twins and the stale timer (K4)."""

import contextlib
import datetime as dt
import os
import tempfile
import threading

from scriptorium.streaming import jobs as J

SCHEMA = "event_id long, task_id string, ts timestamp_ntz, op string, worker_id string"


def _run(spark, rows, **kw):
    src = tempfile.mkdtemp(prefix="k4-src-")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(os.path.join(src, "d"))
    df = spark.read.parquet(os.path.join(src, "d"))
    out, ck = tempfile.mkdtemp(prefix="k4-out-"), tempfile.mkdtemp(prefix="k4-ck-")
    stream = J.live_ledger(J.file_stream(spark, os.path.join(src, "d"), df.schema), **kw)
    J.run_available_now(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck))
    return spark.read.parquet(out)


def test_stale_timer_resets_silent_task(spark):
    t0 = dt.datetime(2024, 1, 1, 8, 0)
    rows = [
        (1, "a", t0, "submit", None), (2, "a", t0 + dt.timedelta(minutes=1), "claim", "w1"),
        (3, "b", t0, "submit", None), (4, "b", t0 + dt.timedelta(minutes=1), "claim", "w2"),
        (5, "b", t0 + dt.timedelta(minutes=30), "complete", "w2"),
        # later traffic moves the watermark past a's deadline (claim + 60 min)
        (6, "c", t0 + dt.timedelta(hours=3), "submit", None),
    ]
    out = _run(spark, rows, stale_timer=True)
    got = {(r.task_id, r.op, r.status) for r in out.collect()}
    assert ("a", "timeout_reset", "pending") in got
    assert not any(r.task_id == "b" and r.op == "timeout_reset" for r in out.collect())
    fin = {r.task_id: (r.status, r.retry_count) for r in J.final_states(out).collect()}
    assert fin["a"] == ("pending", 1) and fin["b"] == ("completed", 0)


def test_late_completion_rejected_without_timer(spark):
    t0 = dt.datetime(2024, 1, 1, 8, 0)
    rows = [(1, "a", t0, "submit", None), (2, "a", t0 + dt.timedelta(minutes=1), "claim", "w1"),
            (3, "a", t0 + dt.timedelta(minutes=90), "reset", None),
            (4, "a", t0 + dt.timedelta(minutes=91), "claim", "w2"),
            (5, "a", t0 + dt.timedelta(minutes=95), "complete", "w1")]
    out = {r.event_id: r.applied for r in _run(spark, rows).collect()}
    assert out == {1: True, 2: True, 3: True, 4: True, 5: False}


def test_state_carried_across_micro_batches_equals_batch(spark):
    """Events arriving in time order over several micro-batches give the batch fold's result."""
    import time

    from pyspark.sql import functions as F

    from scriptorium.operators.transitions import fold_transitions
    from scriptorium.plans import fixtures as fx

    ev = fx.task_events(spark, "/root/testdata/sf0.001")
    bounds = ev.approxQuantile("event_id", [0.25, 0.5, 0.75], 0.0)  # event ids follow time order
    src = tempfile.mkdtemp(prefix="k2-multi-")
    edges = [None, *bounds, None]
    for lo, hi in zip(edges[:-1], edges[1:]):
        part = ev
        if lo is not None:
            part = part.filter(F.col("event_id") > lo)
        if hi is not None:
            part = part.filter(F.col("event_id") <= hi)
        part.coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # file modification times order the micro-batches
    out, ck = tempfile.mkdtemp(prefix="k2m-out-"), tempfile.mkdtemp(prefix="k2m-ck-")
    stream = J.live_ledger(J.file_stream(spark, src, spark.read.parquet(src).schema, max_files=1))
    J.run_available_now(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck))
    got = {tuple(r) for r in J.final_states(spark.read.parquet(out)).collect()}
    exp = {tuple(r) for r in fold_transitions(ev).collect()}
    assert got == exp


def _scrambled_run(spark, order):
    """sf0.01 events in four time slices; in the day after each slice boundary the odd event ids
    arrive one micro-batch early (disorder within the 2-day watermark delay). A far-future sentinel
    event of another task finally moves the watermark past every real event."""
    import datetime as dt
    import time

    from pyspark.sql import functions as F

    from scriptorium.plans import fixtures as fx

    ev = fx.task_events(spark, "/root/testdata/sf0.01")
    b = ev.approxQuantile("event_id", [0.25, 0.5, 0.75], 0.0)
    bounds = [ev.filter(F.col("event_id") > x).agg(F.min("ts")).first()[0] for x in b]
    edges = [None, *bounds, None]
    slices = []
    for lo, hi in zip(edges[:-1], edges[1:]):
        c = F.lit(True)
        if lo is not None:
            c = c & (F.col("ts") >= lo)
        if hi is not None:
            c = c & (F.col("ts") < hi)
        slices.append(ev.filter(c))
    files = []
    for k, sl in enumerate(slices):
        part = sl
        if k > 0:  # odd ids of this slice's first day went out with the previous file
            part = part.filter(~((F.col("ts") < bounds[k - 1] + dt.timedelta(days=1)) & (F.col("event_id") % 2 == 1)))
        if k < 3:
            nxt = slices[k + 1].filter((F.col("ts") < bounds[k] + dt.timedelta(days=1)) & (F.col("event_id") % 2 == 1))
            part = part.unionByName(nxt)
        files.append(part)
    max_ts = ev.agg(F.max("ts")).first()[0]
    files.append(spark.createDataFrame([(10**12, "sentinel", max_ts + dt.timedelta(days=10), "submit", None)], ev.schema))
    src = tempfile.mkdtemp(prefix="k2-et-")
    for f in files:
        f.coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    out, ck = tempfile.mkdtemp(prefix="k2et-out-"), tempfile.mkdtemp(prefix="k2et-ck-")
    stream = J.live_ledger(J.file_stream(spark, src, ev.schema, max_files=1), order=order, watermark="2 days")
    J.run_available_now(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck))
    got = {tuple(r) for r in J.final_states(spark.read.parquet(out)).filter("task_id <> 'sentinel'").collect()}
    return got, ev


def test_event_time_order_handles_early_arrivals(spark):
    from scriptorium.operators.transitions import fold_transitions

    got, ev = _scrambled_run(spark, "event_time")
    exp = {tuple(r) for r in fold_transitions(ev).collect()}
    assert got == exp
    arrival, _ = _scrambled_run(spark, "arrival")
    assert arrival != exp  # the disorder is real: applying in arrival order gives other states


def test_ingest_sink_is_idempotent_on_replay(spark):
    """Replaying the same input (fresh checkpoint, same output) rewrites the same batch folders."""
    from scriptorium.plans.registry_documents import docs_in

    src = J.stage(docs_in(spark, "/root/testdata/sf0.001"), "docs-replay", partitions=3)
    out = tempfile.mkdtemp(prefix="k1-out-")
    J.ingest_stream(spark, src, out, tempfile.mkdtemp(prefix="k1-ck-"), max_files=1)
    first = spark.read.parquet(out).count()
    J.ingest_stream(spark, src, out, tempfile.mkdtemp(prefix="k1-ck-"), max_files=1)
    again = spark.read.parquet(out)
    assert again.count() == first == spark.read.parquet(src).count()
    assert again.select("doc_id").distinct().count() == first


def test_late_events_are_reported_and_redeliveries_dropped(spark):
    import time

    t0 = dt.datetime(2024, 1, 1, 8, 0)
    m = lambda n: t0 + dt.timedelta(minutes=n)
    batches = [[(1, "a", t0, "submit", None), (2, "a", m(1), "claim", "w"), (2, "a", m(1), "claim", "w")],
               [(3, "b", m(300), "submit", None)],
               [(4, "a", m(2), "complete", "w"), (5, "a", m(301), "complete", "w"), (5, "a", m(301), "complete", "w")],
               [(5, "a", m(301), "complete", "w")]]
    src, out, ck = (tempfile.mkdtemp(prefix="late-") for _ in range(3))
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    stream = J.live_ledger(J.file_stream(spark, src, spark.read.parquet(src).schema, max_files=1), report_late=True)
    J.run_available_now(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck))
    got = sorted((r.event_id, r.applied, r.previous_status, r.status) for r in spark.read.parquet(out).collect())
    assert got == [(1, True, None, "pending"), (2, True, "pending", "processing"), (3, True, None, "pending"),
                   (4, False, "processing", "processing"), (5, True, "processing", "completed")]


def test_finished_tasks_leave_the_state(spark):
    """After the retention a submit of the same id is a new task, whose counts start again."""
    import time

    t0 = dt.datetime(2024, 1, 1)
    h = lambda n: t0 + dt.timedelta(hours=n)
    for order in ("arrival", "event_time"):
        src, out, ck = (tempfile.mkdtemp(prefix="keep-") for _ in range(3))
        for rows in ([(1, "a", h(0), "submit", None), (2, "a", h(0.1), "cancel", None), (3, "b", h(0), "submit", None)],
                     [(4, "c", h(2), "submit", None)], [(5, "a", h(3), "submit", None)],
                     [(6, "c", h(100), "claim", "w")], [(7, "a", h(110), "submit", None), (8, "b", h(110), "submit", None)],
                     [(9, "z", h(500), "submit", None)]):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
            time.sleep(1.1)
        stream = J.live_ledger(J.file_stream(spark, src, spark.read.parquet(src).schema, max_files=1), order=order, retain_hours=24)
        J.run_available_now(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck))
        got = {r.event_id: r.applied for r in spark.read.parquet(out).collect()}
        assert {k: got[k] for k in (1, 2, 5, 7, 8)} == {1: True, 2: True, 5: False, 7: True, 8: False}, order


# ------------------------------------------------------------------ list state and timers

STATE_EVENTS = "event_id long, task_id string, ts timestamp_ntz, op string, worker_id string"


def _replay(spark, tmp_path, batches, job):
    """Write one file per micro-batch, in order, and run the stream over them one by one."""
    import time

    from scriptorium.streaming import jobs as J

    src = tmp_path / "events"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, STATE_EVENTS).coalesce(1).write.mode("append").parquet(str(src))
        time.sleep(0.05)
    schema = spark.read.parquet(str(src)).schema
    stream = job(J.file_stream(spark, str(src), schema, max_files=1))
    J.run_available_now(stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
                        .option("checkpointLocation", str(tmp_path / "ckpt")).outputMode("append"))
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))


def _at(minutes, day=1):
    import datetime as dt

    return dt.datetime(2024, 1, day) + dt.timedelta(minutes=minutes)


def test_deadline_whatever_the_order(spark, tmp_path):
    """A terminal event one micro-batch before its submit, an earlier submit that comes later, equality, silence."""
    from scriptorium.operators.ledger import wait_deadline
    from scriptorium.streaming.state import wait_deadline_stream

    batches = [
        [(1, "early", _at(5), "complete", None), (2, "again", _at(12), "submit", None), (3, "equal", _at(0), "submit", None),
         (4, "silent", _at(1), "submit", None), (5, "orphan", _at(2), "fail", None), (6, None, _at(1), "submit", None)],
        [(7, "early", _at(1), "submit", None), (8, "again", _at(1), "submit", None), (9, "again", _at(13), "complete", None),
         (10, "equal", _at(10), "cancel", None)],
        [(11, "clock", _at(0, 3), "claim", None), (12, "late", _at(0, 3), "submit", None)],
        [(13, "early", _at(0, 4), "submit", None), (14, "early", _at(1, 4), "complete", None), (15, "clock", _at(0, 5), "claim", None)],
    ]
    got = {(r.task_id, r.submitted_at, r.outcome)
           for r in _replay(spark, tmp_path, batches, lambda e: wait_deadline_stream(e, 600, watermark="1 hour")).collect()}
    events = spark.createDataFrame([r for b in batches for r in b], STATE_EVENTS)
    want = {(r.task_id, r.submitted_at, r.outcome) for r in wait_deadline(events.filter("event_id < 13 or event_id > 14"), 600).collect()}
    assert got == want | {(None, _at(1), "timeout")}
    assert ("early", _at(1), "reached") in got and ("again", _at(1), "timeout") in got and ("equal", _at(0), "reached") in got


def test_deadline_and_ledger_state_is_removed(spark, tmp_path):
    """A decided or finished task is forgotten after its retention: a later submit starts anew."""
    from scriptorium.streaming.state import ordered_ledger, wait_deadline_stream

    batches = [[(1, "a", _at(0), "submit", None)], *[[(i, "x", _at(i, 5), "claim", None)] for i in (2, 3, 4)], [(5, "a", _at(0, 5), "submit", None)],
               [(6, "x", _at(0, 9), "claim", None)], [(7, "x", _at(0, 10), "claim", None)]]
    rows = _replay(spark, tmp_path / "k7", batches, lambda e: wait_deadline_stream(e, 600, watermark="1 hour", retain_hours=24)).collect()
    assert sorted((r.task_id, r.submitted_at) for r in rows) == [("a", _at(0)), ("a", _at(0, 5))]
    batches = [[(1, "a", _at(0), "submit", None), (2, "a", _at(1), "claim", "w"), (3, "a", _at(2), "complete", "w")],
               [(4, "x", _at(0, 5), "claim", None)], [(5, "a", _at(0, 5), "submit", None)], [(6, "x", _at(0, 9), "claim", None)]]
    rows = _replay(spark, tmp_path / "k2", batches, lambda e: ordered_ledger(e, watermark="1 hour", retain_hours=24)).orderBy("event_id").collect()
    assert [(r.event_id, r.applied, r.status) for r in rows if r.task_id == "a"] == [
        (1, True, "pending"), (2, True, "processing"), (3, True, "completed"), (5, True, "pending")]


def test_stale_timer_and_refused_completion_out_of_order(spark, tmp_path):
    """The timer resets before a later claim is applied, and the first worker's completion comes too late (K4, K5)."""
    from scriptorium.streaming.state import TIMEOUT_RESET, ordered_ledger, rejected_completions

    batches = [[(4, "a", _at(95), "complete", "w0"), (2, "a", _at(10), "claim", "w0")], [(1, "a", _at(0), "submit", None), (3, "a", _at(90), "claim", "w1")],
               [(5, "x", _at(0, 3), "claim", None)], [(6, "x", _at(0, 4), "claim", None)]]
    out = _replay(spark, tmp_path, batches, lambda e: ordered_ledger(e, auto_reset=True, watermark="6 hours"))
    rows = [(r.event_id, r.ts, r.op, r.applied, r.status, r.worker_id) for r in out.filter("task_id = 'a'").orderBy("ts").collect()]
    assert rows == [(1, _at(0), "submit", True, "pending", None), (2, _at(10), "claim", True, "processing", "w0"),
                    (-1, _at(70), TIMEOUT_RESET, True, "pending", None), (3, _at(90), "claim", True, "processing", "w1"),
                    (4, _at(95), "complete", False, "processing", "w1"), (-1, _at(150), TIMEOUT_RESET, True, "pending", None)]
    assert [tuple(r) for r in rejected_completions(out).collect()] == [(4, "a", _at(95), "complete", "processing")]


def test_ingest_tree_over_batches_new_files_and_a_lost_checkpoint(spark, tmp_path):
    tree, out = tmp_path / "tree", str(tmp_path / "out")

    def put(name, data):
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_bytes(data)

    for i in range(7):
        put(f"a{i % 2}/doc{i}.txt", b"# one\ntwo %d" % i)
    put("doc9.json", b"{")
    put("a0/empty.txt", b"")
    J.ingest_tree(spark, str(tree), out, str(tmp_path / "c1"), "2024-01-01 00:00:00", max_files=3)
    first = {r.task_id: r for r in J.read_ingested(spark, out)[0].collect()}
    assert len(first) == 8 and len(list((tmp_path / "out/ledger").rglob("_SUCCESS"))) >= 3
    assert sorted(r.status for r in first.values()) == ["completed"] * 7 + ["failed"]
    put("a1/doc8.csv", b"x,y\n1,2")
    J.ingest_tree(spark, str(tree), out, str(tmp_path / "c1"), "2024-01-02 00:00:00", max_files=3)  # goes on
    J.ingest_tree(spark, str(tree), out, str(tmp_path / "c2"), "2024-01-03 00:00:00")  # all files again
    ledger, results = J.read_ingested(spark, out)
    again = {r.task_id: r for r in ledger.collect()}
    assert len(again) == 9 and all(again[k] == r for k, r in first.items())
    assert sorted(str(r.created_at)[:10] for r in again.values()) == ["2024-01-01"] * 8 + ["2024-01-02"]
    assert results.count() == 9 and results.filter("markdown like '| x | y |%'").count() == 1


@contextlib.contextmanager
def _progress(spark):
    """The progress of one stream that runs inside, whole once the block has ended."""
    from pyspark.sql.streaming import StreamingQueryListener

    seen, ended = [], threading.Event()

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event):
            pass

        def onQueryProgress(self, event):
            seen.append(event.progress)

        def onQueryIdle(self, event):
            pass

        def onQueryTerminated(self, event):
            ended.set()

    listener = Listener()
    spark.streams.addListener(listener)
    try:
        yield seen
        ended.wait(30)
    finally:
        spark.streams.removeListener(listener)


def test_tasks_share_the_keys_of_the_state(spark, tmp_path, monkeypatch):
    """Sixty tasks (one NULL) in four keys, out of order: the batch fold and deadlines, each task by its own time."""
    from scriptorium.operators.ledger import wait_deadline
    from scriptorium.operators.transitions import fold_transitions
    from scriptorium.streaming import state as KS

    monkeypatch.setattr(KS, "BUCKETS", 4, raising=False)
    names = [None, *(f"t{i}" for i in range(59))]
    ops = [(1, 5, "claim", "w0"), (0, 0, "submit", None), (2, 9 + 90, "complete", "w0"), (3, 200, "fail", "w0")]
    rows = [(10 * i + n, name, _at(m + 7 * i), op, w) for i, name in enumerate(names) for n, m, op, w in ops]
    clock = [[(10_000 + i, "clock", _at(0, 10 + i), "claim", None)] for i in range(2)]
    ledger = lambda e: KS.ordered_ledger(e, watermark="3 days")
    with _progress(spark) as seen:
        out = _replay(spark, tmp_path / "k5", [rows[::2], rows[1::2], *clock], ledger)
    assert max(p.stateOperators[0].numRowsTotal for p in seen) <= 4
    events = spark.createDataFrame(rows, STATE_EVENTS)
    got = {tuple(r) for r in J.final_states(out.filter("event_id < 10000")).collect()}
    assert got == {tuple(r) for r in fold_transitions(events).collect()} and len(got) == 60
    with _progress(spark) as seen:
        out = _replay(spark, tmp_path / "k7", [rows[::2], rows[1::2], *clock], lambda e: KS.wait_deadline_stream(e, 600, watermark="3 days"))
    assert max(p.stateOperators[0].numRowsTotal for p in seen) <= 4
    assert ({(r.task_id, r.submitted_at, r.outcome) for r in out.collect()}
            == {(r.task_id, r.submitted_at, r.outcome) for r in wait_deadline(events, 600).collect()})


def test_ingest_tree_reads_a_batch_twice_and_lists_in_few_tasks(spark, tmp_path):
    """Once with contents, once without; new files are not listed in a task each."""
    (tmp_path / "tree").mkdir()
    for i in range(80):
        (tmp_path / f"tree/doc{i}.txt").write_bytes(b"# one")
    with _progress(spark) as seen:
        J.ingest_tree(spark, str(tmp_path / "tree"), str(tmp_path / "out"), str(tmp_path / "ckpt"), "2024-01-01 00:00:00")
    assert sum(p.numInputRows for p in seen) == 2 * 80
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup(str(seen[0].runId)) for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(info.numTasks for info in map(tracker.getStageInfo, stages) if info) < 80
    assert J.read_ingested(spark, str(tmp_path / "out"))[0].filter("status = 'completed'").count() == 80


def test_ingest_tree_plans_a_micro_batch_cheaply(spark, tmp_path, monkeypatch):
    """r04 F2: the routing expressions (some 2,000 calls to the JVM) were made anew for each micro-batch, and the ledger took four joins."""
    from scriptorium.operators import ledger as L

    made, ledgers, converter_for, apply_results = [], [], J.D.converter_for, L.apply_results

    def applied(*a, **k):
        out = apply_results(*a, **k)
        ledgers.append(out[0]._jdf.queryExecution().optimizedPlan().toString())
        return out

    monkeypatch.setattr(J.D, "converter_for", lambda *a: made.append(1) or converter_for(*a))
    monkeypatch.setattr(L, "apply_results", applied)
    (tmp_path / "tree").mkdir()
    for i in range(6):
        (tmp_path / f"tree/doc{i}.txt").write_bytes(b"# one")
    J.ingest_tree(spark, str(tmp_path / "tree"), str(tmp_path / "out"), str(tmp_path / "ckpt"), "2024-01-01 00:00:00", max_files=2)
    assert len(ledgers) == 3 and all(p.count("Join ") == 2 for p in ledgers)
    assert len(made) == 1
    assert J.read_ingested(spark, str(tmp_path / "out"))[0].filter("status = 'completed'").count() == 6


def test_affected_rows_of_every_mutation(spark):
    from pyspark.sql import Observation

    from scriptorium.operators import ledger as L
    from scriptorium.plans import fixtures as fx
    t = fx.tasks(spark, "/root/testdata/sf0.001")
    none, some = Observation("none"), Observation("some")
    assert L.retire_artifacts(t, fx.AS_OF, 7, affected=none)[0].count() == t.count() and none.get["affected_rows"] == 0
    ledger, claims = L.claim_batch(t, ["a", "b"], 5, fx.AS_OF, affected=some)
    ledger.write.format("noop").mode("overwrite").save()
    assert some.get["affected_rows"] == claims.count() == 5


def _state_keys(spark, ckpt):
    """Keys that the ledger's state has had at most, over its micro-batches."""
    batches = [int(f) for f in os.listdir(ckpt / "commits") if f.isdigit()]
    read = [spark.read.format("statestore").option("batchId", b).option("operatorId", i).load(str(ckpt)) for b in batches for i in (0, 1)]
    return max(df.select("key").distinct().count() for df in read if df.schema["key"].dataType.names != ["event_id"])


def test_live_ledger_deals_tasks_over_few_keys(spark, tmp_path, monkeypatch):
    """a call for each task in each micro-batch. Sixty tasks (one NULL) in four keys: the batch fold, each task by its own time."""
    from scriptorium.operators.transitions import fold_transitions

    monkeypatch.setattr(J, "BUCKETS", 4, raising=False)
    names = [None, *(f"t{i}" for i in range(59))]
    ops = [(1, 5, "claim", "w0"), (0, 0, "submit", None), (2, 9 + 90, "complete", "w0"), (3, 200, "fail", "w0")]
    rows = [(10 * i + n, name, _at(m + 7 * i), op, w) for i, name in enumerate(names) for n, m, op, w in ops]
    clock = [[(10_000 + i, "clock", _at(0, 10 + i), "claim", None)] for i in range(2)]
    fold = {tuple(r) for r in fold_transitions(spark.createDataFrame(rows, STATE_EVENTS)).collect()}
    cases = {"waits": ([rows[::2], rows[1::2] + rows[:20], *clock], dict(order="event_time", watermark="3 days")),
             "arrives": ([rows[:120], rows[120:], *clock], dict(watermark="3 days"))}
    for name, (batches, options) in cases.items():
        out = _replay(spark, tmp_path / name, batches, lambda e, options=options: J.live_ledger(e, **options))
        assert {tuple(r) for r in J.final_states(out.filter("event_id < 10000")).collect()} == fold and len(fold) == 60
        assert _state_keys(spark, tmp_path / name / "ckpt") <= 4


def test_a_bucket_keeps_large_ids_beside_null_ones(spark, tmp_path, monkeypatch):
    """tasks that share a key share its pandas frames, where a null id would turn the others into floats."""
    monkeypatch.setattr(J, "BUCKETS", 1, raising=False)
    rows = [((1 << 53) + 1, "a", _at(0), "submit", None), (None, "b", _at(1), "submit", None), ((1 << 53) + 3, "c", _at(2), "claim", "w1")]
    out = _replay(spark, tmp_path, [rows], lambda e: J.live_ledger(e, watermark="3 days"))
    assert {(r.event_id, r.task_id, r.ts, r.applied) for r in out.collect()} == {
        ((1 << 53) + 1, "a", _at(0), True), (None, "b", _at(1), True), ((1 << 53) + 3, "c", _at(2), False)}
