"""Chunked helpers and the state-machine fold against brute force, with one very hot key."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from scriptorium.operators.transitions import fold_transitions
from scriptorium.plans.scale import next_match, running_count, running_sum
from scriptorium.streaming.jobs import transition


def _events(spark, seed=1, n=600, hot_share=0.4):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    ops = ["submit", "claim", "complete", "fail", "cancel", "reset"]
    rows = []
    for i in range(n):
        task = "hot" if rnd.random() < hot_share else f"t{rnd.randint(0, 15)}"
        ts = base + dt.timedelta(minutes=rnd.randint(0, 3000))  # many equal timestamps
        w = rnd.choice(["w0", "w1", None])
        rows.append((i, task, ts, rnd.choices(ops, weights=[1, 4, 3, 2, 1, 3])[0], w))
    rnd.shuffle(rows)
    return rows


def _brute_fold(rows, stale_minutes=60, strict=True):
    out = {}
    by = {}
    for r in {r[0]: r for r in rows}.values():
        by.setdefault(r[1], []).append(r)
    for task, evs in by.items():
        s = {"status": None, "worker": None, "started_us": None, "completed_us": None, "retries": 0, "applied": 0, "rejected": 0}
        for eid, _, ts, op, w in sorted(evs, key=lambda r: (r[2], r[0])):
            transition(s, op, int(pd.Timestamp(ts).value // 1000), w, stale_minutes * 60_000_000, strict)
        done = s["status"] in ("completed", "failed")
        out[task] = (s["status"], s["worker"] if done or s["status"] == "processing" else None, _time(s["started_us"]),
                     _time(s["completed_us"]) if done else None, s["retries"], s["applied"], s["rejected"])
    return out


def _time(us):
    return None if us is None else dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=us)


EVENTS = "event_id long, task_id string, ts timestamp_ntz, op string, worker_id string"


def _folded(df, **kw):
    return {r.task_id: tuple(r)[1:] for r in fold_transitions(df, **kw).collect()}


@pytest.mark.parametrize("batch, ranges, strict", [(10_000, 1, True), (7, 5, True), (1, 3, True), (10_000, 13, False), (5, 9, False)])
def test_fold_matches_brute_force_under_skew(spark, batch, ranges, strict):
    """The same rows wherever batches and ranges cut the runs, one task holding 40% of the events."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(batch))
    try:
        for seed in (1, 2):
            rows = _events(spark, seed)
            rows += [rows[3], rows[3], (10_000, None, rows[0][2], "submit", None), (10_001, None, rows[0][2], "other", "w0")]
            assert _folded(spark.createDataFrame(rows, EVENTS), ranges=ranges, strict=strict) == _brute_fold(rows, strict=strict)
    finally:
        spark.conf.set(key, before)


def test_runs_compose_associatively():
    """Summaries of any cuts of a history, composed in any order, give the state machine's result."""
    import numpy as np
    import pyarrow as pa

    from scriptorium.operators.transitions import OP_STATUS, OPS, Batch, Run, new_state

    rnd, stale = random.Random(8), 30
    for trial in range(400):
        strict = trial % 2 == 0
        n = rnd.randint(1, 40)
        ts = sorted(rnd.randint(0, 200) for _ in range(n))
        op = [rnd.choices(range(6), weights=[1, 3, 4, 2, 1, 1])[0] for _ in range(n)]
        worker = [rnd.choice(["a", "b", None]) for _ in range(n)]
        cuts = sorted(rnd.sample(range(1, n), min(n - 1, rnd.randint(0, 6))))
        runs = [Batch(np.zeros(j - i, np.int64), np.array(ts[i:j]), np.array(op[i:j]), pa.array(worker[i:j], pa.string()), stale, strict).run(0, j - i)
                for i, j in zip([0, *cuts], [*cuts, n])]
        while len(runs) > 1:
            k = rnd.randrange(len(runs) - 1)
            runs[k:k + 2] = [Run.load(runs[k].dump()).then(Run.load(runs[k + 1].dump()), stale)]
        s = new_state()
        for t, o, w in zip(ts, op, worker):
            transition(s, OPS[o], t, w, stale, strict)
        owned, done = s["status"] in ("processing", "completed", "failed"), s["status"] in ("completed", "failed")
        assert runs[0].row("x") == ("x", s["status"], s["worker"] if owned else None, s["started_us"], s["completed_us"] if done else None,
                                    s["retries"], s["applied"], s["rejected"]), (ts, op, worker, cuts)
        assert set(OP_STATUS) == set(OPS)


def test_fold_runs_no_job_while_planned(spark):
    df = spark.createDataFrame(_events(spark), EVENTS)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("fold-plan", "plan only")
    fold_transitions(df)
    assert not tracker.getJobIdsForGroup("fold-plan")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert fold_transitions(df.limit(0)).collect() == []


def test_running_count_and_sum_brute_force(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot"] * 6 + ["a", "b", None]), i, rnd.randint(0, 50)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    got = {r.o: (r.rn, r.cum) for r in running_sum(running_count(df, ["k"], ["o"], "rn", n_chunks=7),
                                                   ["k"], ["o"], "v", "cum", n_chunks=5).collect()}
    exp = {}
    for k in {r[0] for r in rows}:
        c = s = 0
        for _, o, v in sorted([r for r in rows if r[0] == k], key=lambda r: r[1]):
            c += 1
            s += v
            exp[o] = (c, s)
    assert got == exp


def test_next_match_brute_force(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["hot"] * 7 + ["cold", None, None]), i, rnd.random() < 0.2) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, o long, m boolean")
    got = {r.o: r.nx_o for r in next_match(df, ["k"], ["o"], F.col("m"), ["o"], "nx_", n_chunks=9).collect()}
    for k, o, _ in rows:
        later = [r[1] for r in rows if r[0] == k and r[1] > o and r[2]]
        assert got[o] == (min(later) if later else None)


def test_topic_offsets_dense_per_partition(spark):
    from scriptorium.plans import fixtures as fx

    t = fx.topic(spark, "/root/testdata/sf0.001")
    agg = t.groupBy("partition").agg(F.min("offset").alias("lo"), F.max("offset").alias("hi"), F.count("*").alias("n"),
                                     F.countDistinct("offset").alias("d")).collect()
    for r in agg:
        assert r.lo == 0 and r.hi == r.n - 1 and r.d == r.n


def test_several_running_sums_in_one_pass(spark):
    rows = [("k" if i % 5 else "j", i, i % 7, 1 - (i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, o long, a long, b long")
    got = {r.o: (r.sa, r.sb) for r in running_sum(df, ["k"], ["o"], {"sa": "a", "sb": "b"}, n_chunks=6).collect()}
    acc = {}
    for k, o, a, b in rows:
        sa, sb = acc.get(k, (0, 0))
        acc[k] = (sa + a, sb + b)
        assert got[o] == acc[k]


def test_large_integers_beside_nulls(spark):
    """Values beyond 2^53 stay exact beside NULLs: as passed through, summed and carried as payload."""
    big = 9007199254740993
    rows = [(None if i % 3 == 0 else "k", i, None if i % 2 else big + i) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    acc = {}
    got = {r.o: (r.v, r.cum) for r in running_sum(df, ["k"], ["o"], "v", "cum", n_chunks=4).collect()}
    for k, o, v in rows:
        acc[k] = acc.get(k, 0) + (v or 0)
        assert got[o] == (v, acc[k])
    nxt = {r.o: r.nx_v for r in next_match(df, ["k"], ["o"], F.col("o") % 5 == 0, ["v"], "nx_", n_chunks=4).collect()}
    for k, o, _ in rows:
        later = [v for kk, oo, v in rows if kk == k and oo > o and oo % 5 == 0]
        assert nxt[o] == (later[0] if later else None)


def test_empty_input(spark):
    df = spark.createDataFrame([], "k string, o long, v long")
    assert running_sum(df, ["k"], ["o"], "v", "cum").count() == 0
    assert next_match(df, [], ["o"], F.col("v") > 0, ["v"], "nx_").count() == 0
