"""Keyed state machines over streams with event-time timers (K2, K4, K5, K7).

Events of a task wait in its state until the watermark has passed them and are then applied in event-time order,
whatever order and micro-batch they came in. One time per task wakes it for the next thing that is due: a waiting
event, a stale claim, a deadline, or the moment to be forgotten. State of finished tasks is removed. Each call for a
key and each access to its state is a message between JVM and Python and costs more than a task's few events, so tasks
are dealt by a hash of their id over ``BUCKETS`` keys: a key's state is one value with the records of its tasks (JSON),
read and written once a call, and its timer is the first of theirs. Needs the RocksDB state store (``configure`` sets it).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.columns import TERMINAL_STATUSES
from ..operators.transitions import new_state, transition
from .jobs import BUCKETS, DEADLINE_OUT, OUTCOME, _ltz

_FIELDS = ["status", "worker", "started_us", "completed_us", "retries", "applied", "rejected", "last_us", "waiting", "timer"]
TIMEOUT_RESET = "timeout_reset"
_OUTCOME_ROW = Row(*OUTCOME.names)


def _dealt(events: DataFrame, watermark: str):
    ev = events.select("event_id", "task_id", _ltz("ts").alias("ts"), "op", "worker_id").withWatermark("ts", watermark)
    bucket = F.pmod(F.xxhash64("task_id"), F.lit(BUCKETS))
    return ev.select("event_id", "task_id", "ts", "op", "worker_id", F.unix_micros("ts").alias("us"), bucket.alias("bucket")).groupBy("bucket")


class _Timed(StatefulProcessor):
    """The tasks of a bucket: a record (list) each that ends with the watermark in milliseconds beyond which the task is
    due, and one timer, for the first of them. ``add`` returns a task's record with new events, ``due`` the record of a task
    whose time has come and the rows that come out; None: the task has no state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tasks = handle.getValueState("tasks", "records string, timer long")

    def _load(self) -> tuple[dict, int | None]:
        records, timer = self.tasks.get() or ("[]", None)
        return {task: record for task, *record in json.loads(records)}, timer

    def _keep(self, tasks: dict, timer: int | None) -> None:
        """Write the records and move the timer from ``timer``; timers fire once the watermark is beyond them."""
        first = min((record[-1] for record in tasks.values()), default=None)
        if timer is not None and timer != first:
            self.handle.deleteTimer(timer)
        if first is not None and timer != first:
            self.handle.registerTimer(first)
        if tasks:
            self.tasks.update((json.dumps([[task, *record] for task, record in tasks.items()]), first))
        else:
            self.tasks.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new: dict = {}
        for event_id, task, _, op, worker, us, _ in rows:
            if us is not None:
                new.setdefault(task, []).append((event_id, us, op, worker))
        if new:
            tasks, timer = self._load()
            for task, events in new.items():
                record = self.add(tasks.get(task), events)
                if record is not None:
                    tasks[task] = record
            if tasks:
                self._keep(tasks, timer)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now_us, out = timerValues.getCurrentWatermarkInMs() * 1000, []
        tasks, _ = self._load()
        for task in [t for t, record in tasks.items() if record[-1] * 1000 < now_us]:
            record, rows = self.due(task, tasks.pop(task), now_us)
            if record is not None:
                tasks[task] = record
            out += rows
        self._keep(tasks, None)
        return iter(out)

    def close(self) -> None:
        pass


class LedgerProcessor(_Timed):
    """The guarded state machine per task. With ``auto_reset`` a task that sits in processing for longer than
    the limit is reset at that moment (K4), before any later event is applied. Events that the guard rejects
    come out as rows with ``applied`` false and the status that refused them (K5)."""

    def __init__(self, stale_us: int, strict: bool, auto_reset: bool, retain_us: int):
        self.stale_us, self.strict, self.auto_reset, self.retain_us = stale_us, strict, auto_reset, retain_us

    def add(self, record: list | None, events: list) -> list:
        *kept, waiting, timer = record or [*({**new_state(), "last_us": 0}[n] for n in _FIELDS[:-2]), [], None]
        first = min(t for _, t, _, _ in events) // 1000
        return [*kept, waiting + events, first if timer is None else min(first, timer)]

    def due(self, task, record: list, now_us: int) -> tuple[list | None, list[Row]]:
        s, out = dict(zip(_FIELDS, record)), []
        held = s["waiting"]
        due = {e[0]: e for e in held if e[1] < now_us}  # redeliveries inside the delay count once
        rest = [e for e in held if e[1] >= now_us]

        def emit(event_id, t, op, ok, before):
            out.append(_OUTCOME_ROW(event_id, task, t, op, ok, s["status"], s["worker"], s["started_us"], s["completed_us"], s["retries"], before))

        def reset_if_stale(before_us):
            limit = s["started_us"] + self.stale_us if self.auto_reset and s["status"] == "processing" else None
            if limit is not None and limit < before_us:
                s.update(status="pending", worker=None, retries=s["retries"] + 1, applied=s["applied"] + 1)
                emit(-1, limit, TIMEOUT_RESET, True, "processing")

        for event_id, t, op, worker in sorted(due.values(), key=lambda e: (e[1], e[0])):
            if s["status"] in TERMINAL_STATUSES and t > s["last_us"] + self.retain_us:
                s.update(new_state())
            reset_if_stale(t)
            s["last_us"] = max(s["last_us"], t)
            before = s["status"]
            emit(event_id, t, op, transition(s, op, t, worker, self.stale_us, self.strict), before)
        reset_if_stale(now_us)
        wake = [e[1] for e in rest]
        if self.auto_reset and s["status"] == "processing":
            wake.append(s["started_us"] + self.stale_us)
        if not wake:
            wake.append(s["last_us"] + self.retain_us)
        if not rest and s["status"] != "processing" and s["last_us"] + self.retain_us < now_us:
            return None, out  # finished or never begun, and quiet for so long: forgotten
        s["waiting"], s["timer"] = rest, max(min(wake), now_us) // 1000
        return [s[n] for n in _FIELDS], out


def _with_micros(fields: T.StructType) -> T.StructType:
    times = (T.TimestampType, T.TimestampNTZType)
    return T.StructType([T.StructField(f.name, T.LongType() if isinstance(f.dataType, times) else f.dataType) for f in fields])


def _with_times(df: DataFrame, fields: T.StructType) -> DataFrame:
    """The columns of ``fields``, their times from microseconds and without zone."""
    times = (T.TimestampType, T.TimestampNTZType)
    return df.select(*[F.timestamp_micros(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, times) else F.col(f.name)
                       for f in fields])


def ordered_ledger(events: DataFrame, stale_minutes: int = 60, strict: bool = True, auto_reset: bool = False,
                   watermark: str = "10 minutes", retain_hours: int = 24 * 30) -> DataFrame:
    """Per-event outcomes in event-time order (columns of ``OUTCOME``), covering events before the watermark.
    A task that is quiet for ``retain_hours`` leaves the state unless it is in processing."""
    processor = LedgerProcessor(stale_minutes * 60_000_000, strict, auto_reset, retain_hours * 3_600_000_000)
    return _with_times(_dealt(events, watermark).transformWithState(processor, _with_micros(OUTCOME), "Append", "EventTime"), OUTCOME)


def rejected_completions(outcomes: DataFrame) -> DataFrame:
    """K5: completions that came too late (after a reset, a claim by another worker, or the end of the task)."""
    return (outcomes.filter(~F.col("applied") & F.col("op").isin("complete", "fail"))
            .select("event_id", "task_id", "ts", "op", F.col("previous_status").alias("refused_by")))


class DeadlineProcessor(_Timed):
    """The first submit of a task and the times of terminal events, until the watermark passes the deadline."""

    def __init__(self, limit_us: int, retain_us: int):
        self.limit_us, self.retain_us = limit_us, retain_us

    def add(self, record: list | None, events: list) -> list | None:
        submitted, decided, held, timer = record or [None, False, [], None]
        begins = [t for _, t, op, _ in events if op == "submit"]
        ends = [t for _, t, op, _ in events if op in ("complete", "fail", "cancel")]
        if decided or not begins + ends:
            return record
        if begins:
            submitted = min(begins if submitted is None else [submitted, *begins])
        # without a submit, an end waits only for submits that are still to come before it
        due = (submitted + self.limit_us if submitted is not None else max(ends)) // 1000
        return [submitted, False, held + ends, due if submitted is not None or timer is None else max(timer, due)]

    def due(self, task, record: list, now_us: int) -> tuple[list | None, list[Row]]:
        submitted, decided, ends, _ = record
        if decided or submitted is None:  # forgotten, or only ends that no submit can precede any more
            return None, []
        reached = any(submitted <= t <= submitted + self.limit_us for t in ends)
        forget = max(submitted + self.limit_us + self.retain_us, now_us) // 1000
        return [submitted, True, [], forget], [Row(task_id=task, submitted_at=submitted, outcome="reached" if reached else "timeout")]


def wait_deadline_stream(events: DataFrame, seconds: int = 600, watermark: str = "10 minutes", retain_hours: int = 24 * 31) -> DataFrame:
    """K7 (stream form): one row per task once the watermark has passed its deadline, ``reached`` if a terminal
    event lies within ``seconds`` of the first submit, else ``timeout``: the batch outcome, whatever the order
    of arrival inside the watermark's delay. The state keeps the terminal times of undecided tasks, then one mark
    for ``retain_hours`` (longer than ids are reused), then nothing."""
    processor = DeadlineProcessor(seconds * 1_000_000, retain_hours * 3_600_000_000)
    return _with_times(_dealt(events, watermark).transformWithState(processor, _with_micros(DEADLINE_OUT), "Append", "EventTime"), DEADLINE_OUT)


def silence_starts(events: DataFrame, max_silence_seconds: int = 900, watermark: str = "15 minutes") -> DataFrame:
    """K8 (stream form): a session of a worker ends where no event follows within ``max_silence_seconds``; its
    end is the start of a silence and comes out once the watermark has passed it. Sessions merge in each
    task before the shuffle where ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` is set."""
    e = events.withColumn("ts", _ltz("ts")).withWatermark("ts", watermark)
    gap = f"{max_silence_seconds} seconds 1 microsecond"  # a gap of exactly the limit is no silence
    s = e.groupBy("worker_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    start = (F.col("w.end") - F.expr(f"interval {gap}")).cast("timestamp_ntz")
    return s.select("worker_id", F.col("w.start").cast("timestamp_ntz").alias("active_from"), start.alias("silent_from"), "events")
