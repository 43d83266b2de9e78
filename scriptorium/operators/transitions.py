"""The guarded state machine folded over task events, as runs that compose.

A run (consecutive events of one task, in event order) is a function from the state on entry (none,
pending, processing by a worker since a time, terminal) to the state on exit, with the numbers of accepted
events and resets. What follows an accepted event depends on that event alone, so a run is summed up by a
few chains, one for each event that may be the first one accepted: the first submit (entry none), the first
claim or cancel (entry pending), and for entry processing the first completion by each worker, the
first completion without a worker and the resets until one that every entry would accept. Two neighbouring
runs compose into one, and composing is associative, so runs are summed up wherever they lie and combined.

Events are range-partitioned by (task, time, id). A task of the cluster scans its range in Arrow batches,
finds successors and chains of a whole batch with array operations, and finishes the tasks that end inside it;
only the run that crosses into the next batch is carried. The first and the last task of a range leave
as summaries, which a second, light shuffle (one row per task) brings together. So there is one path whatever
the sizes: a task with most of all events is spread over as many ranges as it needs, nothing is gathered
per task but one summary for each range, and no job runs while the plan is built.

Transition table (SURVEY 2.5.1):

| event     | accepted from                         | new state                               |
| submit    | no state yet                          | pending, retry 0                        |
| claim(w)  | pending                               | processing, worker w, started_at ts     |
| complete  | processing, and worker = w if given   | completed, completed_at ts              |
| fail      | processing, and worker = w if given   | failed, completed_at ts                 |
| cancel    | pending (strict) / any state (loose)  | cancelled                               |
| reset     | processing, started_at < ts - T       | pending, worker NULL, retry + 1         |
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import by_key

# fixed values: operations and the statuses they lead to
OP_STATUS = {"submit": "pending", "reset": "pending", "claim": "processing", "complete": "completed",
             "fail": "failed", "cancel": "cancelled"}
OPS = list(OP_STATUS)
_SUBMIT, _RESET, _CLAIM, _COMPLETE, _FAIL, _CANCEL = range(6)

FOLD_SCHEMA = ("task_id string, status string, worker_id string, started_at timestamp_ntz, "
               "completed_at timestamp_ntz, retry_count long, applied long, rejected long")


def transition(state: dict, op: str, ts_us: int, worker: str | None, stale_us: int, strict: bool = True) -> bool:
    """One step of the state machine on a mutable state dict; returns whether it was accepted.
    Shared by the grouped batch fold and the streaming ledger (K2)."""
    st = state["status"]
    if op == "submit":
        ok = st is None
    elif op == "claim":
        ok = st == "pending"
    elif op in ("complete", "fail"):
        ok = st == "processing" and (worker is None or worker == state["worker"])
    elif op == "cancel":
        ok = st == "pending" if strict else st is not None
    elif op == "reset":
        ok = st == "processing" and state["started_us"] is not None and state["started_us"] < ts_us - stale_us
    else:
        ok = False
    if ok:
        state["status"] = OP_STATUS[op]
        if op == "claim":
            state["worker"], state["started_us"] = worker, ts_us
        elif op in ("reset", "cancel", "submit"):
            state["worker"] = None
        if op in ("complete", "fail"):
            state["completed_us"] = ts_us
        if op == "reset":
            state["retries"] += 1
        state["applied"] += 1
    else:
        state["rejected"] += 1
    return ok


def new_state() -> dict:
    return {"status": None, "worker": None, "started_us": None, "completed_us": None,
            "retries": 0, "applied": 0, "rejected": 0}


# ------------------------------------------------------------------ runs

# A chain is [accepted, resets, worker of its last claim, time of its last claim (None: no claim), last op, its time].
Chain = list


def _then(a: Chain, b: Chain) -> Chain:
    last = b if b[3] is not None else a
    return [a[0] + b[0], a[1] + b[1], last[2], last[3], b[4], b[5]]


class Run:
    """Summary of a run of one task's events.

    ``none``, ``pending``, ``terminal``: the chain for that state on entry, or None if nothing is accepted.
    ``processing``: [kind, key, chain] in event order, of the events that may be accepted first by a task in
    processing: "own" (key: worker), "any", "reset" (key: its time), "cancel"."""

    __slots__ = ("first", "events", "none", "pending", "terminal", "processing")

    def __init__(self, first: int, events: int, none: Chain | None, pending: Chain | None, terminal: Chain | None, processing: list):
        self.first, self.events, self.none, self.pending, self.terminal, self.processing = first, events, none, pending, terminal, processing

    def held(self, worker: str | None, started: int, stale: int) -> Chain | None:
        """The chain for a task that ``worker`` holds since ``started``."""
        for kind, key, chain in self.processing:
            if kind in ("any", "cancel") or (kind == "own" and key == worker) or (kind == "reset" and started < key - stale):
                return chain
        return None

    def after(self, chain: Chain, stale: int) -> Chain:
        """``chain``, which ends before this run, carried through it."""
        op = chain[4]
        more = (self.pending if op in (_SUBMIT, _RESET) else self.held(chain[2], chain[3], stale) if op == _CLAIM else self.terminal)
        return chain if more is None else _then(chain, more)

    def then(self, other: "Run", stale: int) -> "Run":
        def through(mine: Chain | None, theirs: Chain | None) -> Chain | None:
            return theirs if mine is None else other.after(mine, stale)

        rows = [[kind, key, other.after(chain, stale)] for kind, key, chain in self.processing]
        rows = _reachable(rows + other.processing, self.first, stale)
        return Run(self.first, self.events + other.events, through(self.none, other.none), through(self.pending, other.pending),
                   through(self.terminal, other.terminal), rows)

    def dump(self) -> bytes:
        return json.dumps([self.first, self.events, self.none, self.pending, self.terminal, self.processing]).encode()

    @staticmethod
    def load(data: bytes) -> "Run":
        return Run(*json.loads(data))

    def row(self, task) -> tuple:
        """The final ledger row of a task whose events are this run."""
        if self.none is None:
            return task, None, None, None, None, 0, 0, self.events
        n, resets, worker, started, op, at = self.none
        return (task, OP_STATUS[OPS[op]], worker if op in (_CLAIM, _COMPLETE, _FAIL) else None, started,
                at if op in (_COMPLETE, _FAIL) else None, resets, n, self.events - n)


def _reachable(rows: list, first: int, stale: int) -> list:
    """Without rows behind one that every entry accepts (it starts no later than ``first``), and behind the
    first of their kind."""
    out, owners, latest = [], set(), None
    for row in rows:
        kind, key, _ = row
        if kind == "own":
            if key in owners:
                continue
            owners.add(key)
        elif kind == "reset":
            if latest is not None and key <= latest:
                continue
            latest = key
        out.append(row)
        if kind in ("any", "cancel") or (kind == "reset" and first < key - stale):
            break
    return out


class Batch:
    """Chains of all events of a sorted batch, found with array operations."""

    def __init__(self, task: np.ndarray, ts: np.ndarray, op: np.ndarray, worker: pa.Array, stale: int, strict: bool):
        n = self.n = len(ts)
        self.task, self.ts, self.op, self.stale, self.strict = task, ts, op, stale, strict
        coded = worker.dictionary_encode()
        self.names, self.worker = coded.dictionary.to_pylist(), coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        done = (op == _COMPLETE) | (op == _FAIL)
        self.moves = self._next((op == _CLAIM) | (op == _CANCEL))
        self.any = self._next(done & (self.worker < 0))
        self.cancels = np.full(n + 1, n) if strict else self._next(op == _CANCEL)
        claim = np.flatnonzero(op == _CLAIM)
        # the claiming worker's next completion: the same search in (task, worker, place) order
        order = np.lexsort((self.worker, task))
        same = np.zeros(n, np.int64)
        same[order] = np.cumsum(np.concatenate(([0], (np.diff(task[order]) != 0) | (np.diff(self.worker[order]) != 0)))) if n else 0
        own = np.full(n + 1, n)
        if n:
            at = np.where(done[order], np.arange(n), n)
            ahead = np.concatenate((np.minimum.accumulate(at[::-1])[::-1][1:], [n]))
            place = np.append(order, n)[ahead]
            place[(place < n) & (np.append(same, -1)[place] != same[order])] = n
            own[order] = place
        own[:-1][self.worker < 0] = n
        # the first reset later than the claim by more than the limit
        reset = np.flatnonzero(op == _RESET)
        due = np.full(n + 1, n)
        if len(reset) and len(claim):
            times, code = np.unique(np.concatenate((ts[reset], ts[claim] + stale)), return_inverse=True)
            base = len(times) + 1
            hit = np.searchsorted(task[reset] * base + code[:len(reset)], task[claim] * base + code[len(reset):], side="right")
            found = np.append(reset, n)[hit]
            found[(found < n) & (np.append(task, -1)[found] != task[claim])] = n
            due[claim] = found
        succ = np.full(n + 1, n)
        start = (op == _SUBMIT) | (op == _RESET)
        succ[:-1][start] = self.moves[:-1][start]
        succ[claim] = np.minimum(np.minimum(own[claim], self.any[claim]), np.minimum(due[claim], self.cancels[claim]))
        end = done | (op == _CANCEL)
        succ[:-1][end] = self.cancels[:-1][end]
        self._chains(succ)

    def _next(self, mask: np.ndarray) -> np.ndarray:
        """For each event the next event of its task with ``mask`` (n: none)."""
        n = self.n
        at = np.where(mask, np.arange(n), n)
        ahead = np.concatenate((np.minimum.accumulate(at[::-1])[::-1][1:], [n])) if n else at
        ahead = np.append(ahead, n)
        return np.where(np.append(self.task, -1)[ahead] == np.append(self.task, -2), ahead, n)

    def _chains(self, succ: np.ndarray) -> None:
        """Pointer doubling: accepted events, resets, last claim and last event of the chain from each event."""
        n, me = self.n, np.arange(self.n + 1)
        self.count = np.append(np.ones(n, np.int64), 0)
        self.resets = np.append((self.op == _RESET).astype(np.int64), 0)
        self.claim = np.append(np.where(self.op == _CLAIM, me[:-1], -1), -1)
        self.last, jump = np.append(me[:-1], -1), succ
        while (jump < n).any():
            self.count = self.count + self.count[jump]
            self.resets = self.resets + self.resets[jump]
            self.claim = np.where(self.claim[jump] >= 0, self.claim[jump], self.claim)
            self.last = np.where(jump < n, self.last[jump], self.last)
            jump = jump[jump]

    def chain(self, i: int) -> Chain | None:
        if i >= self.n:
            return None
        c, f = int(self.claim[i]), int(self.last[i])
        w = int(self.worker[c]) if c >= 0 else -1
        return [int(self.count[i]), int(self.resets[i]), self.names[w] if w >= 0 else None, int(self.ts[c]) if c >= 0 else None,
                int(self.op[f]), int(self.ts[f])]

    def run(self, lo: int, hi: int) -> Run:
        """Summary of the events [lo, hi) of one task."""
        op, at = self.op[lo:hi], np.arange(lo, hi)

        def first(mask: np.ndarray) -> Chain | None:
            hit = np.flatnonzero(mask)
            return self.chain(lo + int(hit[0])) if len(hit) else None

        done = (op == _COMPLETE) | (op == _FAIL)
        some = done | (op == _RESET) | ((op == _CANCEL) & (not self.strict))
        first_ts, rows = int(self.ts[lo]), []
        # nothing behind the first event that every entry accepts can be accepted first
        sure = (done & (self.worker[lo:hi] < 0)) | ((op == _RESET) & (self.ts[lo:hi] > first_ts + self.stale)) | (some & (op == _CANCEL))
        hit = np.flatnonzero(sure)
        stop = int(hit[0]) + 1 if len(hit) else hi - lo
        seen: set = set()
        for i in at[:stop][some[:stop]].tolist():
            o, w = int(self.op[i]), int(self.worker[i])
            kind, key = (("cancel", None) if o == _CANCEL else ("reset", int(self.ts[i])) if o == _RESET
                         else ("any", None) if w < 0 else ("own", self.names[w]))
            if (kind, key) not in seen:
                seen.add((kind, key))
                rows.append([kind, key, self.chain(i)])
        return Run(first_ts, hi - lo, first(op == _SUBMIT), first((op == _CLAIM) | (op == _CANCEL)),
                   None if self.strict else first(op == _CANCEL), _reachable(rows, first_ts, self.stale))

    def finished(self, starts: np.ndarray, stops: np.ndarray) -> list[pa.Array]:
        """Final rows (without the task) of the tasks whose events are [starts, stops)."""
        submit = np.append(np.where(self.op == _SUBMIT, np.arange(self.n), self.n), self.n)
        ahead = np.minimum.accumulate(submit[::-1])[::-1][starts]
        none = ahead >= stops
        ahead = np.where(none, self.n, ahead)
        claim, last = self.claim[ahead], self.last[ahead]
        op, ts = np.append(self.op, -1)[last], np.append(self.ts, 0)
        worker = np.append(self.worker, -1)[claim]
        owned, done = np.isin(op, (_CLAIM, _COMPLETE, _FAIL)), np.isin(op, (_COMPLETE, _FAIL))
        status = pa.array([OP_STATUS[o] for o in OPS]).take(pa.array(np.where(none, 0, op), pa.int64(), mask=none))
        names = pa.array(self.names, pa.string()).take(pa.array(worker, pa.int64(), mask=none | ~owned | (claim < 0) | (worker < 0)))
        return [status, names, pa.array(ts[claim], pa.int64(), mask=none | (claim < 0)).cast(pa.timestamp("us")),
                pa.array(ts[last], pa.int64(), mask=none | ~done).cast(pa.timestamp("us")),
                pa.array(self.resets[ahead]), pa.array(self.count[ahead]), pa.array((stops - starts) - self.count[ahead])]


_NAMES = [c.split()[0] for c in FOLD_SCHEMA.split(", ")]
_KINDS = [pa.string()] * 3 + [pa.timestamp("us")] * 2 + [pa.int64()] * 3


def _scan(stale: int, strict: bool):
    """Sorted events -> final rows, and summaries (``run``) of the first and last task of the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: tuple | None = None  # (task, its run so far, whether it is the first of the range)
        last_row = None
        begun = False

        def rows(tasks, columns, runs) -> pa.RecordBatch:
            n = len(tasks)
            return pa.RecordBatch.from_arrays(
                [pa.array(tasks, pa.string()) if isinstance(tasks, list) else tasks, *columns, pa.array([part] * n, pa.int32()), pa.array(runs, pa.binary())],
                names=[*_NAMES, "part", "run"])

        def summary(task, r: Run) -> pa.RecordBatch:
            return rows([task], [pa.nulls(1, k) for k in _KINDS[1:]], [r.dump()])

        def single(task, r: Run) -> pa.RecordBatch:
            return rows([task], [pa.array([v], pa.int64()).cast(k) if pa.types.is_timestamp(k) else pa.array([v], k)
                                 for v, k in zip(r.row(task)[1:], _KINDS[1:])], [None])

        for b in batches:
            keys = [b.column(i) for i in (0, 1, 2)]  # redelivered events lie next to each other
            new = np.zeros(b.num_rows, bool)
            for i, c in enumerate(keys):
                code = pa.concat_arrays([last_row[i] if last_row else c.slice(0, 1), c]).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
                new |= code[1:] != code[:-1]
            if last_row is None and b.num_rows:
                new[0] = True
            if b.num_rows:
                last_row = [c.slice(b.num_rows - 1, 1) for c in keys]
            b = b.filter(pa.array(new))
            if not b.num_rows:
                continue
            task = b.column(0)
            code = task.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            code = np.concatenate(([0], np.cumsum(np.diff(code) != 0)))
            ts = b.column(1).cast(pa.int64())
            op = pa.compute.index_in(b.column(3), value_set=pa.array(OPS)).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            op = np.where(ts.is_null().to_numpy(zero_copy_only=False), -1, op)  # an event without a time is rejected
            batch = Batch(code, ts.fill_null(0).to_numpy(zero_copy_only=False), op, b.column(4), stale, strict)
            starts = np.flatnonzero(np.concatenate(([True], np.diff(code) != 0)))
            stops = np.append(starts[1:], batch.n)
            if held is not None:
                if held[0] == task[0].as_py():
                    held = (held[0], held[1].then(batch.run(int(starts[0]), int(stops[0])), stale), held[2])
                    starts, stops = starts[1:], stops[1:]
                if len(starts):
                    yield (summary if held[2] else single)(*held[:2])
                    held = None
            if len(starts) and not begun:
                if len(starts) > 1:
                    yield summary(task[0].as_py(), batch.run(int(starts[0]), int(stops[0])))
                    starts, stops = starts[1:], stops[1:]
                    begun = True
            if len(starts):
                at = int(starts[-1])
                held = (task[at].as_py(), batch.run(at, int(stops[-1])), not begun)
                begun = True
                if len(starts) > 1:
                    yield rows(task.take(pa.array(starts[:-1])), batch.finished(starts[:-1], stops[:-1]), [None] * (len(starts) - 1))
        if held is not None:
            yield summary(*held[:2])

    return run


def _combine(stale: int):
    """Rows by (task, range): final rows pass, the summaries of a task are composed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, total = None, None

        def final() -> pa.RecordBatch:
            values = total.row(task)
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int64()).cast(k) if pa.types.is_timestamp(k) else pa.array([v], k)
                                               for v, k in zip(values, _KINDS)], names=_NAMES)

        for b in batches:
            runs = b.column(b.num_columns - 1)
            plain = runs.is_null()
            yield pa.RecordBatch.from_arrays(b.filter(plain).columns[:len(_NAMES)], names=_NAMES)
            some = b.filter(pa.compute.invert(plain))
            for name, data in zip(some.column(0).to_pylist(), some.column(some.num_columns - 1).to_pylist()):
                r = Run.load(data)
                if total is not None and name == task:
                    total = total.then(r, stale)
                    continue
                if total is not None:
                    yield final()
                task, total = name, r
        if total is not None:
            yield final()

    return run


def fold_transitions(events: DataFrame, stale_minutes: int = 60, strict: bool = True, ranges: int | None = None,
                     affected=None) -> DataFrame:
    """Final ledger state per task plus how many of its events were applied / rejected.

    Output: task_id, status, worker_id, started_at, completed_at, retry_count, applied, rejected.
    Tasks whose events contain no submit keep status NULL and reject everything. Redelivered events (same
    ``event_id``, task and time) count once. Events without a time come first and are rejected. A NULL
    task is a task. ``ranges`` is the number of range partitions (the session's shuffle partitions).
    ``affected`` (an ``Observation``) counts the applied events (G7)."""
    stale = stale_minutes * 60 * 1_000_000
    n = ranges or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    cols = ["task_id", "ts", "event_id"]
    ordered = (events.select(F.col("task_id").cast("string").alias("task_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", "op",
                             F.col("worker_id").cast("string").alias("worker_id"))
               .repartitionByRange(n, *cols).sortWithinPartitions(*cols))
    scanned = ordered.mapInArrow(_scan(stale, strict), f"{FOLD_SCHEMA}, part int, run binary")
    ledger = by_key(scanned, "task_id").sortWithinPartitions("task_id", "part").mapInArrow(_combine(stale), FOLD_SCHEMA)
    return ledger if affected is None else ledger.observe(affected, F.coalesce(F.sum("applied"), F.lit(0)).cast("long").alias("affected_rows"))
