"""Operator 12, periodic run detection: string synchronising sets.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and length
at least max(LEAST, EXPONENT * q) that no neighbouring word extends. The words of many documents stand in
one sequence of numbers, parted by marks that occur once, so that nothing matches across documents.

Substrings of 1, 2, 4, ... words get exact names (equal name: equal words) by ranking pairs of names. At
scale t = 4, 8, 16, ... a position is highly periodic if its t words have a period of at most 3 t / 8,
which the next place of the name of its first t / 2 words tells. The synchronising set holds position i
if the least hash among the names of t words at i, i + 1, ..., i + t, highly periodic ones left out, is
that at i or at i + t: a choice that follows from the 2 t words at i alone.

* A run of period p in [t, 2 t) and length 4 p has a chosen position i among its first t words (else 3 t - 1
  words would have a period of at most 3 t / 8 beside the primitive p), i + p is chosen too, with the same 2 t
  words, and no chosen position between has them. So neighbours of equal context propose all such periods.
* Periods below 4 come from the highly periodic positions of t = 4 and 8.

Each proposal is extended by comparing words, so that nothing but true runs leaves. Documents without a
repeated context leave the sequence before the next scale.

Defined results: a null, empty or blank text has no run and collapses to the empty text; repeated rows are
rows of their own; an empty table gives an empty result; all other columns pass through, new names avoid clashes.
A document is worked on as a whole; a task holds ``CHUNK`` words or one document if that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_columns, fresh

LEAST, EXPONENT = 6, 4
CHUNK = 1 << 15  # words whose names a task holds at a time
_FIRST = 4  # the first scale; shorter periods come from highly periodic positions
_NONE = np.uint64((1 << 64) - 1)


Named = tuple[np.ndarray, np.ndarray]  # names, and the positions sorted by name, then place


def _ranks(keys: np.ndarray) -> Named:
    """Names 0, 1, ... of the keys (integers from 0), equal for equal keys."""
    n = len(keys)
    if not n:
        return keys, np.empty(0, np.int64)
    bits = n.bit_length()
    if int(keys.max()) >> (62 - bits):
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
    else:  # key and place in one number: plain sorting is several times faster
        both = np.sort(keys << bits | np.arange(n))
        order, ranked = both & ((1 << bits) - 1), both >> bits
    names = np.empty(n, np.int64)
    names[order] = np.cumsum(np.concatenate(([0], ranked[1:] != ranked[:-1])))
    return names, order


def _longer(names: np.ndarray, step: int) -> Named:
    """Names of substrings of 2 * step words from those of step words; what would pass the end is unlike all else."""
    n = len(names)
    if n <= step:
        return np.arange(n), np.arange(n)
    pairs, order = _ranks(names[:-step] * (int(names.max()) + 1) + names[step:])
    tail = np.arange(n - step, n)
    return np.concatenate((pairs, int(pairs.max()) + 1 + tail - tail[0])), np.concatenate((order, tail))


def _next_same(named: Named) -> np.ndarray:
    """Distance to the next place of the same name (0: none)."""
    names, order = named
    out = np.zeros(len(names), np.int64)
    ranked = names[order]
    same = ranked[1:] == ranked[:-1]
    out[order[:-1][same]] = np.diff(order)[same]
    return out


def _mixed(names: np.ndarray) -> np.ndarray:
    """A hash that different names never share (each step can be undone), below the mark for none."""
    x = names.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return np.where(x == _NONE, np.uint64(0x9E3779B97F4A7C15), x)


def highly_periodic(named: Named, t: int) -> np.ndarray:
    """Smallest period of the t words at each position if it is at most 3 t / 8, else 0; from the names of t / 2 words."""
    half, d = named[0], _next_same(named)
    at = np.flatnonzero((d > 0) & (8 * d <= 3 * t))
    at = at[at + t // 2 < len(half)]
    at = at[half[at + t // 2 - d[at]] == half[at + t // 2]]
    out = np.zeros(len(half), np.int64)
    out[at] = d[at]
    return out


def synchronising(own: np.ndarray, periodic: np.ndarray, t: int) -> np.ndarray:
    """Chosen positions; ``own`` names t words."""
    if len(own) <= t:
        return np.empty(0, np.int64)
    value = np.where(periodic > 0, _NONE, _mixed(own))
    least, span = value, 1
    while span < t:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:-1], least[1:])  # over t + 1 positions
    return np.flatnonzero((least != _NONE) & ((value[:-t] == least) | (value[t:] == least)))


def proposals(w: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, periods) that may begin runs; ``starts`` are where documents begin in ``w`` and its end."""
    place, t, half = np.arange(len(w)), _FIRST, _longer(w, 1)
    own = _longer(half[0], 2)
    for named, scale in ((half, t), (own, 2 * t)):
        small = highly_periodic(named, scale)
        small[small >= _FIRST] = 0
        head = np.flatnonzero((small > 0) & (np.concatenate(([0], small[:-1])) != small))
        yield head, small[head]
    while len(place):
        both = _longer(own[0], t)
        chosen = synchronising(own[0], highly_periodic(half, t), t)
        context = both[0][chosen]
        order = np.argsort(context, kind="stable")
        i, j = chosen[order[:-1]], chosen[order[1:]]
        ok = (context[order[1:]] == context[order[:-1]]) & (j - i >= t) & (j - i < 2 * t)
        yield place[i[ok]], (j - i)[ok]
        # on to documents that repeat a context and are long enough
        doc = np.searchsorted(starts, place, side="right") - 1
        fine = np.zeros(len(starts), bool)
        fine[doc[_next_same(both) > 0]] = True
        fine[:-1] &= np.diff(starts) > 2 * t * EXPONENT
        keep = fine[doc]
        place, half, own, t = place[keep], _ranks(own[0][keep]), _ranks(both[0][keep]), 2 * t


def _matching(w: np.ndarray, i: int, d: int) -> tuple[int, int]:
    """The longest stretch [s, e) around i .. i + d in which words d apart are identical."""
    n, e, step = len(w), i, 16
    while e + d < n:
        stop = min(e + step, n - d)
        differ = np.flatnonzero(w[e:stop] != w[e + d:stop + d])
        if len(differ):
            e += int(differ[0])
            break
        e, step = stop, 2 * step
    s, step = i, 16
    while s:
        stop = max(0, s - step)
        differ = np.flatnonzero(w[stop:s] != w[stop + d:s + d])
        if len(differ):
            s = stop + int(differ[-1]) + 1
            break
        s, step = stop, 2 * step
    return s, e + d


def runs_of(w: np.ndarray, starts: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) in the sequence ``w``, sorted by start, then period."""
    found = [np.concatenate(x) for x in zip(*proposals(w, starts))]
    if not found:
        return []
    out, last = [], (0, 0)
    for k in np.lexsort(found).tolist():
        i, d = int(found[0][k]), int(found[1][k])
        if last[0] == d and i + d < last[1]:
            continue  # inside the run just found
        s, e = _matching(w, i, d)
        last = (d, e)
        if e - s >= max(least, exponent * d):
            out.append((s, e - s, d))
    return sorted(out)


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _chunks(column: pa.Array) -> Iterator[list[list[bytes]]]:
    held, n = [], 0
    for x in column.cast(pa.binary()):
        words = (x.as_py() or b"").split()  # bytes: ASCII white space only
        if held and n + len(words) > CHUNK:
            yield held
            held, n = [], 0
        held.append(words)
        n += len(words)
    if held:
        yield held


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        step[s + q] += 1
        step[s + n] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()])


def _of_documents(docs: list[list[bytes]]) -> tuple[list[list[tuple[int, int, int]]], list[bytes]]:
    words = pa.array([x for d in docs for x in d], pa.large_binary()).dictionary_encode()
    starts = np.cumsum([0] + [len(d) + 1 for d in docs])
    w = np.empty(starts[-1], np.int64)
    marks = np.zeros(len(w), bool)
    marks[starts[1:] - 1] = True
    w[marks] = len(words.dictionary) + np.arange(len(docs))
    w[~marks] = words.indices.to_numpy()
    runs: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    found = runs_of(w, starts)
    for (s, n, q), doc in zip(found, (np.searchsorted(starts, [r[0] for r in found], side="right") - 1).tolist()):
        runs[doc].append((s - int(starts[doc]), n, q))
    return runs, [_collapsed(d, r) for d, r in zip(docs, runs)]


def find_runs(docs: DataFrame, text: str = "text", names: tuple[str, str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``runs`` (array of start, length and period in words, by start, then period) and ``collapsed``:
    the words joined by one space, without those that a run holds after its first period. Narrow, no shuffle."""

    def run(column: pa.Array) -> list:
        at, flat, texts = [0], [], []
        for chunk in _chunks(column):
            found, kept = _of_documents(chunk)
            texts += kept
            for r in found:
                flat += r
                at.append(len(flat))
        parts = [pa.array(c, pa.int64()) for c in (zip(*flat) if flat else [()] * 3)]
        runs = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(parts, ["start", "length", "period"]))
        return [runs.cast(_RUNS), pa.array(texts, pa.binary()).cast(pa.string())]

    names = names or (fresh(docs, "runs"), fresh(docs, "collapsed"))
    return arrow_columns(docs, text, run, "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string", list(names), keep)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equal ones the first (null: none)."""
    more = lambda a, b: b["length"].cast("decimal(38,0)") * a["period"] > a["length"].cast("decimal(38,0)") * b["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(more(best, r), r).otherwise(best))


def run_digest(found: DataFrame, runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """doc_id, n_runs, the strongest run (start, length, period, exponent_milli) and SHA-256 of runs and collapsed text."""
    lines = F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.when(F.size(runs) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    best = found.select("doc_id", F.size(runs).cast("long").alias("n_runs"), strongest(F.col(runs)).alias("best"),
                        F.sha2(text, 256).alias("runs_sha256"), F.sha2(F.col(collapsed), 256).alias("collapsed_sha256"))
    return best.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                       F.expr("(best.length * 1000) div best.period").alias("exponent_milli"),
                       "runs_sha256", "collapsed_sha256")
