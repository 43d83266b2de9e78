"""Operator 6, quality rules: learned decision lists.

``with_statistics`` appends per-document counts, ``fit`` grows and prunes threshold conjunctions by
sequential covering on labelled documents, ``verdict`` turns the list into one ordered Spark
conditional expression that runs inside the JVM.

Defined results: a null or blank text has no words and fails the base rule; repeated documents are
judged alike; with no labelled rows, or labels of one class only, the list is empty and only the
base rule rejects; a document with several labels counts as bad only if most of them say so; extra
columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, arrow_columns, as_bytes, bounded, fresh

SYMBOLS = b"#*$%&|<>"
WIDTH = 5
_INNER = bytes(range(0x80, 0xC0))  # UTF-8 continuation bytes: one byte is left for each code point
_UPPER, _DIGIT, _MARK = bytes(range(65, 91)), bytes(range(48, 58)), b"!?"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper",
          "n_digits", "n_marks", "n_distinct", "n_echoes")
#: Labelled documents that a fit reads at most (in expectation); about 1 MB on the driver.
MAX_LABELLED = 20_000


def repeated_words(words: list[bytes], width: int = WIDTH) -> int:
    """Words covered by a window of ``width`` words that occurs twice or more (first included)."""
    n, m = len(words), len(words) - width + 1
    if m < 2:
        return 0
    code: dict[bytes, int] = {}
    ids = np.fromiter((code.setdefault(w, len(code)) for w in words), np.int64, n)
    k = len(code)
    if k == n:
        return 0
    key, span = ids[:m], k
    for j in range(1, width):
        if span * k >= 1 << 62:  # rank anew, so that the number of a window stays exact
            seen, key = np.unique(key, return_inverse=True)
            span = len(seen)
        key, span = key * k + ids[j:m + j], span * k
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    starts = np.concatenate((order[1:][same], order[:-1][same]))
    covered = np.zeros(n, bool)
    for j in range(width):
        covered[starts + j] = True
    return int(covered.sum())


def counts(text: bytes) -> tuple[int, ...]:
    """``COUNTS`` of one whole text."""
    words = text.split()
    if not words:
        return (0, 0, len(text) - len(text.translate(None, SYMBOLS)), *[0] * 8)
    seen: set[bytes] = set()
    lines = dup = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    size = len(text)
    less = [size - len(text.translate(None, x)) for x in (SYMBOLS, _UPPER, _DIGIT, _MARK)]
    return (len(words), len(text.translate(None, WHITE + _INNER)), less[0], dup, repeated_words(words), lines,
            less[1], less[2], less[3], len(set(words)), sum(map(eq, words, words[1:])))


def with_statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, dict]:
    """``docs`` with the counts appended, and the name given to each count (never a clash)."""
    names = {c: fresh(docs, c) for c in COUNTS}

    def run(column: pa.Array) -> list:
        rows = [counts(b) for b in as_bytes(column)]
        return [pa.array(x, pa.int64()) for x in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(COUNTS)

    fields = ", ".join(f"{c} bigint" for c in COUNTS)
    return arrow_columns(docs, text, run, fields, [names[c] for c in COUNTS], keep), names


def features(names: dict) -> dict[str, Column]:
    """The statistics that rules test: rates, so that the length of a text does not decide."""
    c = {k: F.col(f"`{v}`").cast("double") for k, v in names.items()}

    def rate(a: str, b: str) -> Column:
        return F.when(c[b] > 0, c[a] / c[b]).otherwise(F.lit(0.0))

    return {"words": c["n_words"], "word_length": rate("word_chars", "n_words"), "symbols": rate("n_symbols", "word_chars"),
            "dup_lines": rate("n_dup_lines", "n_lines"), "repeats": rate("n_repeat_words", "n_words"),
            "upper": rate("n_upper", "word_chars"), "digits": rate("n_digits", "word_chars"),
            "marks": rate("n_marks", "word_chars"), "distinct": rate("n_distinct", "n_words"),
            "echoes": rate("n_echoes", "n_words")}


def base_failed(names: dict) -> Column:
    words, again = F.col(f"`{names['n_words']}`"), F.col(f"`{names['n_repeat_words']}`")
    return (words < 10) | (again * 100 > words * 20)


@dataclass(frozen=True)
class Rule:
    """Reject where every condition (feature, above, threshold) holds."""

    conditions: tuple[tuple[str, bool, float], ...]
    right: int
    wrong: int

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, above, cutoff in self.conditions:
            out &= (x[name] > cutoff) if above else (x[name] <= cutoff)
        return out

    def column(self, by_name: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, above, cutoff in self.conditions:
            out = out & ((by_name[name] > cutoff) if above else (by_name[name] <= cutoff))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>' if a else '<='} {t:.6g}" for n, a, t in self.conditions)


def _grow(x: dict, bad: np.ndarray, cuts: dict[str, np.ndarray], most: int) -> list[tuple[str, bool, float]]:
    """Add the condition of the highest information gain until no good document is covered."""
    inside, out = np.ones(len(bad), bool), []
    while len(out) < most and (~bad & inside).any():
        p0, n0 = int((bad & inside).sum()), int((~bad & inside).sum())
        if not p0:
            break
        before, best = math.log2(p0 / (p0 + n0)), (1e-9, None)
        for name, at in cuts.items():
            v = x[name]
            p_le = np.searchsorted(np.sort(v[inside & bad]), at, side="right")
            n_le = np.searchsorted(np.sort(v[inside & ~bad]), at, side="right")
            for above, p, n in ((False, p_le, n_le), (True, p0 - p_le, n0 - n_le)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(np.where(p > 0, p / (p + n), 1)) - before), -1.0)
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (float(gain[i]), (name, above, float(at[i])))
        if best[1] is None:
            break
        out.append(best[1])
        name, above, cutoff = best[1]
        inside &= (x[name] > cutoff) if above else (x[name] <= cutoff)
    return out


def learn(x: dict[str, np.ndarray], bad: np.ndarray, seed: int = 7, max_rules: int = 12, max_conditions: int = 4,
          min_precision: float = 0.9, min_cover: int = 2, cutoffs: int = 64) -> list[Rule]:
    """Sequential covering: grow a conjunction on two thirds of what no rule covers yet, prune its
    last conditions on the other third, accept it while the pruning third finds it precise."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    for step in range(max_rules):
        rows = np.flatnonzero(left)
        if not bad[rows].any() or bad[rows].all():
            break
        part = np.random.default_rng(seed + step).random(len(rows)) < 2 / 3
        grow, prune = rows[part], rows[~part]
        gx, px = ({k: v[i] for k, v in x.items()} for i in (grow, prune))
        # cut-offs lie between neighbouring quantiles of the bad and of all documents
        cuts = {}
        for k, v in gx.items():
            q = np.linspace(0, 1, cutoffs)
            points = np.unique(np.concatenate((np.quantile(v, q), np.quantile(v[bad[grow]], q) if bad[grow].any() else [])))
            cuts[k] = (points[1:] + points[:-1]) / 2 if len(points) > 1 else points
        grown = _grow(gx, bad[grow], cuts, max_conditions)
        best = None
        for n in range(1, len(grown) + 1):
            hit = Rule(tuple(grown[:n]), 0, 0).covers(px)
            p, m = int((hit & bad[prune]).sum()), int((hit & ~bad[prune]).sum())
            worth = (p - m) / (p + m) if p + m else -1.0
            if best is None or worth > best[0]:
                best = (worth, n, p, m)
        if best is None or best[2] < min_cover or best[2] < min_precision * (best[2] + best[3]):
            break
        hit = Rule(tuple(grown[:best[1]]), 0, 0).covers(x) & left
        rules.append(Rule(tuple(grown[:best[1]]), int((hit & bad).sum()), int((hit & ~bad).sum())))
        left &= ~hit
    return rules


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, **options) -> list[Rule]:
    """Learn the list from at most about ``max_labelled`` labelled documents that pass the base rule.
    The labelled ids are joined by broadcast (their number is bounded by ``max_labelled``), so no text
    is shuffled. Of the rows of one id the one with the smallest statistics counts, chosen before
    anything is collected, so the driver gets at most one row for each labelled id."""
    one = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id")
           .agg((F.avg("quality") < 0.5).alias("__bad")))
    chosen = bounded(one, F.col("doc_id"), max_labelled)
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    stats, names = with_statistics(labelled)
    by_name = features(names)
    values = [v.alias(f"f{i}") for i, v in enumerate(by_name.values())]
    rows = (stats.where(~base_failed(names)).groupBy("doc_id")
            .agg(F.min(F.struct("__bad", *values)).alias("one")).select("doc_id", "one.*")
            .toPandas().sort_values(["doc_id", *[f"f{i}" for i in range(len(by_name))]], kind="stable"))
    if rows.empty:
        return []
    x = {k: rows[f"f{i}"].to_numpy(float) for i, k in enumerate(by_name)}
    return learn(x, rows["__bad"].to_numpy(bool), **options)


def verdict(rules: list[Rule], names: dict) -> Column:
    """The decision list as an ordered conditional: the first rule that holds rejects."""
    by_name = features(names)
    out = F.when(base_failed(names), F.lit(False))
    for rule in rules:
        out = out.when(rule.column(by_name), F.lit(False))
    return out.otherwise(F.lit(True))


def quality_rules(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """``doc_id``, the five base counts, ``base_failed``, ``kept`` and ``rule`` (number of the rule
    that rejects, 0 for the base rule, null if kept) for every row."""
    stats, names = with_statistics(docs, text, keep=["doc_id"])
    by_name = features(names)
    which = F.when(base_failed(names), F.lit(0))
    for i, rule in enumerate(rules, 1):
        which = which.when(rule.column(by_name), F.lit(i))
    return stats.select("doc_id", *[F.col(names[c]).alias(c) for c in COUNTS[:5]],
                        base_failed(names).alias("base_failed"), verdict(rules, names).alias("kept"), which.alias("rule"))


def keep_good(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``."""
    stats, names = with_statistics(docs)
    return stats.where(verdict(rules, names)).select(*[F.col(f"`{c}`") for c in docs.columns])
