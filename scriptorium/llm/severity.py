"""Operator 10, toxicity: cumulative-link ordinal regression on sparse text features.

P(grade >= k) = sigmoid(score - cutoff_k): one weight per feature, shared by all ordered cutoffs.
Features are hashed lower-case words and word beginnings (5 and 4 letters), each as log2(1 + count).
Every step of a fit reads a bounded, documented sample of labelled rows; scoring reads whole texts.

Defined results: a null, empty or word-free text has no features and gets the score 0; repeated rows
score alike; without labelled rows, or with one grade only, the model has no features and expects the
lowest grade; a document with several labels takes its highest grade; extra columns pass through.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_columns, as_text, bounded, fresh

WORD = re.compile(r"[^\W\d_]+")
BITS = 22
#: Labelled documents that a fit reads at most (in expectation), and features that it keeps at most.
MAX_LABELLED, MAX_FEATURES = 20_000, 8_192
MIN_DOCS, MIN_SHARE = 4, 0.005  # of the documents above the lowest grade, that hold a feature
_MEMO: dict[str, tuple[int, ...]] = {}
_MEMO_MOST = 200_000


def keys(word: str) -> tuple[int, ...]:
    """The hashed features of one lower-case word: itself and its beginnings."""
    got = _MEMO.get(word)
    if got is None:
        names = {"w" + word, "5" + word[:5], "4" + word[:4]} if len(word) > 3 else {"w" + word}
        got = tuple({zlib.crc32(n.encode("utf-8", "replace")) & ((1 << BITS) - 1) for n in names})
        if len(word) <= 40:
            if len(_MEMO) >= _MEMO_MOST:
                _MEMO.clear()
            _MEMO[word] = got
    return got


def feature_counts(text: str) -> dict[int, int]:
    out: dict[int, int] = {}
    for word, n in Counter(WORD.findall(text.lower())).items():
        for k in keys(word):
            out[k] = out.get(k, 0) + n
    return out


@dataclass
class Severity:
    """A fitted model: ``weights`` by feature, ``cutoffs`` ascending (grades - 1 of them)."""

    weights: dict[int, float] = field(default_factory=dict)
    cutoffs: list[float] = field(default_factory=lambda: [math.inf])

    def score(self, text: str) -> float:
        return sum(w * math.log2(1 + n) for k, n in _hits(text, self._by_word()).items() if (w := self.weights[k]))

    def _by_word(self) -> "_Lookup":
        if not hasattr(self, "_lookup"):
            self._lookup = _Lookup(self.weights)
        return self._lookup

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "cutoffs": self.cutoffs}

    def at_least(self, score: float) -> list[float]:
        return [0.0 if math.isinf(c) else 1 / (1 + math.exp(min(700.0, max(-700.0, c - score)))) for c in self.cutoffs]


class _Lookup(dict):
    """word -> its features that have a weight (bounded, filled on use)."""

    def __init__(self, weights: dict[int, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> tuple[int, ...]:
        got = tuple(sorted(k for k in keys(word) if k in self.weights))
        if len(word) <= 40:
            if len(self) >= _MEMO_MOST:
                self.clear()
            self[word] = got
        return got


def _hits(text: str, lookup: _Lookup) -> dict[int, int]:
    out: dict[int, int] = {}
    for word in WORD.findall(text.lower()):
        for k in lookup[word]:
            out[k] = out.get(k, 0) + 1
    return dict(sorted(out.items()))  # sums in one order, however the words are ordered


def select_features(sample: DataFrame, min_docs: int = MIN_DOCS, most: int = MAX_FEATURES) -> list[int]:
    """Features with the strongest association with a grade above the lowest: document frequencies
    by Spark over the labelled sample (``text``, ``grade``), then at most ``most`` rows to the driver."""
    total = sample.agg(F.count_if(F.col("grade") > 0).alias("p"), F.count_if(F.col("grade") == 0).alias("n")).first()
    if not total.p or not total.n:
        return []

    def run(column: pa.Array) -> list:
        return [pa.array([list(feature_counts(t)) for t in as_text(column)], pa.list_(pa.int32()))]

    listed = arrow_columns(sample, "text", run, "keys array<int>", keep=["grade"])
    rate = (F.col("p") / F.lit(float(total.p))) / ((F.col("n") + F.lit(0.5)) / F.lit(float(total.n)))
    found = (listed.select("grade", F.explode("keys").alias("key")).groupBy("key")
             .agg(F.count_if(F.col("grade") > 0).alias("p"), F.count_if(F.col("grade") == 0).alias("n"))
             .where((F.col("p") >= max(min_docs, MIN_SHARE * total.p)) & (rate > 8)).withColumn("gain", F.col("p") * F.log(rate))
             .orderBy(F.desc("gain"), "key").limit(most).select("key"))
    return sorted(r.key for r in found.collect())


def train(rows: list[dict[int, int]], grades: np.ndarray, chosen: list[int], n_grades: int, penalty: float = 3e-5,
          steps: int = 600, rate: float = 0.1) -> Severity:
    """Maximum penalised likelihood of the proportional-odds model, by Adam on sparse rows."""
    at = {k: i for i, k in enumerate(chosen)}
    r, c, v = [], [], []
    for i, row in enumerate(rows):
        for k, n in row.items():
            r.append(i), c.append(at[k]), v.append(math.log2(1 + n))
    r, c, v = np.array(r, int), np.array(c, int), np.array(v, float)
    m, k, y = len(rows), n_grades, grades
    share = np.array([max((y >= j).mean(), 1 / (m + 1)) for j in range(1, k)])
    theta = np.concatenate((np.zeros(len(chosen)), [-math.log(share[0] / (1 - share[0] + 1e-9))],
                            np.full(k - 2, 0.0)))  # weights, first cutoff, log gaps of the others
    mean, var, d = np.zeros_like(theta), np.zeros_like(theta), len(chosen)
    for step in range(1, steps + 1):
        w, gaps = theta[:d], np.exp(theta[d + 1:])
        cutoff = theta[d] + np.concatenate(([0.0], np.cumsum(gaps)))
        score = np.bincount(r, v * w[c], m)
        upper = 1 / (1 + np.exp(np.clip(cutoff[None, :] - score[:, None], -500, 500)))  # P(grade >= j)
        p = np.concatenate((np.ones((m, 1)), upper, np.zeros((m, 1))), axis=1)
        here = np.maximum(p[np.arange(m), y] - p[np.arange(m), y + 1], 1e-12)
        slope = p * (1 - p)
        g_score = (slope[np.arange(m), y] - slope[np.arange(m), y + 1]) / here
        g_cut = np.zeros(k - 1)
        for j in range(1, k):
            g_cut[j - 1] = (-(slope[:, j] / here)[y == j]).sum() + ((slope[:, j] / here)[y == j - 1]).sum()
        grad = np.concatenate((np.bincount(c, v * g_score[r], d), [g_cut.sum()],
                               [g_cut[j:].sum() * gaps[j - 1] for j in range(1, k - 1)])) / m
        grad[:d] -= penalty * w
        mean, var = 0.9 * mean + 0.1 * grad, 0.999 * var + 0.001 * grad * grad
        theta = theta + rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(var / (1 - 0.999 ** step)) + 1e-8)
    cutoff = theta[d] + np.concatenate(([0.0], np.cumsum(np.exp(theta[d + 1:]))))
    return Severity({f: float(w) for f, w in zip(chosen, theta[:d], strict=True)}, [float(x) for x in cutoff])


def fit(docs: DataFrame, graded: DataFrame, max_labelled: int = MAX_LABELLED,
        regrade: Callable[[int, int, int], int] | None = None, **options) -> Severity:
    """Fit on documents joined with ``graded`` (doc_id, grade 0, 1, ...), at most about
    ``max_labelled`` of them. The ids are broadcast: their number is bounded by that parameter.
    ``regrade`` (grade, words with a chosen feature, words) may refine the grades above the lowest.
    Features are selected on all rows of these ids (counted by Spark); of the rows of one id the one with
    the smallest features is collected, so the driver gets at most one row for each labelled id."""
    one = (graded.where(F.col("doc_id").isNotNull() & F.col("grade").isNotNull()).groupBy("doc_id")
           .agg(F.max("grade").cast("int").alias("grade")))
    ids = bounded(one, F.col("doc_id"), max_labelled)
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    chosen = select_features(sample)
    if not chosen:
        return Severity()
    lookup = _Lookup(dict.fromkeys(chosen, 1.0))

    def run(column: pa.Array) -> list:
        texts = as_text(column)
        rows = [_hits(t, lookup) for t in texts]
        words = [[w for w in WORD.findall(t.lower())] if r else [] for t, r in zip(texts, rows)]
        return [pa.array([list(x) for x in rows], pa.list_(pa.int32())), pa.array([list(x.values()) for x in rows], pa.list_(pa.int32())),
                pa.array([sum(bool(lookup[w]) for w in ws) for ws in words], pa.int32()), pa.array([len(ws) for ws in words], pa.int32())]

    found = arrow_columns(sample, "text", run, "keys array<int>, n array<int>, marked int, words int", keep=["doc_id", "grade"])
    parts = ("grade", "keys", "n", "marked", "words")
    rows = sorted(found.groupBy("doc_id").agg(F.min(F.struct(*parts)).alias("one")).select("doc_id", "one.*").collect())
    grades = np.array([r.grade if regrade is None or not r.grade else regrade(r.grade, r.marked, r.words) for r in rows])
    return train([dict(zip(r["keys"], r["n"])) for r in rows], grades, chosen, int(grades.max()) + 1, **options)


def by_count(least: int = 4) -> Callable[[int, int, int], int]:
    """Grade 2 where ``least`` words or more mark toxic documents, else 1."""
    return lambda grade, marked, words: 2 if marked >= least else 1


def fit_toxic(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Severity:
    """Fit on the 0/1 column ``toxic``: grade 0 for clean documents, 1 or 2 by the
    number of words that mark toxic ones for the others."""
    return fit(docs, labels.select("doc_id", F.col("toxic").alias("grade")), max_labelled, by_count())


def severity(docs: DataFrame, model: Severity, text: str = "text", keep: list[str] | None = None,
             names: list[str] | None = None) -> DataFrame:
    """``docs`` with ``expected_severity`` (sum of P(grade >= k)), ``p_toxic`` (P(grade >= 1)) and
    ``grade`` (the number of cutoffs that are passed with probability 1/2 or more)."""

    def run(column: pa.Array) -> list:
        p = [model.at_least(model.score(t)) for t in as_text(column)]
        return [pa.array([sum(x) for x in p], pa.float64()), pa.array([x[0] for x in p], pa.float64()),
                pa.array([sum(y >= 0.5 for y in x) for x in p], pa.int32())]

    names = names or [fresh(docs, n) for n in ("expected_severity", "p_toxic", "grade")]
    return arrow_columns(docs, text, run, "expected_severity double, p_toxic double, grade int", names, keep)


def keep_clean(docs: DataFrame, model: Severity, most: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose P(grade >= 1) is below ``most``, with the columns of ``docs``."""
    names = [fresh(docs, n) for n in ("expected_severity", "p_toxic", "grade")]
    return (severity(docs, model, names=names).where(F.col(names[1]) < most)
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
