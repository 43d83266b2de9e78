"""Operators 2, 5 and 10 against plain forms that share no code with them."""

import math
import random
import unicodedata
import zlib

import numpy as np
from pyspark.sql import functions as F

from scriptorium.llm import packing, preference, severity
from scriptorium.llm import queries as Q
from scriptorium.session import load

from ..conftest import SF_SMALL


# ------------------------------------------------------------------ 5

def plain_pack(sizes, capacities, overhead):
    """Best fit over a list of open bins, tried one by one, and a greedy fill over the pieces to come."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])  # stable: ties in the order given
    bins, placed = [], {}
    for n, i in enumerate(order):
        size, best = sizes[i], None
        for b, (room, held) in enumerate(bins):
            if room > held and room - held >= size and (best is None or room - held < bins[best][0] - bins[best][1]):
                best = b
        if best is None:
            costs = []
            for c in capacities:
                if c >= size:
                    left = c - size
                    for j in order[n + 1:]:
                        if sizes[j] <= left:
                            left -= sizes[j]
                    costs.append(((c + overhead) / max(1, c - left), c))
            best = len(bins)
            bins.append([min(costs)[1], 0])
        placed[i] = (best, bins[best][1])
        bins[best][1] += size
    return [(b, min(c for c in capacities if c >= bins[b][1]), at) for b, at in (placed[i] for i in range(len(sizes)))]


def test_packing_equals_plain_best_fit():
    rng = random.Random(3)
    for capacities in ((8,), (4, 8, 16), (5, 12, 13, 30)):
        for _ in range(120):
            sizes = [rng.choice([0, 1, 2, 3, rng.randint(0, capacities[-1]), capacities[-1]]) for _ in range(rng.randint(0, 40))]
            overhead = rng.choice([0, 1, 16])
            assert packing.pack_window(sizes, capacities, overhead) == plain_pack(sizes, capacities, overhead), (sizes, capacities, overhead)


# ------------------------------------------------------------------ 10

def plain_words(text):
    word, out = "", []
    for c in (text or "").lower() + " ":
        if c.isalnum() and unicodedata.category(c) != "Nd":  # what a regular expression calls a letter
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def plain_severity(text, model):
    counts = {}
    for w in plain_words(text):
        for name in {"w" + w, *(["5" + w[:5], "4" + w[:4]] if len(w) > 3 else [])}:
            counts.setdefault(zlib.crc32(name.encode()) % 2 ** severity.BITS, []).append(name)
    score = sum(model.weights.get(k, 0.0) * math.log2(1 + len(names)) for k, names in counts.items())
    p = [1 / (1 + math.exp(c - score)) for c in model.cutoffs]
    return sum(p), p[0], sum(x >= 0.5 for x in p)


def test_severity_of_whole_texts(spark):
    docs, labels = load(spark, SF_SMALL, "documents"), load(spark, SF_SMALL, "labels")
    model = severity.fit_toxic(docs, labels)
    assert model.weights and len(model.cutoffs) == 2 and model.cutoffs == sorted(model.cutoffs)
    got = {r.doc_id: (r.expected_severity, r.p_toxic, r.grade) for r in Q.QUERIES["op10_toxicity"](spark, SF_SMALL).collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert got.keys() == texts.keys()
    for doc_id, text in texts.items():
        want = plain_severity(text, model)
        assert np.allclose(got[doc_id][:2], want[:2], rtol=0, atol=1e-9) and got[doc_id][2] == want[2]


def test_ordinal_fit_is_the_maximum():
    rng = np.random.default_rng(5)
    rows = [{k: int(n) for k, n in zip((3, 7, 11), rng.integers(0, 4, 3)) if n} for _ in range(400)]
    x = np.array([[math.log2(1 + r.get(k, 0)) for k in (3, 7, 11)] for r in rows])
    latent = x @ np.array([1.5, -1.0, 0.2]) + rng.logistic(size=400)
    grades = np.digitize(latent, [0.5, 2.0])
    model = severity.train(rows, grades, [3, 7, 11], 3, steps=3000, rate=0.02)

    def objective(weights, cutoffs):
        upper = 1 / (1 + np.exp(np.array(cutoffs)[None, :] - (x @ weights)[:, None]))
        p = np.column_stack((np.ones(400), upper, np.zeros(400)))
        likely = p[np.arange(400), grades] - p[np.arange(400), grades + 1]
        return np.log(likely).mean() - 3e-5 / 2 * (weights ** 2).sum()

    weights = np.array([model.weights[k] for k in (3, 7, 11)])
    best = objective(weights, model.cutoffs)
    for i in range(5):
        for step in (-0.05, 0.05):
            theta = np.concatenate((weights, model.cutoffs))
            theta[i] += step
            assert objective(theta[:3], theta[3:]) < best
    assert weights[0] > 0.9 and weights[1] < -0.5  # the weights that made the grades, shared by both thresholds


# ------------------------------------------------------------------ 2

def test_preference_of_long_texts_and_clashing_columns(spark):
    kind = "pair_id bigint, turn int, role string, text string"
    long = "né " * 200_000
    chosen = [(1, 0, "user", long), (1, 1, "assistant", long + "a")]
    rejected = [(1, 0, "user", long), (1, 1, "assistant", long + "b")]
    tables = []
    for rows in (chosen, rejected):
        df = spark.createDataFrame(rows, kind)
        for c in ("side", "t", "c", "r", "p", "k", "prompt", "n_common", "chosen_spans"):
            df = df.withColumn(c, F.lit("other"))
        tables.append(df)
    (r,) = preference.preference_format(*tables).collect()
    assert (r.n_common, r.prompt) == (1, f"<|user|>\n{long}<|end|>\n")
    for text, spans, end in ((r.chosen, r.chosen_spans, "a"), (r.rejected, r.rejected_spans, "b")):
        assert text == f"<|assistant|>\n{long}{end}<|end|>\n"
        assert [text[s.start:s.start + s.length] for s in spans if s.trained] == [f"{long}{end}<|end|>\n"]
