"""Operators 2, 5, 6, 9, 10 and the pipeline."""

import datetime as dt
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scriptorium.llm import packing, preference, quality_rules, severity, simhash, url_lists
from scriptorium.llm import queries as Q
from scriptorium.plans.check import compare, duckdb_con
from scriptorium.session import load

from ..conftest import SF_SMALL
from .conftest import docs_of
from .test_tokens import WORD, ids_of


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_queries_match_sql(spark, name):
    res = compare(spark, name, Q.QUERIES[name], Q.ORACLE[name], SF_SMALL, duckdb_con(SF_SMALL))
    assert res["status"] == "match", res


# ------------------------------------------------------------------ 2

def test_preference_format(spark):
    kind = "pair_id bigint, turn int, role string, text string"
    chosen = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "good"), (2, 0, "user", "a"), (3, 0, "user", "x"),
              (4, 1, None, None), (4, 0, "user", "u"), (None, 0, "user", "n"), (6, 0, "user", "é"), (6, 0, "user", "é")]
    rejected = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "bad"), (1, 3, "user", "more"), (2, 0, "user", "b"),
                (4, 0, "user", "u"), (4, 1, None, None), (5, 0, "user", "y"), (None, 0, "user", "n"), (6, 0, "user", "é")]
    got = {r.pair_id: r for r in preference.preference_format(spark.createDataFrame(chosen, kind), spark.createDataFrame(rejected, kind)).collect()}
    r = got[1]
    assert (r.n_common, r.prompt, r.chosen) == (2, "<|system|>\ns<|end|>\n<|user|>\nq<|end|>\n", "<|assistant|>\ngood<|end|>\n")
    assert r.rejected == "<|assistant|>\nbad<|end|>\n<|user|>\nmore<|end|>\n"
    assert [r.chosen[s.start:s.start + s.length] for s in r.chosen_spans if s.trained] == ["good<|end|>\n"]
    assert [r.rejected[s.start:s.start + s.length] for s in r.rejected_spans if s.trained] == ["bad<|end|>\n"]
    assert "".join(r.rejected[s.start:s.start + s.length] for s in r.rejected_spans) == r.rejected
    assert (got[2].n_common, got[2].prompt) == (0, "")
    assert (got[3].chosen, got[3].rejected, got[3].rejected_spans) == ("<|user|>\nx<|end|>\n", None, None)
    assert (got[4].n_common, got[4].prompt, got[4].chosen, got[4].rejected) == (2, "<|user|>\nu<|end|>\n<|unknown|>\n<|end|>\n", "", "")
    assert got[5].chosen is None and got[None].chosen == "" and got[6].n_common == 1 and got[6].chosen == "<|user|>\né<|end|>\n"
    none = spark.createDataFrame([], kind)
    assert preference.preference_format(none, none).collect() == []


# ------------------------------------------------------------------ 5

def check_packing(rows, want, capacities):
    bins, pieces = {}, Counter()
    for r in rows:
        bins.setdefault(r.bin_id, []).append(r)
        pieces[r.doc_id, r.start, r.length] += 1
    for part in bins.values():
        used = sum(r.length for r in part)
        assert {(r.used, r.capacity) for r in part} == {(used, min(c for c in capacities if c >= used))}
        spans = sorted((r.offset, r.length) for r in part)
        assert all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[-1][0] + spans[-1][1] <= used
    most, total = max(capacities), Counter()
    for doc_id, length in want:
        for start in range(0, max(length, 1), most):
            total[doc_id, start, min(most, length - start)] += 1
    assert pieces == total
    return bins


def test_packing_keeps_everything(spark, odd, none):
    rnd = random.Random(6)
    want = [(i, rnd.choice([0, 1, 7, 50, 400, 512, 900, 3000, 20_000])) for i in range(500)] + [(None, 5), (3, 7), (3, 7)]
    df = spark.createDataFrame(want, "doc_id bigint, length bigint").withColumn("bin_id", F.lit("x"))
    for window in (64, 50_000):
        bins = check_packing(packing.best_fit_pack(df, window=window, tasks=3).collect(), want, packing.CAPACITIES)
    full = sum(n for _, n in want) / sum(b[0].capacity for b in bins.values())
    assert full > 0.95
    lengths = packing.with_length(odd)
    check_packing(packing.best_fit_pack(lengths).collect(), [tuple(r) for r in lengths.collect()], packing.CAPACITIES)
    assert packing.best_fit_pack(packing.with_length(none)).collect() == []
    nulls = spark.createDataFrame([(1, None), (2, -4)], "doc_id bigint, length bigint")
    assert {(r.length, r.capacity) for r in packing.best_fit_pack(nulls).collect()} == {(0, 512)}


def test_packing_is_best_fit_and_opens_the_cheapest():
    # 60 goes to the bin with the least room that takes it; each bin ends at its smallest length
    got = packing.pack_window([90, 70, 30, 10], (100,), 0)
    assert [b for b, _, _ in got] == [0, 1, 1, 0]
    assert {c for _, c, _ in packing.pack_window([40], (64, 128), 16)} == {64}
    # two of 60 cost 128 + 16 together, 2 * (64 + 16) apart
    assert len({b for b, _, _ in packing.pack_window([60, 60], (64, 128), 16)}) == 1
    assert len({b for b, _, _ in packing.pack_window([64, 64], (64, 128), 0)}) == 2


# ------------------------------------------------------------------ 6

def slow_counts(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    grams = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    again = {j for i in range(len(words) - 4) if grams[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again)


def test_quality_counts_equal_brute_force(spark, odd, small, none):
    rnd = random.Random(7)
    texts = [" ".join(rnd.choice("abé") for _ in range(rnd.randint(0, 60))) + rnd.choice(["", "\nx\nx\n \n"]) for _ in range(200)]
    for df in (docs_of(spark, texts), odd, small, none):
        got = quality_rules.quality_rules(df, []).collect()
        want = [(r.doc_id, *slow_counts(r.text)) for r in df.collect()]
        assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
        for r in got:
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and r.kept == (not r.base_failed)
    wide = b" ".join(str(rnd.randint(0, 40_000)).encode() for _ in range(60_000))  # a window's number has to be ranked anew
    assert quality_rules.counts(wide * 2)[4] == slow_counts((wide * 2).decode())[4]


def test_decision_list_learns_prunes_and_speaks_spark(spark):
    rng = np.random.default_rng(8)
    x = {"a": rng.random(4000), "b": rng.random(4000), "c": rng.random(4000)}
    bad = (x["a"] > 0.8) | (x["b"] <= 0.1) & (x["c"] > 0.5)
    rules = quality_rules.learn(x, bad ^ (rng.random(4000) < 0.01))
    hit = np.zeros(4000, bool)
    for r in rules:
        hit |= r.covers(x)
    assert len(rules) >= 2 and (hit == bad).mean() > 0.97
    df = spark.createDataFrame([tuple(map(float, t)) for t in zip(*x.values())], "a double, b double, c double")
    by_spark = [r[0] for r in df.select(sum((F.when(r.column({k: F.col(k) for k in x}), 1).otherwise(0) for r in rules), F.lit(0)) > 0).collect()]
    assert by_spark == hit.tolist()
    assert quality_rules.learn(x, np.zeros(4000, bool)) == [] and quality_rules.learn(x, np.ones(4000, bool)) == []
    assert quality_rules.learn(x, rng.random(4000) < 0.3) == []  # nothing to learn from noise


def test_quality_query_on_held_out_labels(spark):
    sf = SF_SMALL.replace("0.001", "0.1")
    docs, labels = load(spark, sf, "documents"), load(spark, sf, "labels")
    rules = quality_rules.fit(docs.where("doc_id % 2 = 0"), labels)
    got = quality_rules.quality_rules(docs.where("doc_id % 2 = 1"), rules).join(labels, "doc_id").where("not base_failed")
    n = {(r.quality, r.kept): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.005 * n[1, True] and n.get((0, True), 0) <= 0.1 * n[0, False]


def test_fits_without_labels(spark, odd, none, small):
    no = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    bad = spark.createDataFrame([(None, 1, 1), (0, None, None), (1, 1, 0)], no.schema)
    for labels in (no, bad):
        for df in (odd, none):
            assert quality_rules.fit(df, labels) == []
            model = severity.fit_toxic(df, labels)
            assert severity.severity(df, model, keep=["doc_id"]).where("expected_severity > 0").collect() == []
            assert severity.keep_clean(df, model).count() == df.count() and severity.keep_clean(df, model).columns == df.columns
            assert quality_rules.keep_good(df, []).columns == df.columns


# ------------------------------------------------------------------ 9

def test_as_of_join_equals_brute_force(spark):
    rnd = random.Random(9)
    day = lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(hours=6 * n)
    hosts = ["a.b.example.com", "b.example.com", "example.com", "example.org"]
    kinds = [("host", h) for h in hosts] + [("domain", h) for h in hosts] + [("prefix", h + p) for h in hosts for p in ("/x", "/x/y")]
    entries = [(*rnd.choice(kinds), rnd.choice(["block", "allow", None]), day(rnd.randint(0, 600))) for _ in range(120)]
    entries += [("host", hosts[0], "allow", day(5)), ("host", hosts[0], "block", day(5)), (None, "x", "block", day(0)), ("host", "x", "block", None)]
    urls = [f"{s}://{u}{h}{p}" for s in ("http", "HTTPS") for u in ("", "me@") for h in (*hosts, "EXAMPLE.com:80", "other.net") for p in ("", "/", "/x", "/x/y/z?q", "/X#x", "/x?/y")]
    rows = [(i, rnd.choice(urls), day(rnd.randint(-10, 700))) for i in range(400)]
    rows += [(1, None, day(3)), (None, urls[0], day(400)), (2, urls[0], None), (3, "no url", day(4)), (4, "", day(4)), (5, "http://" + "/x" * 3000, day(4)), rows[0], rows[0]]
    held = {}
    for kind, key, action, at in entries:
        if kind and key and at:
            old = held.setdefault((kind, key), {}).get(at, 0)
            held[kind, key][at] = "block" if "block" in (action, old) else (action or (old or None))

    def want(url, at):
        m = re.match(r"([a-z][a-z0-9+.-]*)://(?:[^/?#@]*@)?([^/:?#]+)[^/?#]*(?:/([^?#]*))?", url or "", re.I)
        if not m or at is None:
            return None, None, None
        host, path = m[2].lower(), (m[3] or "").split("/")
        parts = host.split(".")
        ask = [("prefix", "/".join([host, *path[:i]])) for i in range(len(path), 0, -1)] + [("host", host)] + \
            [("domain", ".".join(parts[i:])) for i in range(len(parts))]
        for k in ask:
            past = [t for t in held.get(k, {}) if t <= at]
            if past and held[k][max(past)]:
                return *k, held[k][max(past)]
        return None, None, None

    c = spark.createDataFrame(rows, "id bigint, url string, fetched timestamp").withColumn("key", F.lit("clash"))
    e = spark.createDataFrame(entries, "kind string, key string, action string, valid_from timestamp").withColumn("span", F.lit(1))
    got = sorted(((r.id, r.url, r.fetched, r.kind, r.key, r.action) for r in url_lists.temporal_filter(c, e).collect()), key=str)
    assert got == sorted(((*r, *want(*r[1:])) for r in rows), key=str)
    assert url_lists.temporal_filter(c.limit(0), e).collect() == []
    assert url_lists.temporal_filter(c, e.limit(0)).where("action is not null").count() == 0


# ------------------------------------------------------------------ 10

def test_ordinal_model_finds_weights_and_cutoffs():
    rng = np.random.default_rng(10)
    true = {1: 3.0, 2: -2.0, 3: 1.0}
    rows = [{k: int(n) for k, n in zip((1, 2, 3), rng.integers(0, 4, 3)) if n} for _ in range(6000)]
    score = np.array([sum(true[k] * np.log2(1 + n) for k, n in r.items()) for r in rows])
    grades = (score + rng.logistic(size=6000) > 1).astype(int) + (score + rng.logistic(size=6000) > 4) * 1
    grades = np.where(score + rng.logistic(size=6000) > 4, 2, np.where(score + rng.logistic(size=6000) > 1, 1, 0))
    m = severity.train(rows, grades, [1, 2, 3], 3, penalty=0)
    assert m.cutoffs == sorted(m.cutoffs) and m.weights[1] > m.weights[3] > 0 > m.weights[2]
    assert abs(m.weights[1] / m.weights[3] - 3) < 0.6


def test_severity_on_held_out_labels(spark, odd):
    sf = SF_SMALL.replace("0.001", "0.1")
    docs, labels = load(spark, sf, "documents"), load(spark, sf, "labels")
    model = severity.fit_toxic(docs.where("doc_id % 2 = 0"), labels)
    rows = severity.severity(docs.where("doc_id % 2 = 1"), model, keep=["doc_id"]).join(labels, "doc_id").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.p_toxic >= 0.5 for r in clean) <= 0.01 * len(clean) and sum(r.p_toxic >= 0.5 for r in toxic) >= 0.85 * len(toxic)
    assert all(abs(r.expected_severity - r.p_toxic) <= 1 and 0 <= r.expected_severity <= 2 for r in rows)
    assert severity.severity(odd, model).columns[:len(odd.columns)] == odd.columns


# ------------------------------------------------------------------ pipeline

def test_pipeline_stages(spark, odd, none, small):
    docs = small
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        before, after = Counter(map(tuple, docs.collect())), Counter(map(tuple, out.collect()))
        assert not after - before and after, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    counted = {r.doc_id: len(ids_of(WORD, r.text)) + 1 for r in docs.collect()}
    packed = Counter()
    for r in corpus_pipeline.run(spark, SF_SMALL).collect():
        packed[r.doc_id] += r.length
    assert packed == counted
    assert len(simhash.one_of_each(docs).collect()) == docs.count()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF_SMALL).collect() == [], name
    odd_docs = odd.select(*small.columns)
    before = Counter(map(tuple, odd_docs.collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert not Counter(map(tuple, stage(spark, odd_docs, SF_SMALL).collect())) - before, name
    lengths = Counter()
    for r in stage_rows(spark, odd_docs):
        lengths[r.doc_id] += r.length
    want = Counter()
    for r in odd_docs.collect():
        want[r.doc_id] += len(ids_of(WORD, r.text)) + 1
    assert lengths == want


def stage_rows(spark, docs):
    return corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL).collect()
