"""Operators 4 and 7 against brute force."""

import math
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from scriptorium.llm import epsilon_grid, simhash
from scriptorium.llm.graph import components

from .conftest import docs_of


def least_reachable(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in linked:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def slow_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def check_simhash(df):
    rows = sorted(df.select("doc_id", "text").collect(), key=str)
    fps = [slow_fingerprint(r.text) for r in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    root = least_reachable(len(rows), near)
    first = {}
    for r, k in zip(rows, root):
        if r.doc_id is not None:
            first[k] = min(first.get(k, r.doc_id), r.doc_id)
    want = sorted(((r.doc_id, f"{f:016x}", first.get(k)) for r, f, k in zip(rows, fps, root)), key=str)
    assert sorted(map(tuple, simhash.simhash_near_duplicates(df).collect()), key=str) == want


def test_simhash_equals_brute_force(spark, odd, small, none):
    check_simhash(odd)
    check_simhash(small)
    assert simhash.simhash_near_duplicates(none).collect() == []


def test_close_pairs_of_planes():
    rng = np.random.default_rng(1)
    for radius in (4, 0, 2, 7):
        for n in (0, 1, 2, 63, 64, 65, 300):
            fps = rng.integers(0, 2**63, n, dtype=np.uint64)
            for i in range(1, n):
                if rng.random() < 0.5:
                    fps[i] = fps[rng.integers(0, i)]
                    for b in rng.integers(0, 64, rng.integers(0, 9)):
                        fps[i] ^= np.uint64(1) << np.uint64(b)
            group = np.sort(rng.integers(0, n // 100 + 1, n))
            got = {(int(i), int(j)) for a, b in simhash.close_pairs(fps, group, radius) for i, j in zip(a, b)}
            assert got == {(i, j) for j in range(n) for i in range(j)
                           if group[i] == group[j] and int(fps[i] ^ fps[j]).bit_count() <= radius}


def test_hot_keys_are_tiled_without_loss(spark):
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 2**62))
    fps = sorted({base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(400)})
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    for tile in (16, 64, 10_000):
        edges = [(signed.index(r.a), signed.index(r.b)) for r in simhash.links(df, 4, len(fps), tile).collect()]
        near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
        assert all((fps[i] ^ fps[j]).bit_count() <= 4 for i, j in edges)
        assert least_reachable(len(fps), edges) == least_reachable(len(fps), near)


def test_one_of_each_component(spark, odd, small, none):
    for df in (odd, small):
        kept = simhash.one_of_each(df)
        assert kept.columns == df.columns
        rows = df.select("doc_id", "text").collect()
        fps = [slow_fingerprint(r.text) for r in rows]
        root = least_reachable(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
        want = [min((r.doc_id for r, k in zip(rows, root) if k == c and r.doc_id is not None), default=None) for c in set(root)]
        assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(want, key=str)
    assert simhash.one_of_each(none).collect() == []
    same = docs_of(spark, ["a b c d e f"] * 40, [5] * 20 + [None] * 20)
    assert [r.doc_id for r in simhash.one_of_each(same).collect()] == [5]


def test_components_of_long_paths_and_stars(spark):
    rng = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(200, 260)] + [(1000, int(x)) for x in range(1001, 1300)] + \
        [tuple(map(int, rng.integers(300, 900, 2))) for _ in range(400)] + [(7, 7), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()))
    clean = [e for e in edges if None not in e and e[0] != e[1]]
    root = least_reachable(1400, clean)
    assert got == {x: root[x] for e in clean for x in e}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").collect() == []


# ------------------------------------------------------------------ 7

def slow_links(rows, cosine=0.98):
    def fine(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    links = []
    for i in range(n):
        for j in range(i):
            (_, v, a), (_, w, b) = rows[i], rows[j]
            if a is not None and a == b and fine(v) and fine(w):
                m = max(len(v), len(w))
                x, y = (np.array([*u, *[0.0] * (m - len(u))], float) for u in (v, w))
                if np.dot(x, y) / (math.sqrt(np.dot(x, x)) * math.sqrt(np.dot(y, y))) >= cosine:
                    links.append((i, j))
    return links


def check_vectors(spark, rows, block=epsilon_grid.BLOCK, kind="float"):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    links = slow_links(rows)
    root = least_reachable(len(rows), links)
    degree = [0] * len(rows)
    for i, j in links:
        degree[i] += 1
        degree[j] += 1
    want = [(r[0], d, rows[k][0], r[0] == rows[k][0]) for r, d, k in zip(rows, degree, root)]
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, label int")
    got = epsilon_grid.embedding_near_duplicates(df, block=block).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(420):
        v = rng.normal(size=6).astype(np.float32)
        if i and rng.random() < 0.7:
            v = np.float32(rows[rng.integers(0, i)][1]) * np.float32(rng.choice([1, 1, 2.5])) + (rng.random() < 0.6) * rng.normal(size=6).astype(np.float32) * np.float32(0.12)
        rows.append((i, [float(x) for x in v], int(rng.integers(0, 2))))
    check_vectors(spark, rows, block=16)  # several levels of intervals
    check_vectors(spark, rows)


def test_vectors_in_many_bundles(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(300):  # one label holds most rows, so its blocks and bundles pair up in many ways
        v = rng.normal(size=5)
        if i and rng.random() < 0.8:
            v = np.array(rows[rng.integers(0, i)][1]) + 0.1 * rng.normal(size=5)
        rows.append((i if i % 50 else None, [float(x) for x in v], int(rng.random() < 0.1)))
    for most in (1, 3):
        monkeypatch.setattr(epsilon_grid, "BUNDLE", most)
        check_vectors(spark, rows, block=8, kind="double")
    ids = spark.createDataFrame([(i, v, label) for i, v, label in rows], "vec_id int, embedding array<double>, label int")
    wide = ids.withColumn("vec_id", F.col("vec_id").cast("bigint"))
    out = [sorted(map(tuple, epsilon_grid.embedding_near_duplicates(d, block=8).collect()), key=str) for d in (ids, wide)]
    assert out[0] == out[1]


def test_distant_blocks_are_skipped(spark):
    rng = np.random.default_rng(2)
    centres = np.eye(8)[:6]  # clusters far apart
    n = 3000
    v = centres[rng.integers(0, 6, n)] + 0.01 * rng.normal(size=(n, 8))
    df = spark.createDataFrame([(i, x.tolist(), 1, 1, i) for i, x in enumerate(v)], "first bigint, v array<double>, label int, copies bigint, id bigint")
    eps = math.sqrt(2 - 2 * 0.98) + 1e-7
    sequence = epsilon_grid.blocks(df, epsilon_grid.principal_directions(df, 8), eps, block=32).cache()
    blocks = sequence.count()
    left = epsilon_grid.block_pairs(sequence, eps).count()
    assert blocks >= n / 32
    assert blocks <= left < 0.3 * blocks * (blocks + 1) / 2  # a sixth of all pairs lie inside one cluster


def test_vectors_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], None), (3, None, 1), (4, [], 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1),
            (7, [inf, 1.0], 1), (8, [1.0, None], 1), (9, [2.0], 1), (10, [2.0, 0.1, 0.0], 1), (11, [-1.0, 0.0], 1), (12, [1.0, 0.0], 2), (12, [1.0, 0.0], 2),
            (None, [3.0, 0.0], 3), (13, [1e-30, 0.0], 1)]
    check_vectors(spark, rows, kind="double")
    check_vectors(spark, [(3, None, 1), (4, [1.0], None)])
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert epsilon_grid.embedding_near_duplicates(empty).collect() == []


def test_vectors_with_nan_labels_and_clashing_columns(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], nan), (1, [1.0, 0.0], nan), (2, [1.0, 0.0], 1.0), (3, [1.0, 0.001], 1.0), (4, [0.0, 1.0], None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label double")
    for c in ("node", "V", "first", "copies", "kept", "n_links", "part", "block"):
        df = df.withColumn(c, F.lit("other"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in epsilon_grid.embedding_near_duplicates(df).collect()}
    assert got == {0: (0, 0, True), 1: (0, 1, True), 2: (1, 2, True), 3: (1, 2, False), 4: (0, 4, True)}
    only = spark.createDataFrame(rows[:2], "vec_id bigint, embedding array<float>, label double")
    assert sorted(r.n_links for r in epsilon_grid.embedding_near_duplicates(only).collect()) == [0, 0]
