"""Conversion never loses a document, results follow the ledger's guard, vectors may be missing."""

from scriptorium.operators import documents as D
from scriptorium.operators import ledger as L
from scriptorium.operators import retrieval as R


class Picky:
    name = "picky"

    def open(self):
        pass

    def convert(self, content):
        if content == "bad":
            raise ValueError("no")
        return [("text", None, content)] if content else []


DOCS = "doc_id string, file_name string, content string"


def test_batches_without_blocks_and_error_rows(spark):
    df = spark.createDataFrame([("a", "a.txt", ""), ("b", "b.txt", "bad"), ("c", "c.txt", None)], DOCS)
    assert D.to_blocks(df, "doc_id", "content", Picky).collect() == []
    got = D.to_blocks(df, "doc_id", "content", Picky, errors=True).collect()
    assert [tuple(r) for r in got] == [("b", -1, "error", None, "ValueError: no")]
    assert D.to_blocks(df.limit(0), "doc_id", "content", Picky).collect() == []


def test_route_and_union_keeps_every_document(spark):
    df = spark.createDataFrame([("a", "a.txt", "x"), ("b", "b.txt", "bad"), ("c", "c.pdf", "x"), ("d", None, "x"), ("e", "e.txt", None)], DOCS)
    got = {r.doc_id: (r.status, r.n_blocks, r.error_message) for r in D.route_and_union(df, {"text_like": Picky}).collect()}
    assert set(got) == set("abcde")
    assert got["a"] == ("completed", 1, None) and got["b"] == ("failed", None, "ValueError: no") and got["e"][:2] == ("completed", 0)
    assert got["c"] == ("failed", None, "No converter for route page_image")


def test_a_wrong_workers_result_does_not_block_the_owner(spark):
    tasks = spark.createDataFrame([("t", "processing", "w1"), ("u", "completed", "w1")], "task_id string, status string, worker_id string")
    results = spark.createDataFrame([("t", 1, 10, "w2"), ("t", 2, 11, "w1"), ("t", 3, 12, "w1"), ("u", 4, 1, "w1"), ("v", 5, 1, "w1")],
                                    "task_id string, result_id int, ts int, worker_id string")
    got = {r.result_id: r.reason for r in L.result_outcomes(tasks, results).collect()}
    assert got == {1: "worker mismatch", 2: None, 3: "duplicate", 4: "status completed", 5: "not_found"}


def test_top_k_with_missing_vectors_and_without_queries(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id int, embedding array<double>")
    c = spark.createDataFrame([(7, [1.0, 0.0]), (8, None), (9, [0.0, 1.0])], "doc_id int, embedding array<double>")
    assert [(r.query_id, r.doc_id) for r in R.cosine_top_k(q, c, 1).collect()] == [(1, 7)]
    assert R.cosine_top_k(q.limit(0), c, 1).collect() == []


def test_null_keys_survive_the_chunked_path(spark):
    from scriptorium.plans.scale import _join_null_safe

    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, v int")
    b = spark.createDataFrame([(None, 3), ("x", 4)], "k string, w int")
    assert sorted((r.v, r.w) for r in _join_null_safe(a, b, ["k"], "inner").collect()) == [(1, 3), (2, 4)]
