"""Invariants from the survey's test strategy on the sf0.01 ledger and events."""

import random

from pyspark.sql import functions as F

from scriptorium.operators import documents as D
from scriptorium.operators import ledger as L
from scriptorium.operators.transitions import fold_transitions
from scriptorium.plans import fixtures as fx
from scriptorium.plans.registry import worker_results

from .conftest import SF_ORACLE

NOW = fx.AS_OF


def test_stats_sum_to_rows(spark):
    t = fx.tasks(spark, SF_ORACLE)
    assert L.queue_stats(t).agg(F.sum("count")).first()[0] == t.count()
    total = L.queue_stats_total(t).filter("is_total = 1").first()["count"]
    assert total == t.count()


def test_claims_unique_and_in_order(spark):
    t = fx.tasks(spark, SF_ORACLE)
    led, claims = L.claim_batch(t, ["a", "b", "c"], 500, NOW)
    c = claims.collect()
    assert len({r.task_id for r in c}) == len(c) == 500
    # no pending row of better order was left while a worse one was claimed
    worst = max((-r.priority, r.created_at, r.task_id) for r in
                t.join(claims.select("task_id"), "task_id").select("task_id", "priority", "created_at").collect())
    left = led.filter("status = 'pending'").select("task_id", "priority", "created_at").collect()
    assert all((-r.priority, r.created_at, r.task_id) > worst for r in left)


def test_mutations_idempotent(spark):
    t = fx.tasks(spark, SF_ORACLE)
    once = L.reset_stale(t, NOW, 60)
    assert once.subtract(L.reset_stale(once, NOW, 60)).count() == 0
    p1 = L.purge_records(t, NOW, 30)
    assert p1.subtract(L.purge_records(p1, NOW, 30)).count() == 0 and p1.count() == 15000 - 2190
    acks = fx.artifacts(spark, SF_ORACLE, t).select("task_id").distinct()
    led1, man1 = L.retire_artifacts(t, NOW, 7, deleted=acks)
    assert man1.count() == 1610
    led2, man2 = L.retire_artifacts(led1, NOW, 7, deleted=acks)
    # only directories that existed were cleared; what is left has no files to delete
    assert man2.filter("deleted").count() == 0
    assert man2.count() == man1.filter("NOT deleted").count()


def test_results_partition_input(spark):
    t = fx.tasks(spark, SF_ORACLE)
    res = worker_results(spark, SF_ORACLE)
    _, acc, rej = L.apply_results(t, res)
    assert acc.count() + rej.count() == res.count()
    assert acc.join(rej, "result_id").count() == 0


def test_markdown_round_trip_from_content_list(spark):
    blocks = D.to_blocks(spark.read.parquet(f"{SF_ORACLE}/documents.parquet"), "doc_id", "text", "text")
    md = D.blocks_to_markdown(blocks)
    cl = D.content_list(blocks).select("doc_id", F.array_join(F.transform("content_list", lambda b: b["text"]), "\n\n").alias("m2"))
    assert md.join(cl, "doc_id").filter(F.col("markdown") != F.col("m2")).count() == 0


def test_fold_ignores_shuffle_and_redelivery(spark):
    ev = fx.task_events(spark, SF_ORACLE)
    base = {tuple(r) for r in fold_transitions(ev).collect()}
    rows = ev.collect()
    rnd = random.Random(11)
    noisy = rows + rnd.sample(rows, 2000)
    rnd.shuffle(noisy)
    again = spark.createDataFrame(noisy, ev.schema)
    assert {tuple(r) for r in fold_transitions(again).collect()} == base
