"""Edge rows from FIXTURES section 5 as small literals."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import columns as C
from scriptorium.operators import ledger as L
from scriptorium.operators import documents as D

NOW = "2024-01-10 12:00:00"
T0 = dt.datetime(2024, 1, 10, 12, 0, 0)


def ledger(spark, rows):
    schema = ("task_id string, file_name string, file_path string, status string, priority int, backend string, "
              "options string, result_path string, error_message string, created_at timestamp_ntz, "
              "started_at timestamp_ntz, completed_at timestamp_ntz, worker_id string, retry_count int")
    return spark.createDataFrame(rows, schema)


def row(tid, status, created=T0, started=None, completed=None, worker=None, priority=0, result="/r", options="{}"):
    return (tid, f"{tid}.pdf", f"/in/{tid}", status, priority, "pipeline", options, result, None, created,
            started, completed, worker, 0)


def test_file_name_functions(spark):
    names = [".bashrc", "noext", "a.tar.gz", "X.PDF", "a.b.pdf", "dir/x.Png"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r["n"]: (r["s"], r["stem"], r["v1"], r["route"]) for r in df.select(
        "n", C.file_suffix("n").alias("s"), C.file_stem("n").alias("stem"), C.pdf_name_v1("n").alias("v1"),
        C.route_by_suffix("n").alias("route")).collect()}
    assert got[".bashrc"] == ("", ".bashrc", ".pdf", "text_like")
    assert got["noext"] == ("", "noext", "noext.pdf", "text_like")
    assert got["a.tar.gz"] == (".gz", "a.tar", "a.pdf", "text_like")
    assert got["X.PDF"] == (".pdf", "X", "X.pdf", "page_image")
    assert got["a.b.pdf"] == (".pdf", "a.b", "a.pdf", "page_image")
    assert got["dir/x.Png"][0] == ".png"


def test_cutoffs_are_strict_and_null_safe(spark):
    cut7 = T0 - dt.timedelta(days=7)
    t = ledger(spark, [
        row("equal", "completed", completed=cut7),
        row("older", "completed", completed=cut7 - dt.timedelta(seconds=1)),
        row("nullc", "cancelled", completed=None),
        row("failed_null", "failed", completed=None),
    ])
    assert {r.task_id for r in L.retire_candidates(t, NOW, 7).collect()} == {"older"}
    kept = {r.task_id for r in L.purge_records(t, NOW, 7).collect()}
    assert kept == {"equal", "nullc", "failed_null"}
    assert L.retire_candidates(t, NOW, 0).count() == 0  # 0 disables retention


def test_reset_stale_and_idempotence(spark):
    t = ledger(spark, [
        row("stale", "processing", started=T0 - dt.timedelta(minutes=61), worker="w1"),
        row("edge", "processing", started=T0 - dt.timedelta(minutes=60), worker="w1"),
        row("fresh", "processing", started=T0 - dt.timedelta(minutes=5), worker="w2"),
    ])
    once = L.reset_stale(t, NOW, 60)
    got = {r.task_id: (r.status, r.worker_id, r.retry_count, r.started_at) for r in once.collect()}
    assert got["stale"] == ("pending", None, 1, T0 - dt.timedelta(minutes=61))
    assert got["edge"][0] == "processing" and got["fresh"][0] == "processing"
    twice = {r.task_id: (r.status, r.retry_count) for r in L.reset_stale(once, NOW, 60).collect()}
    assert twice == {k: (v[0], v[2]) for k, v in got.items()}


def test_claim_batch_order_ties_and_limits(spark):
    t = ledger(spark, [
        row("b", "pending", priority=1), row("a", "pending", priority=1),
        row("c", "pending", priority=5, created=T0 + dt.timedelta(days=1)),
        row("d", "processing", priority=9), row("e", "pending", priority=0),
    ])
    led, claims = L.claim_batch(t, ["w0", "w1"], 3, NOW)
    got = [(r.task_id, r.worker_id) for r in claims.orderBy("claim_rank").collect()]
    assert got == [("c", "w0"), ("a", "w1"), ("b", "w0")]
    assert led.filter("status = 'processing'").count() == 4
    assert led.filter("task_id = 'e'").first().status == "pending"
    assert L.claim_batch(t, ["w0"], 0, NOW)[1].count() == 0
    with pytest.raises(ValueError):
        L.list_tasks(t, limit=-1)
    assert L.list_tasks(t, limit=0).count() == 0


def test_apply_results_guards(spark):
    t = ledger(spark, [row("t1", "processing", started=T0, worker="w1"),
                       row("t2", "processing", started=T0, worker="w1"),
                       row("t3", "pending")])
    res = spark.createDataFrame([
        ("t1", 1, T0, "completed", "w1", "/o/t1", None),
        ("t1", 2, T0 + dt.timedelta(seconds=1), "failed", "w1", None, "late"),
        ("t2", 3, T0, "completed", "w9", "/o/t2", None),
        ("t3", 4, T0, "completed", None, "/o/t3", None),
        ("zz", 5, T0, "completed", None, None, None),
    ], "task_id string, result_id long, ts timestamp_ntz, status string, worker_id string, result_path string, error_message string")
    led, acc, rej = L.apply_results(t, res)
    assert {r.result_id for r in acc.collect()} == {1}
    reasons = {r.result_id: r.reason for r in rej.collect()}
    assert reasons == {2: "duplicate", 3: "worker mismatch", 4: "status pending", 5: "not_found"}
    assert acc.count() + rej.count() == res.count()
    assert led.filter("task_id = 't1'").first().status == "completed"


def test_options_malformed_and_null(spark):
    t = ledger(spark, [row("a", "pending", options="{}"), row("b", "pending", options="{oops"),
                       row("c", "pending", options=None), row("d", "pending", options='{"lang":"en","table_enable":false}')])
    got = {r.task_id: (r.lang, r.method, r.formula_enable, r.table_enable) for r in L.decode_options(t).collect()}
    assert got["a"] == got["b"] == got["c"] == ("ch", "auto", True, True)
    assert got["d"] == ("en", "auto", True, False)


def test_image_refs_resolution(spark):
    docs = spark.createDataFrame([(1, "x ![](images/a.png) y ![alt](http://h/p/b.png) z ![u](c.png)")], "doc_id long, md string")
    images = spark.createDataFrame([(1, "a.png", "http://o/a"), (1, "b.png", "http://o/b")], "doc_id long, name string, url string")
    res = D.resolve_image_refs(docs, images)
    got = {r.ref_idx: (r.alt, r.name, r.url) for r in res.collect()}
    assert got == {0: ("", "a.png", "http://o/a"), 1: ("alt", "b.png", "http://o/b"), 2: ("u", "c.png", None)}
    out = D.rewrite_image_refs(docs, res).first().md_out
    assert out == 'x <img src="http://o/a" alt=""> y <img src="http://o/b" alt="alt"> z ![u](c.png)'
    assert D.rewrite_image_refs(docs, res, enabled=False).first().md_out == docs.first().md


def test_empty_ledger(spark):
    t = ledger(spark, [])
    assert L.queue_stats(t).count() == 0
    snap = L.queue_snapshot(t, NOW).first()
    assert (snap.pending, snap.processing, snap.completed, snap.failed) == (0, 0, 0, 0)


def test_html_converter_blocks():
    from scriptorium.operators.converters import HtmlConverter

    html = ('<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li>menu</li></ul></nav>'
            '<div>ad &amp; more</div><article><h2>Head &amp; x</h2><p><b>one<br><p>two</p><ul><li>item</li></ul>'
            '</article><footer>&copy; f</footer>')
    assert HtmlConverter().convert(html) == [
        ("text", 0, "ad & more"), ("heading", 2, "Head & x"), ("paragraph", 0, "one"),
        ("paragraph", 0, "two"), ("list_item", 0, "item"), ("text", 0, "© f")]


def test_sniff_format(spark):
    df = spark.createDataFrame([(bytes.fromhex(h),) for h in ["255044462D", "FFD8FFE0", "89504E470D", "D0CF11E0A1", "504B0304", "3C68"]], "b binary")
    assert [r.f for r in df.select(C.sniff_format("b").alias("f")).collect()] == ["pdf", "jpg", "png", "ole", "zip", "unsupported"]


def test_affected_rows_observed(spark):
    from scriptorium.plans import fixtures as fx

    t = fx.tasks(spark, "/root/testdata/sf0.01")
    led, obs = L.reset_stale_observed(t, fx.AS_OF, 60)
    led.write.format("noop").mode("overwrite").save()
    assert obs.get["affected_rows"] == 2580  # FIXTURES section 4
    kept, obs2 = L.purge_records_observed(t, fx.AS_OF, 30)
    assert kept.count() == 15000 - 2190 and obs2.get["affected_rows"] == 2190


def test_project_fields_selection(spark):
    t = ledger(spark, [row("done", "completed"), row("gone", "completed", result=None),
                       row("nodir", "completed"), row("wait", "pending")])
    a = spark.createDataFrame([
        ("done", "md", "/r/done/auto/done.md", 10), ("done", "md", "/r/done/auto/done_layout.md", 11),
        ("done", "content_list", "/r/done/auto/done_content_list.json", 12),
        ("done", "image", "/r/done/auto/images/x.png", 5)], "task_id string, kind string, path string, size long")
    v = D.project_fields(t, a, " md , bogus,images", include_metadata=False)
    assert v.columns == ["task_id", "status", "message", "md_file", "images_count"]
    got = {r.task_id: (r.message, r.md_file, r.images_count) for r in v.collect()}
    assert got["done"] == (None, "done.md", 1)
    assert got["gone"][0].startswith("Task completed but result files have been cleaned up")
    assert got["nodir"] == ("Result directory does not exist", None, None)
    assert got["wait"] == ("Task is in pending status, data not available yet", None, None)


def test_html_left_open():
    from scriptorium.operators.converters import HtmlConverter

    c = HtmlConverter().convert
    assert c("<html><head><title>t</title><body><p>one</body></html>") == [("paragraph", 0, "one")]
    assert c("<head><title>t</title><script>x</script></head><p>a</p>") == [("paragraph", 0, "a")]
    assert c("<p>a</p><nav>menu<p>b</p>") == [("paragraph", 0, "a"), ("text", 0, "menu"), ("paragraph", 0, "b")]
    assert c("<nav>menu</nav><p>b</p><script>var x") == [("paragraph", 0, "b")]
    assert c("<table><tr><td>a<td>b</tr><tr><th>c</th><th>d</th></tr></table>") == [("text", 0, "a b"), ("text", 0, "c d")]


def test_silence_since_the_last_event(spark):
    from scriptorium.streaming.jobs import silent_gaps

    e = spark.sql("SELECT * FROM VALUES ('w', timestamp_ntz'2024-01-01 00:00:00', 1L), ('w', timestamp_ntz'2024-01-01 01:00:00', 2L), "
                  "('x', timestamp_ntz'2024-01-01 01:50:00', 3L), ('x', timestamp_ntz'2024-01-01 03:00:00', 4L) t(worker_id, ts, event_id)")
    got = {(r.worker_id, r.silent_from.hour, r.silent_until and r.silent_until.hour) for r in silent_gaps(e, "2024-01-01 02:00:00").collect()}
    assert got == {("w", 0, 1), ("w", 1, None)}
