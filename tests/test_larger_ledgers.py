"""What the document queries move and store beside their results, for ledgers that are larger than the documents."""

from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import types as T

from scriptorium.operators import documents as D
from scriptorium.operators import retrieval as R
from scriptorium.plans import fixtures as fx

from .conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@contextmanager
def _joins_by_sorting(spark):
    """As if no side of a join were small."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _files(spark):
    return spark.sql("SELECT * FROM VALUES ('t1', 'image', '/out/t1/images/b.jpg', 3L, X'FFD8FF'), ('t1', 'image', '/out/t1/images/a/b.jpg', 1L, X'00'), "
                     "('t1', 'image', '/out/t1/images/c.jpg', 1L, CAST(NULL AS BINARY)), ('t2', 'md', '/out/t2/doc_layout.md', 1L, X'41'), "
                     "('t2', 'md', '/out/t2/doc2.md', 1L, X'42') f(task_id, kind, path, size, content)")


def test_result_files_are_not_stored_for_their_readers(spark):
    """the contents of all result files were written to the shared folder before a query read some of them."""
    assert not any("result-files" in f for f in fx.result_files(spark, SF_SMALL).inputFiles())


def test_result_files_shuffle_a_document_once(spark):
    """r04 F5, F6, F8: blocks were stored for every reader and each layout, and the joins of the layouts, shuffled all texts again."""
    with _joins_by_sorting(spark):
        plan = fx.result_files(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Scan ExistingRDD" not in plan


def test_layouts_of_whole_documents_are_those_of_their_blocks(spark):
    docs = spark.createDataFrame([(0, None, "x"), (1, "", "x"), (2, " \n\t", "y"), (3, "# H\n\n- a\n$$x\"$$\n| t |\nthe \u00e9nd", None),
                                  (4, "\n".join(f"line {i}" for i in range(45)), "z"), (5, "\n".join(["- l"] * 20), "z"), (7, "\u2028 a\\b", "")],
                                 "id long, body string, other string").repartition(3)
    flat = D.to_blocks(docs, "id", "body", "text")
    whole = D.to_blocks(docs, "id", "body", "text", whole=True)
    each = D.middle_json(D.content_list(D.blocks_to_markdown(whole)))
    assert _exchanges(each) == 0
    want = (D.blocks_to_markdown(flat).join(D.content_list(flat), "doc_id").join(D.middle_json(flat), "doc_id"))
    cols = ["doc_id", "markdown", "n_blocks", "content_list", "n_pages", "middle_json"]
    assert each.filter("markdown is not null").select(cols).orderBy("doc_id").collect() == want.select(cols).orderBy("doc_id").collect()
    none = each.filter("markdown is null").orderBy("doc_id").collect()
    assert [(r.doc_id, r.body, r.other, r.n_blocks, r.content_list, r.n_pages, r.middle_json) for r in none] == [
        (0, None, "x", None, None, None, None), (1, "", "x", None, None, None, None), (2, " \n\t", "y", None, None, None, None)]


def test_images_map_shuffles_bytes_once(spark):
    """bytes were shuffled by task and name, then their base64 text by task."""
    m = D.images_map(_files(spark).repartition(2))
    assert _exchanges(m) == 1
    assert [(r.task_id, r.images) for r in m.collect()] == [
        ("t1", {"b.jpg": "data:image/jpeg;base64,AA==", "c.jpg": None})]


def test_inventory_encodes_after_the_shuffle(spark):
    """the base64 text was made before the images were gathered by task."""
    tasks = spark.sql("SELECT 't1' AS task_id")
    inv = D.image_inventory(tasks, _files(spark), include_base64=True)
    gathered = _plan(inv)
    assert "base64" not in gathered[gathered.index("Aggregate"):].split("collect_list(", 1)[1].splitlines()[0].split("0, 0)")[0]
    got = inv.first()
    assert [(i.path, i.base64) for i in got.images] == [("/out/t1/images/a/b.jpg", "AA=="), ("/out/t1/images/b.jpg", "/9j/"), ("/out/t1/images/c.jpg", None)]


def _sorted_bytes(df):
    """Whether the aggregate by task reads ``content`` as it is, of every file."""
    lines = [x for x in _plan(df).splitlines()]
    return not any("Project" in x and "CASE WHEN" in x and "AS content#" in x for x in lines)


def test_status_view_aggregates_markdown_only(spark):
    """F16: the bytes of images and JSON went through the sort of the aggregate."""
    tasks = spark.sql("SELECT 't2' AS task_id, 'completed' AS status, 'f' AS file_name, 'b' AS backend, 0 AS priority, NULL AS error_message, '/r' AS result_path, "
                      "NULL AS created_at, NULL AS started_at, NULL AS completed_at, NULL AS worker_id, 0 AS retry_count")
    view = D.task_status_view(tasks, _files(spark).repartition(2))
    assert not _sorted_bytes(view)
    assert [(r.data_markdown_file, r.data_content, r.data_has_images) for r in view.collect()] == [("doc2.md", "B", False)]


def test_fields_aggregate_only_bytes_that_are_asked_for(spark):
    """the bytes of images and of Markdown variants went through the sort of the aggregate."""
    tasks = spark.sql("SELECT 't2' AS task_id, 'completed' AS status, '/r' AS result_path")
    out = D.project_fields(tasks, _files(spark).repartition(2), "md,images", include_metadata=False)
    assert not _sorted_bytes(out)
    assert [(r.md_file, r.md_content, r.images_count) for r in out.collect()] == [("doc2.md", "B", 0)]


def test_converted_tasks_are_written_once_as_columns(spark):
    """Markdown was shuffled again to meet its task's owner and stored row by row, uncompressed."""
    tasks = spark.sql("SELECT 't1' AS task_id, 'processing' AS status, 'a.md' AS file_name, 'w1' AS worker_id, '{}' AS options, CAST(NULL AS STRING) AS result_path, "
                      "CAST(NULL AS STRING) AS error_message, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS started_at, CAST(NULL AS TIMESTAMP_NTZ) AS completed_at, 0 AS retry_count")
    files = spark.sql("SELECT 't1' AS task_id, CAST('# A' AS BINARY) AS content")
    results, _ = D.convert_tasks(tasks, files, "2024-01-01 00:02:00", "/out")
    assert results.inputFiles() and all("converted-" in f for f in results.inputFiles())
    assert [(r.task_id, r.worker_id, r.status, r.result_path, r.markdown) for r in results.collect()] == [("t1", "w1", "completed", "/out/t1", "# A")]


def test_contents_of_other_tasks_are_not_fetched(spark, monkeypatch):
    """r04 F7, F9: the contents of all tasks were shuffled to meet the few that are processed."""
    tasks = spark.range(40).selectExpr("concat('t', id) AS task_id", "if(id % 4 = 0, 'processing', 'pending') AS status", "'a.md' AS file_name", "'w1' AS worker_id", "'{}' AS options",
                                       "CAST(NULL AS STRING) AS result_path", "CAST(NULL AS STRING) AS error_message", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS started_at",
                                       "CAST(NULL AS TIMESTAMP_NTZ) AS completed_at", "0 AS retry_count")
    texts = spark.range(5).selectExpr("id AS k", "CAST(concat('# ', id) AS BINARY) AS content")
    files = tasks.selectExpr("task_id", "CAST(substr(task_id, 2) AS BIGINT) % 5 AS k").join(texts, "k").select("task_id", "content")
    plans, written = [], D._written
    monkeypatch.setattr(D, "_written", lambda df, label: plans.append(_plan(df)) or written(df, label))
    with _joins_by_sorting(spark):
        results, ledger = D.convert_tasks(tasks, files, "2024-01-01 00:02:00", "/out")
    assert 0 < plans[0].index("Join Inner, (k#") < plans[0].index("Join LeftSemi")  # the tasks are chosen before their texts join them
    assert {r.task_id: r.markdown for r in results.collect()} == {f"t{i}": f"# {i % 5}" for i in range(0, 40, 4)}
    assert {r.task_id: r.status for r in ledger.collect()} == {f"t{i}": "pending" if i % 4 else "completed" for i in range(40)}


class _Frame:
    """Stands for a DataFrame: gives the function that its tasks would run."""

    def __init__(self, schema):
        self.schema, self.columns = schema, schema.names

    def mapInArrow(self, run, schema):
        return run

    mapInPandas = mapInArrow


def test_conversion_holds_few_documents_at_a_time():
    """a worker held a whole Arrow batch, up to 10,000 documents, as Python objects."""
    names = ["doc_id", "route", "content", "equation", "table", "converter", "ready"]
    frame = _Frame(T.StructType([T.StructField(n, T.LongType() if n == "doc_id" else T.StringType()) for n in names]))
    run = D._converted(frame, {"text": "text"}, dealt=True)
    n = 3 * D.CONVERT_ROWS + 5
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(["text_like"] * n), pa.array([f"line {i}" for i in range(n)]), pa.array([True] * n),
                                        pa.array([True] * n), pa.array(["text"] * n), pa.nulls(n)], names=names)
    out = list(run(iter([batch])))
    assert max(b.num_rows for b in out) <= D.CONVERT_ROWS
    assert [x for b in out for x in b.column("markdown").to_pylist()] == [f"line {i}" for i in range(n)]
    assert [x for b in out for x in b.column("doc_id").to_pylist()] == list(range(n))


def test_cells_are_named_in_tiles():
    """a worker held the scores of a whole Arrow batch, and a row with its vector for each of its cells."""
    rng = np.random.default_rng(3)
    vectors, centres = rng.normal(size=(700, 8)), R._unit_rows(rng.normal(size=(300, 8)))

    class Shipped:
        value = centres

    run = R.nearest_cells(_Frame(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType()))])), "doc_id", Shipped, 200)
    out = list(run(iter([pd.DataFrame({"doc_id": np.arange(700), "v": list(vectors)})])))
    assert max(len(f) for f in out) <= 1 << 15
    got = pd.concat(out)
    best = np.argsort(-(R._unit_rows(vectors) @ centres.T), axis=1, kind="stable")[:, :200]
    assert got["doc_id"].tolist() == np.repeat(np.arange(700), 200).tolist()
    assert (got["cell"].to_numpy().reshape(700, 200) == best).all() and (got["place"].to_numpy().reshape(700, 200) == np.arange(200)).all()


def test_ingest_files_grow_with_the_input(spark, monkeypatch):
    """the documents were staged in four files whatever their size, each written by one task."""
    from scriptorium.plans import registry_streaming as RS

    seen, class_ = {}, type("Stop", (Exception,), {})

    def stop(spark, src, *_, max_files, **__):
        seen.update(files=len(spark.read.parquet(src).inputFiles()), rows=spark.read.parquet(src).count(), max_files=max_files)
        raise class_

    monkeypatch.setattr(RS.J, "ingest_stream", stop)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(16 << 10))
    try:
        RS.k1(spark, SF_SMALL)
    except class_:
        pass
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert seen["files"] > 4 and seen["max_files"] == (seen["files"] + 1) // 2 and seen["rows"] == RS.docs_in(spark, SF_SMALL).count()
