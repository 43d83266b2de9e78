"""Document jobs: route, convert, assemble Markdown / content lists, and serve result artifacts.

Conversion is the one genuinely per-document Python step; it runs in ``mapInArrow`` so Spark
partitions the documents, Arrow carries the batches and each task keeps one converter instance.
Everything around it (routing, assembly, joins with artifacts, projections) is built-in
expressions and joins.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..session import scratch_path, spread
from . import converters as CV
from . import formats as FM
from . import ledger as L

BLOCK_FIELDS = [T.StructField("block_idx", T.IntegerType()), T.StructField("type", T.StringType()),
                T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType())]
CONVERT_ROWS = 256  # documents that a worker holds as Python objects at a time


def _converter(name_or_obj):
    if isinstance(name_or_obj, CV.Converter):
        return name_or_obj
    if isinstance(name_or_obj, type):
        return name_or_obj()
    return CV.DEFAULT_CONVERTERS[name_or_obj]()


# ------------------------------------------------------------------ P1 / X1: documents -> blocks

BLOCK = T.StructType(BLOCK_FIELDS)


def to_blocks(docs: DataFrame, id_col: str, content_col: str, converter="html", errors: bool = False, whole: bool = False) -> DataFrame:
    """One row per block ``(doc_id, block_idx, type, level, text)``. With ``errors``, a document whose
    conversion raises gives one row ``(doc_id, -1, "error", NULL, message)``; otherwise it gives no
    blocks here and ``convert_documents`` / ``route_and_union`` record it as failed. Batches may be
    empty or hold documents without any block. ``whole`` keeps one row per document, all its columns and its
    blocks in order as the array ``blocks``: what is assembled per document then needs no shuffle."""
    spec = converter
    if whole:
        docs = docs.withColumnRenamed(id_col, "doc_id")
        schema = T.StructType(docs.schema.fields + [T.StructField("blocks", T.ArrayType(BLOCK))])
    else:
        schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType)] + BLOCK_FIELDS)
        docs = docs.select(id_col, content_col)
    names, at = schema.names, docs.columns.index(content_col)

    def run(batches):
        conv = _converter(spec)
        conv.open()
        for batch in (b.slice(i, CONVERT_ROWS) for b in batches for i in range(0, b.num_rows, CONVERT_ROWS)):
            src, idx, typ, lvl, txt, ends = [], [], [], [], [], [0]
            for row, content in enumerate(batch.column(at).to_pylist()):
                try:
                    blocks = [(i, *b) for i, b in enumerate(conv.convert(content))]
                except Exception as e:  # one bad document must not fail the batch
                    blocks = [(-1, "error", None, f"{type(e).__name__}: {e}")] if errors else []
                for i, t, level, text in blocks:
                    src.append(row), idx.append(i), typ.append(t), lvl.append(level), txt.append(text)
                ends.append(len(src))
            cols = [pa.array(idx, pa.int32()), pa.array(typ, pa.string()), pa.array(lvl, pa.int32()), pa.array(txt, pa.string())]
            if whole:
                each = pa.StructArray.from_arrays(cols, names=BLOCK.names)
                out = [*batch.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)]
            else:
                out = [batch.column(0).take(pa.array(src, pa.int32())), *cols]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return spread(docs).mapInArrow(run, schema)


def html_to_blocks(pages: DataFrame) -> DataFrame:
    """HTML pages to blocks."""
    return to_blocks(pages, "page_id", "html", "html")


# ------------------------------------------------------------------ P2-P6: assembling blocks

def block_markdown(type_: Column, level: Column, text: Column) -> Column:
    return (F.when(type_ == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text))
            .when(type_ == "list_item", F.concat(F.lit("- "), text))
            .when(type_ == "equation", F.concat(F.lit("$$"), text, F.lit("$$")))
            .when(type_ == "image", F.concat(F.lit("![]("), text, F.lit(")")))
            .otherwise(text))


def _in_place(blocks: DataFrame) -> Column | None:
    """The blocks of rows that are whole documents (``to_blocks`` with ``whole``), NULL where there are none; a column
    that P2-P4 make of them is added to the others."""
    return F.when(F.size("blocks") > 0, F.col("blocks")) if "blocks" in blocks.columns else None


def blocks_to_markdown(blocks: DataFrame) -> DataFrame:
    """Markdown per document: blocks in order, blank line between. The group is one document's
    blocks, which came from a single input row, so its size is bounded by that row."""
    if (whole := _in_place(blocks)) is not None:
        return blocks.withColumn("markdown", F.array_join(F.transform(whole, lambda b: block_markdown(b["type"], b["level"], b["text"])), "\n\n"))
    md = F.struct(F.col("block_idx"), block_markdown(F.col("type"), F.col("level"), F.col("text")).alias("md"))
    return (blocks.groupBy("doc_id")
            .agg(F.array_sort(F.collect_list(md)).alias("_b"))
            .select("doc_id", F.array_join(F.transform("_b", lambda b: b["md"]), "\n\n").alias("markdown")))


def content_list(blocks: DataFrame) -> DataFrame:
    """Ordered block structs per document (``to_json`` gives the JSON content list)."""
    if (whole := _in_place(blocks)) is not None:
        return blocks.withColumns({"n_blocks": F.when(whole.isNotNull(), F.size("blocks")), "content_list": whole})
    b = F.struct("block_idx", "type", "level", "text")
    return (blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(b)).alias("content_list"))
            .select("doc_id", F.size("content_list").alias("n_blocks"), "content_list"))


def middle_json(blocks: DataFrame, page_size: int = 20) -> DataFrame:
    """Nested document -> pages -> blocks, as JSON text. Text has no pages, so a page is
    ``page_size`` consecutive blocks."""
    if (whole := _in_place(blocks)) is not None:  # a block's index is its place
        n_pages = F.when(whole.isNotNull(), F.ceil(F.size("blocks") / page_size).cast("int"))
        pages = F.transform(F.sequence(F.lit(0), n_pages - 1), lambda p: F.struct(p.alias("page_idx"), F.transform(
            F.slice("blocks", p * page_size + 1, page_size), lambda b: F.struct(b["block_idx"], b["type"], b["text"])).alias("blocks")))
        json = F.to_json(F.struct(F.col("doc_id"), pages.alias("pages")))
        return blocks.withColumns({"n_pages": n_pages, "middle_json": F.when(whole.isNotNull(), json)})
    paged = blocks.withColumn("page_idx", (F.col("block_idx") / page_size).cast("int"))
    pages = (paged.groupBy("doc_id", "page_idx")
             .agg(F.array_sort(F.collect_list(F.struct("block_idx", "type", "text"))).alias("blocks")))
    return (pages.groupBy("doc_id")
            .agg(F.array_sort(F.collect_list(F.struct("page_idx", "blocks"))).alias("pages"))
            .select("doc_id", F.size("pages").alias("n_pages"),
                    F.to_json(F.struct(F.col("doc_id"), F.col("pages"))).alias("middle_json")))


def read_middle_json(docs: DataFrame, col: str = "middle_json") -> DataFrame:
    """P4 read back as data: one row per block (doc_id, page_idx, block_idx, type, text, malformed) of a nested
    JSON column, by path on a Variant. Malformed or NULL JSON, and JSON without pages or blocks, give one row of
    NULLs (``malformed`` only where there was text that is not valid JSON); members of another type are NULL."""
    tvf = docs.sparkSession.tvf
    v = docs.select("doc_id", F.col(col).alias("_json")).withColumn("_v", F.try_parse_json("_json"))

    def each(path, out):
        return tvf.variant_explode_outer(path).select(F.col("value").alias(out))

    pages = v.lateralJoin(each(F.try_variant_get(F.col("_v").outer(), "$.pages", "variant"), "_page"))
    blocks = pages.lateralJoin(each(F.try_variant_get(F.col("_page").outer(), "$.blocks", "variant"), "_block"))
    return blocks.select(
        "doc_id", F.try_variant_get("_page", "$.page_idx", "int").alias("page_idx"),
        *[F.try_variant_get("_block", f"$.{name}", kind).alias(name) for name, kind in (("block_idx", "int"), ("type", "string"), ("text", "string"))],
        (F.col("_json").isNotNull() & F.col("_v").isNull()).alias("malformed"))


def with_pages(blocks: DataFrame, page_size: int = 20) -> DataFrame:
    return blocks.withColumn("page_idx", (F.col("block_idx") / page_size).cast("int"))


def slice_pages(blocks: DataFrame, params: DataFrame) -> DataFrame:
    """P5: keep pages ``start..end`` (0-based, inclusive; start default 0, end NULL = to the end).
    ``params`` (doc_id, start_page_id, end_page_id) is optional per document."""
    p = params.select("doc_id", "start_page_id", "end_page_id")
    j = blocks.join(p, "doc_id", "left")
    start = F.coalesce("start_page_id", F.lit(0))
    keep = (F.col("page_idx") >= start) & (F.col("end_page_id").isNull() | (F.col("page_idx") <= F.col("end_page_id")))
    return j.filter(keep).drop("start_page_id", "end_page_id")


def element_toggles(blocks: DataFrame, opts: DataFrame) -> DataFrame:
    """Drop equation blocks where formulas are disabled and table blocks where tables are."""
    j = blocks.join(opts.select("doc_id", "formula_enable", "table_enable"), "doc_id", "left")
    drop = ((F.col("type") == "equation") & ~F.coalesce("formula_enable", F.lit(True))) | \
           ((F.col("type") == "table") & ~F.coalesce("table_enable", F.lit(True)))
    return j.filter(~drop).drop("formula_enable", "table_enable")


# ------------------------------------------------------------------ P7, S1, S2: conversion batch

OUTCOME_FIELDS = [
    T.StructField("route", T.StringType()), T.StructField("converter", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("n_blocks", T.IntegerType()),
    T.StructField("markdown", T.StringType()), T.StructField("error_message", T.StringType()),
]


def converter_for(file_name: Column, route: Column, table: Mapping[str, str] | None = None) -> Column:
    """Converter name per document: page/image route has none by default (no layout/OCR model);
    on the text route the suffix picks html / markdown / csv / json / xml, anything else is plain text."""
    table = {**CV.TEXT_ROUTE_CONVERTERS, **FM.SUFFIX_READERS} if table is None else dict(table)
    suf = C.file_suffix(file_name)
    expr = F.when(route == "page_image", F.lit(None).cast("string"))
    for s, name in table.items():
        expr = expr.when(suf == s, name)
    return expr.otherwise("text")


def convert_documents(docs: DataFrame, converters: Mapping[str, object] | None = None, routing: Routing | None = None) -> DataFrame:
    """Docs (doc_id, file_name, content) -> one outcome row per document. Ids keep their type;
    content is text or bytes (UTF-8 for texts; zip files are read as Office documents whatever their name);
    ``formula_enable`` / ``table_enable``, where present and false, drop those blocks.

    Routing and the converter choice are JVM expressions; a single Arrow pass then runs each document
    through its converter (one scan of the input rather than one per branch). A document whose
    converter raises becomes ``failed`` with the error text; a route without a converter becomes
    ``failed`` ("No converter for route ..."); the others continue. A stream makes its ``routing`` once."""
    return _converted(*_routed(docs, converters, routing))


def documents_to_blocks(docs: DataFrame, converters: Mapping[str, object] | None = None) -> DataFrame:
    """P1 for files of every format that ``convert_documents`` reads: one row per block, and one row
    ``(doc_id, -1, "error", NULL, message)`` for a document that cannot be read."""
    return _converted(*_routed(docs, converters), as_blocks=True)


@dataclass
class Routing:
    """The expressions of ``_routed``, which name columns but no table: some 2,000 calls to the JVM make them, most of
    the time that a small batch takes to plan, so they serve every micro-batch of a stream."""

    columns: list[Column]
    converter: Column
    ready: Column
    content: Column
    converters: dict[str, object]


def routing(schema: T.StructType, converters: Mapping[str, object] | None = None) -> Routing:
    """Route, converter and options per document of ``schema``. CSV and JSON leave as blocks (``ready``), unless the
    caller brings a converter of that name; their content does not reach Python."""
    convs = {**CV.DEFAULT_CONVERTERS, **FM.READERS, **(converters or {})}
    built_in = {k: f for k, f in FM.BUILT_IN.items() if k not in convs}

    def option(name):
        return F.coalesce(F.col(name), F.lit(True)) if name in schema.names else F.lit(True)

    columns = [F.col("doc_id"), C.route_by_suffix("file_name").alias("route"), F.col("content"), F.col("file_name"),
               option("formula_enable").alias("equation"), option("table_enable").alias("table")]
    named = converter_for(F.col("file_name"), F.col("route"))
    if isinstance(schema["content"].dataType, T.BinaryType):
        zipped = (F.col("route") == "text_like") & (C.sniff_format("content") == "zip")
        named = F.when(zipped, "office").otherwise(named)
    ready = F.lit(None).cast(FM.BLOCKS)
    for name, read in built_in.items():
        ready = F.when(F.col("converter") == name, read(F.col("content").cast("string"))).otherwise(ready)
    content = F.when(F.coalesce(~F.col("converter").isin(list(built_in)), F.lit(True)), F.col("content"))
    return Routing(columns, named, ready, content, {**convs, **dict.fromkeys(built_in)})


def _routed(docs: DataFrame, converters: Mapping[str, object] | None, made: Routing | None = None) -> tuple[DataFrame, dict[str, object]]:
    made = made or routing(docs.schema, converters)
    routed = docs.select(*made.columns).withColumn("converter", made.converter)
    return routed.drop("file_name").withColumn("ready", made.ready).withColumn("content", made.content), made.converters


def _converted(routed: DataFrame, convs: Mapping[str, object], as_blocks: bool = False, dealt: bool = False) -> DataFrame:
    """One outcome per row of ``routed`` (doc_id, route, content, equation, table, converter, and ``ready`` for
    the converters named None), from one Arrow pass: the outcome leaves beside the row's id, so ids may be NULL
    or repeat. ``as_blocks`` gives the blocks instead; ``dealt`` rows come from a shuffle and stay where they are."""
    fields = BLOCK_FIELDS if as_blocks else OUTCOME_FIELDS
    schema = T.StructType([routed.schema["doc_id"]] + fields)
    names = schema.names
    used = ("route", "converter", "content", "equation", "table", "ready")
    if "ready" not in routed.columns:
        routed = routed.withColumn("ready", F.lit(None).cast(FM.BLOCKS))

    def run(batches):
        inst = {}

        def one(route, cname, content, equation, table, ready):
            """The blocks of a document, or the reason why there are none."""
            if cname is None or cname not in convs:
                return None, f"No converter for route {route or 'unknown'}"
            try:
                off = {k for k, on in (("equation", equation), ("table", table)) if not on}
                if convs[cname] is None:
                    if ready is None:
                        raise ValueError(f"not valid {cname.upper()}")
                    return [(b["type"], b["level"], b["text"]) for b in ready if b["type"] not in off], None
                if cname not in inst:
                    conv = _converter(convs[cname])
                    conv.open()
                    inst[cname] = conv
                if isinstance(content, (bytes, bytearray)) and not inst[cname].raw:
                    content = content.decode("utf-8")
                return [x for x in inst[cname].convert(content) if x[0] not in off], None
            except Exception as e:  # noqa: BLE001 - recorded as the document's outcome
                return None, f"{type(e).__name__}: {e}"

        for batch in (b.slice(at, CONVERT_ROWS) for b in batches for at in range(0, b.num_rows, CONVERT_ROWS)):
            rows = [one(*r) for r in zip(*(batch.column(c).to_pylist() for c in used))]
            if as_blocks:
                flat = [(row, i, *b) for row, (blocks, why) in enumerate(rows)
                        for i, b in (enumerate(blocks) if why is None else [(-1, ("error", None, why))])]
                cols = list(zip(*flat)) or [()] * 5
                first = [batch.column("doc_id").take(pa.array(cols.pop(0), pa.int32()))]
                types = (pa.int32(), pa.string(), pa.int32(), pa.string())
            else:
                cols = [["failed" if why else "completed" for _, why in rows],
                        [None if why else len(blocks) for blocks, why in rows],
                        [None if why else "\n\n".join(_md_line(*b) for b in blocks) for blocks, why in rows],
                        [why for _, why in rows]]
                first = [batch.column(c) for c in ("doc_id", "route", "converter")]
                types = (pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(first + [pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return (routed if dealt else spread(routed)).mapInArrow(run, schema)


def convert_tasks(tasks: DataFrame, files: DataFrame, now, root: str,
                  converters: Mapping[str, object] | None = None) -> tuple[DataFrame, DataFrame]:
    """P7 over the ledger: every processing task whose file (task_id, content) is at hand is converted
    under its own options and the outcome goes back through the guard of J3. Returns
    ``(results, ledger')``; a completed task gets ``{root}/{task_id}`` as result path, a failed one its
    error. Processing tasks without a file stay as they are (U3 resets them). The results are written to
    the shared folder first, so that both sides read one conversion. Contents are shuffled once, for the
    join: they are converted where it leaves them, and a task's owner travels in its id. The semi join goes through
    what ``files`` is made of, so that contents of other tasks are not fetched for it."""
    open_ = tasks.filter(F.col("status") == "processing")
    wanted = files.select("task_id", "content").join(open_.select("task_id"), "task_id", "left_semi")
    todo = (L.decode_options(open_).join(wanted, "task_id")
            .select(F.struct("task_id", "worker_id").alias("doc_id"), "file_name", "content", "formula_enable", "table_enable"))
    done = _converted(*_routed(todo, converters), dealt=True).select("doc_id.*", *[f.name for f in OUTCOME_FIELDS])
    results = _written(done.select(
        "task_id", F.col("task_id").alias("result_id"), F.lit(now).cast("timestamp_ntz").alias("ts"), "status", "worker_id",
        F.when(F.col("status") == "completed", F.concat(F.lit(root.rstrip("/") + "/"), "task_id")).alias("result_path"),
        "error_message", "route", "converter", "n_blocks", "markdown"), "converted")
    ledger, _, _ = L.apply_results(tasks, results)
    return results, ledger


def _written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as Parquet in the shared folder: compressed, and a reader of few columns reads no texts."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def _md_line(t, level, text):
    if t == "heading":
        return "#" * level + " " + text
    if t == "list_item":
        return "- " + text
    if t == "equation":
        return "$$" + text + "$$"
    if t == "image":
        return "![](" + text + ")"
    return text


def route_and_union(docs: DataFrame, branches: Mapping[str, object]) -> DataFrame:
    """Split by route, convert each branch with its own converter, recombine by name. ``branches``
    maps a route to a converter. Every document comes back once: a document whose conversion raises, a
    route without a converter and a missing file name give ``failed`` with the reason."""
    route = C.route_by_suffix("file_name")
    convs = {r: conv for r, conv in branches.items() if conv is not None}
    routed = docs.select("doc_id", route.alias("route"), "content", F.lit(True).alias("equation"), F.lit(True).alias("table"))
    out = _converted(routed.withColumn("converter", F.when(F.col("route").isin(list(convs)), F.col("route"))), convs)
    names = {r: _converter(conv).name for r, conv in convs.items()}
    named = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("converter")] if names else F.lit(None).cast("string")
    return out.select("doc_id", "route", named.alias("converter"), "status", "n_blocks", "error_message")


def split_outcomes(outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(succeeded, dead letters). Callers persist ``outcomes`` first so both filters read one
    materialisation instead of converting twice."""
    ok = F.col("status") == "completed"
    return outcomes.filter(ok), outcomes.filter(~ok | F.col("status").isNull())


# ------------------------------------------------------------------ artifacts

# fixed values: artifact kinds by file-name pattern
ARTIFACT_PATTERNS = [
    ("content_list", r"_content_list\.json$"),
    ("middle_json", r"_middle\.json$"),
    ("model_output", r"_model\.json$"),
    ("layout_pdf", r"(_|^)layout\.pdf$"),
    ("span_pdf", r"(_|^)span\.pdf$"),
    ("origin_pdf", r"(_|^)origin\.pdf$"),
    ("md", r"\.md$"),
]


def is_image(path) -> Column:
    """A file with an image extension in an ``images`` folder."""
    p = F.col(path) if isinstance(path, str) else path
    return p.contains("/images/") & C.file_suffix(p).isin(C.IMAGE_EXTENSIONS)


def classify_artifact(path: Column) -> Column:
    """A2: kind of a result file from its path (images by extension under ``images/``)."""
    name = C.basename(path)
    expr = F.when(is_image(path), "image")
    for kind, pat in ARTIFACT_PATTERNS:
        expr = expr.when(name.rlike(pat), kind)
    return expr.otherwise("other")


def first_artifact(artifacts: DataFrame, exclude_md_variants: bool = True) -> DataFrame:
    """One artifact per (task, kind), the smallest path. For Markdown the data endpoint skips
    stems ending in _layout/_span/_origin. ``min_by`` is a partial+final hash aggregate."""
    a = artifacts
    if exclude_md_variants:
        stem = C.file_stem("path")
        a = a.filter(~((F.col("kind") == "md") & stem.rlike("_(layout|span|origin)$")))
    return (a.groupBy("task_id", "kind")
            .agg(F.min_by(F.struct("path", "size"), F.col("path")).alias("f"))
            .select("task_id", "kind", "f.path", "f.size"))


def image_inventory(tasks: DataFrame, artifacts: DataFrame, include_base64: bool = False,
                    uploaded: bool = False) -> DataFrame:
    """A5: per task, count and path-sorted list of images (allowed extensions, case-insensitive);
    tasks without images get count 0 and a NULL list. With ``uploaded`` an entry carries the ``url``
    column of ``artifacts`` (NULL for an object that failed to upload); otherwise, with
    ``include_base64``, the base64 text of ``content`` (NULL where the file could not be read). The list
    is one task's images (one document's output), so it is bounded by that document."""
    img = artifacts.filter(is_image("path"))
    entry = [F.col("path"), C.basename("path").alias("name"), F.col("size")]
    if uploaded:
        entry.append(F.col("url"))
    elif include_base64:
        entry.append(F.col("content"))
    images = F.array_sort(F.collect_list(F.struct(*entry)))
    if include_base64 and not uploaded:  # bytes travel, a third shorter than their text
        images = F.transform(images, lambda i: F.struct(i["path"], i["name"], i["size"], C.b64_encode(i["content"]).alias("base64")))
    per = img.groupBy("task_id").agg(F.count(F.lit(1)).alias("image_count"), images.alias("images"))
    return (tasks.select("task_id").join(per, "task_id", "left")
            .select("task_id", F.coalesce("image_count", F.lit(0)).alias("image_count"), "images",
                    F.lit(uploaded).alias("uploaded")))


def plan_object_urls(images: DataFrame, endpoint: str, bucket: str, scheme: str = "http") -> DataFrame:
    """A10: deterministic object name and public URL per image (task_id, path; ``content`` passes through
    where present). ``sources.objects.upload_objects`` copies them."""
    obj = C.object_name(F.col("task_id"), C.basename("path"))
    return images.select("task_id", "path", obj.alias("object_name"), C.object_url(endpoint, bucket, obj, scheme).alias("url"),
                         *(["content"] if "content" in images.columns else []))


def tasks_with_artifacts(tasks: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Every task with its files; tasks without files keep one row with NULL file columns."""
    return tasks.join(artifacts, "task_id", "left")


def resolve_image_refs(docs: DataFrame, images: DataFrame) -> DataFrame:
    """Image references of each Markdown text joined on (doc, basename) with the image
    inventory; unresolved refs keep url NULL. Of several images with one basename in a document the one with the
    smallest URL stands for all (a NULL url only if none has one), so no reference is doubled."""
    refs = docs.select("doc_id", F.posexplode(C.image_refs("md")).alias("ref_idx", "r")).select(
        "doc_id", "ref_idx", "r.match", "r.alt", "r.path", "r.name")
    one = images.groupBy("doc_id", "name").agg(F.min("url").alias("url"))
    return refs.join(one, ["doc_id", "name"], "left")


def rewrite_image_refs(docs: DataFrame, resolved: DataFrame, enabled: bool = True) -> DataFrame:
    """F8: replace each resolved ref with an ``<img>`` tag; others stay verbatim. Re-assembles per
    document from the (bounded) list of that document's own refs."""
    if not enabled:
        return docs.select("doc_id", F.col("md").alias("md_out"))
    html = (resolved.filter(F.col("url").isNotNull())
            .groupBy("doc_id")
            .agg(F.array_sort(F.collect_list(F.struct("ref_idx", "match", C.img_tag(F.col("url"), F.col("alt")).alias("html"))))
                 .alias("subs")))
    j = docs.join(html, "doc_id", "left")
    return j.select("doc_id", C.rewrite_refs(F.col("md"), F.coalesce("subs", F.array().cast(html.schema["subs"].dataType)))
                    .alias("md_out"))


def _is_variant(path: str) -> Column:
    return C.file_stem(path).rlike("_(layout|span|origin)$")


def _first(kind: str, *fields: str, skip_variants: bool = False) -> Column:
    """Fields of the artifact of one kind with the smallest path, as one conditional aggregate."""
    cond = F.col("kind") == kind
    if skip_variants:
        cond = cond & ~_is_variant("path")
    return F.min_by(F.when(cond, F.struct(C.basename("path").alias("file_name"), *fields)), F.when(cond, F.col("path")))


def served_markdown(docs: DataFrame, artifacts: DataFrame, upload_images: bool) -> DataFrame:
    """Markdown text as the endpoints return it: ``docs`` (doc_id, md); with ``upload_images`` the
    references to images of the same task that have a ``url`` become ``<img>`` tags."""
    if not upload_images:
        return docs.select("doc_id", F.col("md").alias("md_out"))
    urls = (artifacts.filter(is_image("path")).groupBy(F.col("task_id").alias("doc_id"), C.basename("path").alias("name"))
            .agg(F.min_by("url", "path").alias("url")))  # one url for a name that occurs twice
    return rewrite_image_refs(docs, resolve_image_refs(docs, urls))


def task_status_view(tasks: DataFrame, artifacts: DataFrame, upload_images: bool = False) -> DataFrame:
    """The status row; for completed tasks with files the data part has the first Markdown file (the
    status endpoint does not skip _layout variants), its content, whether images were uploaded, and
    whether images exist (NULL when they were uploaded). One aggregate reads the artifacts, one join
    brings them to the tasks."""
    # bytes of other kinds do not enter the aggregate, which sorts and shuffles its rows
    files = artifacts.select("task_id", "kind", "path", F.when(F.col("kind") == "md", F.col("content")).alias("content"))
    per = files.groupBy("task_id").agg(_first("md", "content").alias("_md"), F.max(F.col("kind") == "image").alias("_img"))
    j = tasks.join(per, "task_id", "left")
    completed = F.col("status") == "completed"
    with_data = completed & F.col("result_path").isNotNull() & F.col("_md").isNotNull()
    view = j.select(
        "task_id", "status", "file_name", "backend", "priority", "error_message", "result_path",
        "created_at", "started_at", "completed_at", "worker_id", "retry_count",
        F.when(with_data, F.col("_md.file_name")).alias("data_markdown_file"),
        F.when(with_data, F.col("_md.content").cast("string")).alias("data_content"),
        F.when(with_data, F.lit(upload_images)).alias("data_images_uploaded"),
        F.when(with_data & ~F.lit(upload_images), F.coalesce("_img", F.lit(False))).alias("data_has_images"),
        F.when(completed & F.col("result_path").isNull(), F.lit(C.MSG_CLEANED)).alias("message"),
    )
    if not upload_images:
        return view
    docs = view.filter(F.col("data_content").isNotNull()).select(F.col("task_id").alias("doc_id"), F.col("data_content").alias("md"))
    new = served_markdown(docs, artifacts, True).withColumnRenamed("doc_id", "task_id")
    return view.join(new, "task_id", "left").withColumn("data_content", F.coalesce("md_out", "data_content")).drop("md_out")


# fixed values: requestable result fields and the default selection
RESULT_FIELDS = ["md", "content_list", "middle_json", "model_output", "images", "layout_pdf", "span_pdf", "origin_pdf"]
DEFAULT_FIELDS = "md,content_list,middle_json,model_output,images"


def project_fields(tasks: DataFrame, artifacts: DataFrame, include_fields: str = DEFAULT_FIELDS,
                   include_metadata: bool = True, upload_images: bool = False,
                   include_image_base64: bool = False) -> DataFrame:
    """The data endpoint. The comma list is parsed on the driver (it is an argument, not data).
    ``artifacts`` has task_id, kind, path, size, modified_at and content (``url`` too with
    ``upload_images``); a bare listing without content gives names, sizes and counts only. Markdown comes with its text, JSON artifacts with theirs unless malformed (then
    the whole field is absent), PDFs with their path; metadata is size and modification time; images are
    the list of A5. Columns of fields not asked for are never read, and one aggregate per task
    gathers the files. Non-completed tasks get only the status message."""
    wanted = [f for f in (x.strip() for x in include_fields.split(",")) if f in RESULT_FIELDS]
    kinds = [k for k in RESULT_FIELDS if k in wanted and k != "images"]
    meta = [m for m in ("size", "modified_at") if include_metadata and m in artifacts.columns]
    bare = "content" not in artifacts.columns
    firsts = [_first(k, *meta, "path" if bare or k.endswith("_pdf") else "content", skip_variants=k == "md").alias(k)
              for k in kinds]
    files = artifacts
    if not bare:  # bytes that no field asks for do not enter the aggregate, which sorts and shuffles its rows
        texts = [k for k in kinds if not k.endswith("_pdf")]
        asked = F.col("kind").isin(texts) & ~((F.col("kind") == "md") & _is_variant("path"))
        files = artifacts.withColumn("content", F.when(asked, F.col("content")))
    per = files.groupBy("task_id").agg(F.lit(True).alias("_has"), *firsts)
    base = tasks.select("task_id", "status", "result_path").join(per, "task_id", "left")
    if "images" in wanted:
        base = base.join(image_inventory(tasks.select("task_id"), artifacts, include_image_base64, upload_images), "task_id", "left")
    if "md" in kinds and upload_images and not bare:
        docs = base.filter(F.col("md").isNotNull()).select(F.col("task_id").alias("doc_id"), F.col("md.content").cast("string").alias("md"))
        base = base.join(served_markdown(docs, artifacts, True).withColumnRenamed("doc_id", "task_id"), "task_id", "left")
    ok = (F.col("status") == "completed") & F.col("result_path").isNotNull() & F.coalesce("_has", F.lit(False))
    cols = []
    for k in kinds:
        there = ok & F.col(k).isNotNull()
        if k.endswith("_pdf"):
            cols.append(F.when(there, F.col(f"{k}.path")).alias(f"{k}_path"))
        elif not bare:
            text = F.col(f"{k}.content").cast("string")
            if k == "md":
                text = F.coalesce("md_out", text) if upload_images else text
            else:
                there = there & F.try_parse_json(text).isNotNull()
            cols.append(F.when(there, text).alias(f"{k}_content"))
        cols.append(F.when(there, F.col(f"{k}.file_name")).alias(f"{k}_file"))
        cols += [F.when(there, F.col(f"{k}.{m}")).alias(f"{k}_{m}") for m in meta]
    if "images" in wanted:
        cols.append(F.when(ok, F.col("image_count")).alias("images_count"))
        if not bare:
            cols.append(F.when(ok, F.col("images")).alias("images"))
    msg = C.status_message(F.col("status"), F.col("result_path"), F.col("_has"))
    return base.select("task_id", "status", msg.alias("message"), *cols)


def response_flags(docs: DataFrame, flags: DataFrame) -> DataFrame:
    """v1 response projection: layout / info / content_list / images are NULL unless flagged;
    ``layout`` carries the same value as ``content_list``."""
    j = docs.join(flags, "doc_id", "left")

    def on(c):
        return F.coalesce(F.col(c), F.lit(False))

    return j.select(
        "doc_id", "markdown",
        F.when(on("return_layout"), F.col("content_list_json")).alias("layout"),
        F.when(on("return_info"), F.col("info_json")).alias("info"),
        F.when(on("return_content_list"), F.col("content_list_json")).alias("content_list"),
        F.when(on("return_images"), F.col("images_json")).alias("images"),
    )


def images_map(artifacts: DataFrame) -> DataFrame:
    """``{basename: data-URI}`` per task for ``.jpg`` images, in that case only (the v1 response
    lists no others). Needs the ``content`` bytes. Of files with one name the smallest path counts."""
    jpg = artifacts.filter(F.col("path").contains("/images/") & C.basename("path").endswith(".jpg"))
    # one shuffle of the bytes; the list is one task's images, as in A5
    per = jpg.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct(C.basename("path").alias("k"), "path", "content"))).alias("_i"))
    first = F.filter("_i", lambda e, i: (i == 0) | (F.get("_i", i - 1)["k"] != e["k"]))
    entries = F.transform(first, lambda e: F.struct(e["k"], C.data_uri(e["content"]).alias("v")))
    return per.select("task_id", F.map_from_entries(entries).alias("images"))
