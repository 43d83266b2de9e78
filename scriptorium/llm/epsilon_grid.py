"""Operator 7, embedding near-duplicates: epsilon grid order join.

Cosine at least c means that unit vectors lie within eps = sqrt(2 - 2c). Vectors are projected on the
leading principal directions (an orthonormal basis, so projecting never lengthens a distance), and each
gets the grid cell of width eps that holds its projection. Sorted by label and cell, the vectors form a
sequence; neighbouring runs of it are blocks, with the range of their projections.

The join goes down the sequence recursively: intervals of blocks are paired by label and leading cell,
a pair whose ranges lie more than eps apart in any direction is skipped whole, and the others are split
into their halves, quarters, ... down to single blocks. Vectors travel in bundles of neighbouring blocks,
once for each pair of bundles with a surviving pair of blocks (not once for each pair of blocks); the task
compares just the surviving pairs and splits each further in the same way before it multiplies vectors.

Equal vectors of one label form a class and are compared once. A task emits, for each class, how many
vectors it found linked, and a spanning forest of the links; it never emits all pairs. Classes are named by
their smallest vec_id first, so the smallest name of a component tells its smallest vec_id.

Defined results: rows whose label is null (or NaN, in a floating column) or whose vector is null, empty, zero or holds a null or
non-finite component link with nothing; shorter vectors are read as if filled up with zeros; repeated
rows are vectors of their own; a null vec_id does not name a component; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .forest import Forest
from .graph import components

DIRECTIONS = 8
BLOCK = 512  # classes in a block
LEAF = 64  # classes that a task compares without splitting further
BUNDLE = 16  # blocks that travel together, at most
BUNDLE_BYTES = 8 << 20  # of vectors in a bundle (one block at least)
FAN = 8  # parts that an interval is split into
_SLACK = 1e-9  # of rounding, when ranges are compared
_PACKED = ("ids", "firsts", "nones", "copies", "vectors")


def _matrix(column: pa.ListArray) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.empty((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    big = np.abs(m).max(axis=1, keepdims=True)  # scaled first, so that no square over- or underflows
    m = m / big
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def principal_directions(vectors: DataFrame, dim: int, k: int = DIRECTIONS) -> np.ndarray:
    """The k leading principal directions (dim x k) of the unit vectors of all rows. Tasks send sums of
    products, which Spark adds up; dim * (dim + 1) / 2 numbers reach the driver, whatever the input."""
    upper = np.triu_indices(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mean, n = np.zeros((dim, dim)), np.zeros(dim), 0
        for b in batches:
            if b.num_rows:
                u = _unit(_matrix(b.column(0)))
                total += u.T @ u
                mean += u.sum(axis=0)
                n += len(u)
        if n:
            values = np.concatenate((total[upper], mean, [n]))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["i", "x"])

    rows = vectors.select("v").mapInArrow(run, "i bigint, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    got = np.zeros(len(upper[0]) + dim + 1)
    for r in rows:
        got[r.i] = r.x
    n = max(1.0, got[-1])
    cov = np.zeros((dim, dim))
    cov[upper] = got[:len(upper[0])] / n
    cov = cov + np.triu(cov, 1).T
    mean = got[len(upper[0]):-1] / n
    _, axes = np.linalg.eigh(cov - np.outer(mean, mean))
    return np.ascontiguousarray(axes[:, ::-1][:, :min(k, dim)])


def _projected(classes: DataFrame, axes: np.ndarray, eps: float) -> DataFrame:
    k = axes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = _unit(_matrix(b.column(b.schema.get_field_index("v")))) @ axes if b.num_rows else np.empty((0, k))
            cells = np.floor(p / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *(pa.array(np.ascontiguousarray(cells[:, i])) for i in range(k)),
                 pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), k).cast(pa.list_(pa.float64()))],
                names=[*b.schema.names, *(f"c{i}" for i in range(k)), "p"])

    ddl = ", ".join(f"{n} {t}" for n, t in classes.dtypes)
    return classes.mapInArrow(run, f"{ddl}, {', '.join(f'c{i} int' for i in range(k))}, p array<double>")


def _width(kind: str) -> str:
    """numpy's type for the elements of a vector column: floats stay as they are, others count as doubles."""
    return "<f4" if kind == "array<float>" else "<f8"


def blocks(classes: DataFrame, axes: np.ndarray, eps: float, block: int = BLOCK) -> DataFrame:
    """One row per block of the sequence: part, block (numbers), label, lo, hi (ranges of the
    projections), and its classes in order: ids, firsts (0 for null), nones, copies and vectors, each packed."""
    k, width = axes.shape[1], _width(classes.schema["v"].dataType.simpleString())
    order = ["label", *[f"c{i}" for i in range(k)], "first", "v"]
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # "first" comes last, so a crowded cell is spread over tasks too
    ordered = (_projected(classes, axes, eps).repartitionByRange(n, *order[:-1]).sortWithinPartitions(*order)
               .select("label", "id", "first", "copies", "v", "p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held = TaskContext.get().partitionId(), 0, None

        def out(rows: pa.Table) -> pa.RecordBatch:
            nonlocal made
            rows = rows.combine_chunks()
            p = _matrix(rows["p"].chunk(0))
            whole = [rows["id"].to_numpy(), rows["first"].fill_null(0).to_numpy().astype(np.int64), rows["first"].is_null().to_numpy().astype(np.uint8),
                     rows["copies"].to_numpy(), _matrix(rows["v"].chunk(0)).astype(width)]
            made += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([made - 1], pa.int32()), rows["label"].chunk(0)[:1],
                 pa.array([p.min(axis=0).tolist()], pa.list_(pa.float64())), pa.array([p.max(axis=0).tolist()], pa.list_(pa.float64())),
                 *(pa.array([x.tobytes()], pa.binary()) for x in whole)],
                names=["part", "block", "label", "lo", "hi", *_PACKED])

        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            while held.num_rows:  # a block ends when it is full or the label changes
                labels = held["label"].slice(0, block + 1).to_numpy()
                stop = int(np.searchsorted(labels != labels[0], True)) if len(labels) else 0
                stop = min(stop, block)
                if stop == held.num_rows:
                    break  # the next batch may go on with it
                yield out(held.slice(0, stop))
                held = held.slice(stop)
        if held is not None and held.num_rows:
            yield out(held)

    label = classes.schema["label"].dataType.simpleString()
    return ordered.mapInArrow(run, f"part int, block int, label {label}, lo array<double>, hi array<double>, "
                                   + ", ".join(f"{c} binary" for c in _PACKED))


def _apart(a: str, b: str, eps: float) -> str:
    """SQL: the ranges of the two intervals lie more than eps apart in some direction."""
    gap = eps + _SLACK
    return f"exists(zip_with(zip_with({a}.lo, {b}.hi, (x, y) -> x - y), zip_with({b}.lo, {a}.hi, (x, y) -> x - y), (x, y) -> greatest(x, y)), g -> g > {gap!r})"


def block_pairs(sequence: DataFrame, eps: float, fan: int = FAN) -> DataFrame:
    """Pairs of blocks (pa, ba, pb, bb), each once, that may hold near vectors. A node of level l covers
    fan^l neighbouring blocks of one part and label; pairs of nodes go down level by level."""
    meta = cut(sequence.select("part", "block", "label", "lo", "hi"))
    most = meta.agg(F.max("block")).first()[0]
    levels = 0 if most is None else max(0, math.ceil(math.log(most + 1, fan) - 1e-9))
    k = 0 if most is None else len(meta.select("lo").first().lo)
    ends = [f"array({', '.join(f'{f}({c}[{i}])' for i in range(k))}) {c}" for f, c in (("min", "lo"), ("max", "hi"))]

    def nodes(level: int) -> DataFrame:
        own = meta.withColumn("node", F.floor(F.col("block") / fan ** level).cast("int"))
        if not k:
            return own.drop("block")
        return own.groupBy("label", "part", "node").agg(*[F.expr(e) for e in ends])

    top = nodes(levels)
    cell = lambda c: F.floor(F.col(c)[0] / F.lit(eps)).cast("int")
    a = top.select("*", cell("lo").alias("c0"), F.explode(F.sequence(cell("lo"), cell("hi"))).alias("cell")).alias("a")
    b = top.select("*", (cell("lo") - 1).alias("c0"), F.explode(F.sequence(cell("lo") - 1, cell("hi") + 1)).alias("cell")).alias("b")
    pairs = (a.join(b, ["label", "cell"])
             .where("cell = greatest(a.c0, b.c0) and struct(a.part, a.node) <= struct(b.part, b.node)")
             .where(f"not {_apart('a', 'b', eps)}").selectExpr("label", "a.part pa", "a.node na", "b.part pb", "b.node nb"))
    for level in range(levels - 1, -1, -1):
        child = nodes(level).withColumn("up", F.floor(F.col("node") / fan).cast("int"))
        left = child.selectExpr("label", "part pa", "up na", "node x", "struct(lo, hi) a")
        right = child.selectExpr("label", "part pb", "up nb", "node y", "struct(lo, hi) b")
        pairs = (pairs.join(left, ["label", "pa", "na"]).join(right, ["label", "pb", "nb"])
                 .where("struct(pa, x) <= struct(pb, y)").where(f"not {_apart('a', 'b', eps)}")
                 .selectExpr("label", "pa", "x na", "pb", "y nb"))
    return pairs.selectExpr("pa", "na ba", "pb", "nb bb")


def near(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...] | None, cosine: float, eps: float):
    """Positions (i, j) of all pairs with cosine at least ``cosine`` between the rows of x and of y (or
    within x, i < j, if y is None), each given as vectors, unit vectors and projections. Runs of LEAF rows
    are skipped if their ranges lie apart."""
    x, ux, px = x
    within = y is None
    raw, uy, py = (x, ux, px) if within else y

    def ranges(p: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        return [(s, min(len(p), s + LEAF), p[s:s + LEAF].min(axis=0), p[s:s + LEAF].max(axis=0)) for s in range(0, len(p), LEAF)]

    right = ranges(py)
    for s, e, lo, hi in ranges(px):
        for s2, e2, lo2, hi2 in right:
            if within and s2 < s or (np.maximum(lo2 - hi, lo - hi2) > eps + _SLACK).any():
                continue
            found = ux[s:e] @ uy[s2:e2].T
            i, j = np.nonzero(found >= cosine - 1e-9)
            value = found[i, j]
            i, j = i + s, j + s2
            for t in np.flatnonzero(value < cosine + 1e-9):  # so close that the order of sums matters
                a, b = x[i[t]], raw[j[t]]
                value[t] = np.dot(a, b) / (math.sqrt(np.dot(a, a)) * math.sqrt(np.dot(b, b)))
            ok = (value >= cosine) & ((i < j) if within else True)
            if ok.any():
                yield i[ok], j[ok]


class _Bundle:
    """The classes of a bundle, its blocks one after the other."""

    def __init__(self, blocks: pa.StructArray, axes: np.ndarray, width: str):
        def column(name: str, kind: str) -> np.ndarray:
            return np.concatenate([np.frombuffer(b.as_buffer(), kind) for b in blocks.field(name)])

        self.ids, self.firsts, self.copies = (column(c, "<i8") for c in ("ids", "firsts", "copies"))
        self.nones = column("nones", "u1").astype(bool)
        self.vectors = column("vectors", width).astype(np.float64).reshape(len(self.ids), -1)
        self.units = _unit(self.vectors)
        self.projected = self.units @ axes
        ends = np.cumsum([0] + [len(b.as_buffer()) // 8 for b in blocks.field("ids")]).tolist()
        self.at = dict(zip(blocks.field("block").to_pylist(), zip(ends, ends[1:])))

    def block(self, number: int) -> tuple[int, tuple[np.ndarray, ...]]:
        start, stop = self.at[number]
        return start, tuple(m[start:stop] for m in (self.vectors, self.units, self.projected))


def _found(axes: np.ndarray, cosine: float, eps: float, width: str):
    names = ["none", "first", "id", "other_none", "other_first", "other_id", "linked"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                at = {n: batch.column(i)[r] for i, n in enumerate(batch.schema.names)}
                own = not at["b"].is_valid
                a = _Bundle(at["a"].values, axes, width)
                b = a if own else _Bundle(at["b"].values, axes, width)
                n = 0 if own else len(a.ids)  # where b's classes begin
                ids, firsts, nones, copies = (getattr(a, c) if own else np.concatenate((getattr(a, c), getattr(b, c)))
                                              for c in ("ids", "firsts", "nones", "copies"))
                degree, forest, edges = np.zeros(len(ids), np.int64), Forest(len(ids)), []
                for pair in at["pairs"].as_py():
                    left, x = a.block(pair["ba"])
                    right, y = b.block(pair["bb"])
                    for i, j in near(x, None if own and left == right else y, cosine, eps):
                        i, j = i + left, j + right + n
                        np.add.at(degree, i, copies[j])
                        np.add.at(degree, j, copies[i])
                        edges += forest.add(i, j)
                hit = np.flatnonzero(degree)
                here = np.concatenate((hit, [e[0] for e in edges])).astype(np.int64)
                there = np.array([e[1] for e in edges], np.int64)
                if len(here):
                    def column(x: np.ndarray, null: np.ndarray | None, alone: bool) -> pa.Array:
                        chosen = pa.array(x[there], mask=None if null is None else null[there])
                        return pa.concat_arrays([pa.nulls(len(hit), chosen.type), chosen]) if alone else \
                            pa.array(x[here], mask=None if null is None else null[here])

                    yield pa.RecordBatch.from_arrays(
                        [*(column(x, null, alone) for alone in (False, True) for x, null in ((nones, None), (firsts, nones), (ids, None))),
                         pa.array(np.concatenate((degree[hit], np.zeros(len(edges), np.int64))))], names=names)

    return run


def embedding_near_duplicates(vectors: DataFrame, cosine: float = 0.98, block: int = BLOCK) -> DataFrame:
    """From vec_id, embedding and label: vec_id, n_links, component_id and kept for every row."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "label", F.col("embedding").alias("v"))
    labelled = F.col("label").isNotNull()
    if rows.schema["label"].dataType.typeName() in ("float", "double"):
        labelled &= ~F.isnan("label")
    fine = F.coalesce(labelled & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                      & F.exists("v", lambda x: x != 0), F.lit(False))
    size = rows.where(fine).agg(F.max(F.size("v")).alias("most"), F.min(F.size("v")).alias("least")).first()
    alone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if size.most is None:
        return alone.withColumn("kept", F.lit(True))
    if size.most > size.least:
        zeros = F.array_repeat(F.lit(0).cast(rows.schema["v"].dataType.elementType), F.lit(size.most) - F.size("v"))
        rows = rows.withColumn("v", F.when(fine, F.concat("v", zeros)).otherwise(F.col("v")))
    eps = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-7
    valid = rows.where(fine)
    classes = valid.groupBy("label", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    classes = cut(classes.select("label", "first", "copies", "v", F.monotonically_increasing_id().alias("id")))
    axes, width = principal_directions(classes, size.most), _width(classes.schema["v"].dataType.simpleString())
    sequence = cut(blocks(classes, axes, eps, block))
    many = max(1, min(BUNDLE, BUNDLE_BYTES // (block * size.most * np.dtype(width).itemsize)))
    bundle = lambda c: F.floor(F.col(c) / many).cast("int")
    # at most ``many`` blocks and many * many pairs of them are gathered
    bundles = sequence.groupBy("part", bundle("block").alias("bundle")).agg(F.collect_list(F.struct("block", *_PACKED)).alias("held"))
    pairs = cut(block_pairs(sequence, eps).groupBy("pa", bundle("ba").alias("ga"), "pb", bundle("bb").alias("gb"))
                .agg(F.collect_list(F.struct("ba", "bb")).alias("pairs")))
    work = (pairs.join(bundles.selectExpr("part pa", "bundle ga", "held a"), ["pa", "ga"])
            .join(bundles.selectExpr("part pb", "bundle gb", "held b"), ["pb", "gb"])
            .selectExpr("pairs", "a", "if(pa = pb and ga = gb, null, b) b"))
    found = cut(work.mapInArrow(_found(axes, cosine, eps, width), "none boolean, first bigint, id bigint, other_none boolean, "
                                                                  "other_first bigint, other_id bigint, linked bigint"))
    degree = found.where("other_id is null").groupBy("id").agg(F.sum("linked").alias("linked"))
    edges = found.where("other_id is not null").selectExpr("struct(none, first, id) a", "struct(other_none none, other_first first, other_id id) b")
    roots = components(edges, "a", "b").selectExpr("node.id id", "root.first least")
    per_class = (classes.join(degree, "id", "left").join(roots, "id", "left")
                 .selectExpr("label", "v", "copies - 1 + coalesce(linked, 0) n_links", "coalesce(least, first) component_id"))
    linked = valid.join(per_class, ["label", "v"]).select("vec_id", "n_links", "component_id")
    rest = rows.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
