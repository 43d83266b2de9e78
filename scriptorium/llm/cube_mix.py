"""Operator 13, mixing sources to target weights: balanced sampling by the cube method.

Sources share ``SHARE`` of all words by weight; a target stops at ``CAP`` times its source's size and the
excess is shared again by weight until none is above. With r = target / size of the source, each document is
taken floor(r) times, and once more with probability r - floor(r): these fractions are what the cube method
rounds to 0 or 1.

Flight. The fractions of a group of documents move along a vector u of the null space of the constraints
(sum of u = 0, sum of u * size = 0), so that expected documents and words stay as they are. u is the largest
document's unit vector projected on that space; the step goes to the first wall in one of both directions, by
a draw that keeps every fraction's expectation. Each step settles a document, largest first. A group stops at
two unsettled documents at most (one per constraint).

Where the work happens. A source's large documents (at least 1 / ``LARGE`` of it, so ``LARGE`` at most) are
settled first, in one group; the words that their landing adds or lacks are spread over the fractions of
the others. Those are dealt at random into groups of ``GROUP`` documents, what stays unsettled (two of each
group) into groups again, until one group per source is left: the landing problem. There the document
constraint is dropped, then the last document is drawn. Nothing is gathered by source or on the driver; a
source with a third of all rows has as many groups as it needs. All draws come from hashes of the rows, so
reruns agree, whatever the partitioning.

Defined results: a null or blank text has size 0 and takes 0 words; null is a source of its own, last in order; repeated
rows are documents of their own; if all sizes are 0, targets are 0; an empty table gives an empty result; extra
columns are not read (``mixture`` returns them).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scale import running_count
from .common import cut, fresh

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2.0
WORD = r"[^\x20\x09-\x0D]+"
GROUP = 512  # documents that move together
LARGE = 1024
_NEAR = 1e-9  # of a wall
_UNIT = "doc_id {key}, source {source}, digest bigint, size bigint, source_size bigint, target double, copies int, fraction double, x double"


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``sizes`` (source, source_size; one row each) with ``target``. Weights follow the order of the sources'
    code points (null last) and repeat. Every round is one aggregate over the sources: those above their cap
    at the present words per weight stop there, the others share what is left."""
    marked = sizes.select("*", F.lit(0).alias("__all"), F.col("source").isNull().alias("__none"))
    placed = running_count(marked, ["__all"], ["__none", "source"], "__place").drop("__all", "__none")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("__place") - 1) % len(weights) + 1).cast("int"))
    table = cut(placed.withColumn("__weight", weight).withColumn("__cap", F.col("source_size") * F.lit(float(cap))).drop("__place"))
    total = table.agg(F.sum("source_size")).first()[0]
    total, level = float(total or 0) * share, 0.0
    while True:
        full = F.col("__cap") < F.lit(level) * F.col("__weight")
        held, left = table.agg(F.sum(F.when(full, F.col("__cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("__weight")))).first()
        if not left or (total - held) / left <= level:
            break
        level = (total - held) / left
    return table.withColumn("target", F.least(F.col("__cap"), F.lit(level) * F.col("__weight"))).drop("__weight", "__cap")


def _walls(x: np.ndarray, u: np.ndarray) -> float:
    """How far x can go along u inside the cube."""
    up, down = u > 1e-15, u < -1e-15
    return min(((1 - x[up]) / u[up]).min(initial=np.inf), (x[down] / -u[down]).min(initial=np.inf))


def _direction(s: np.ndarray, landing: bool) -> np.ndarray | None:
    """A vector that keeps documents and words (at the landing, words alone where it must be); None if there is none."""
    m = len(s)
    away = s - s.mean()
    spread = float(away @ away)
    if spread <= 1e-12 * max(1.0, float(s @ s)):  # all of one size: words follow from documents
        if m < 2:
            return None
        u = np.full(m, -1.0 / m)
        u[0] += 1
        return u
    free = 1 - 1 / m - away[0] ** 2 / spread  # of the largest document's unit vector, what both constraints leave
    if landing and (m < 3 or free < 0.5):
        rest = float(s[1:].sum())
        if rest <= 0:
            return None
        u = np.full(m, -s[0] / rest)
        u[0] = 1
        return u
    if m < 3:
        return None
    k = 0 if free > 0.05 else int(np.argmin(np.abs(away)))
    u = -1 / m - away * (away[k] / spread)
    u[k] += 1
    return u


def flight(size: np.ndarray, x: np.ndarray, draws: np.random.Generator, landing: bool = False,
           room: tuple[float, float] | None = None) -> np.ndarray:
    """New fractions, all but two at most at 0 or 1, with documents and words as before; with ``landing`` all
    are. ``room``: words that others can give and take; the last document is then drawn, or if only
    one way fits (or fits better) taken that way. ``size`` falls."""
    x, at = x.copy(), np.flatnonzero((x > _NEAR) & (x < 1 - _NEAR))
    while len(at):
        s, here = size[at].astype(float), x[at]
        u = _direction(s, landing)
        if u is None:
            if not landing:
                break
            k = at[0]  # no constraint can be held: draw
            one = draws.random() < x[k]
            if room is not None and len(at) == 1:
                more, less = max(0.0, (1 - x[k]) * size[k] - room[0]), max(0.0, x[k] * size[k] - room[1])
                one = one if more == less else more < less
            x[k] = float(one)
        else:
            ahead, back = _walls(here, u), _walls(here, -u)
            x[at] = here + (ahead * u if draws.random() * (ahead + back) < back else -back * u)
        x[at[x[at] <= _NEAR]] = 0.0
        x[at[x[at] >= 1 - _NEAR]] = 1.0
        at = at[(x[at] > 0) & (x[at] < 1)]
    return x


def _mover(salt: int, landing: bool | None = None, first: bool = False):
    """A function of one group of units: the same with new ``x``. ``landing`` None: as column ``last`` says."""

    def move(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("size", "descending"), ("digest", "ascending"), ("x", "ascending")])
        size, x = rows["size"].to_numpy(), rows["x"].to_numpy()
        seed = int(np.bitwise_xor.reduce(rows["digest"].to_numpy().view(np.uint64)))
        room = None
        if first:
            rest, fraction = float(rows["source_size"][0].as_py() - size.sum()), rows["fraction"][0].as_py()
            room = (fraction * rest, (1 - fraction) * rest)
        last = rows["last"][0].as_py() if landing is None else landing
        x = flight(size, x, np.random.default_rng([seed, len(x), salt]), last, room)
        rows = rows.select([n for n in rows.column_names if n not in ("last", "part")])
        return rows.set_column(rows.column_names.index("x"), "x", pa.array(x))

    return move


def _open() -> Column:
    return (F.col("x") > 0) & (F.col("x") < 1)


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP,
                group: int = GROUP, large: int = LARGE) -> DataFrame:
    """doc_id, source, digest (hash of id and text), size (words), source_size, target (words of its source),
    copies (how often the mix takes the document) and taken (words), one row per row of ``docs``."""
    rows = cut(docs.select("doc_id", "source", F.xxhash64("doc_id", "text").alias("digest"), word_count("text").alias("size")))
    goals = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap))
    ddl = _UNIT.format(key=rows.schema["doc_id"].dataType.simpleString(), source=rows.schema["source"].dataType.simpleString())
    names = [x.split()[0] for x in ddl.split(", ")]

    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    fraction = F.when(F.col("r") - F.floor("r") > _NEAR, F.col("r") - F.floor("r")).otherwise(0.0)
    joined = rows.join(goals.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).withColumn("r", ratio)
    units = cut(joined.withColumn("copies", F.floor("r").cast("int")).withColumn("fraction", fraction).withColumn("x", F.col("fraction")).select(names))

    big = (F.col("size") > 0) & (F.col("size") * large >= F.col("source_size")) & _open()
    first = cut(units.where(big).groupBy("source").applyInArrow(_mover(1, True, True), ddl))
    off = (first.groupBy(F.col("source").alias("__s"), F.lit(True).alias("__any"))
           .agg(F.sum(F.when(F.col("x") > 0.5, F.col("size")).otherwise(0)).alias("__more"), F.sum("size").alias("__held"), F.first("fraction").alias("__f")).drop("__any"))
    rest = F.col("source_size") - F.coalesce("__held", F.lit(0))
    over = F.coalesce(F.col("__more") - F.col("__f") * F.col("__held"), F.lit(0.0))  # words too many, from whole numbers
    shifted = F.when(_open() & (rest > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("x") - over / rest))).otherwise(F.col("x"))
    others = cut(units.where(~big).join(off, F.col("source").eqNullSafe(F.col("__s")), "left").withColumn("x", shifted).select(names))

    settled, pending, turn = [first, others.where(~_open())], others.where(_open()), 2
    while pending.limit(1).count():
        dealt = pending.withColumn("__r", F.xxhash64("digest", F.lit(turn))).withColumn("__tie", F.monotonically_increasing_id())
        counted = running_count(dealt, ["source"], ["__r", "digest", "x", "__tie"], "__at")
        most = counted.groupBy(F.col("source").alias("__s")).agg(F.max("__at").alias("__n"))
        grouped = (counted.join(most, F.col("source").eqNullSafe(F.col("__s")))
                   .withColumn("part", F.floor((F.col("__at") - 1) / group)).withColumn("last", F.col("__n") <= group))
        moved = cut(grouped.select(*names, "part", "last").groupBy("source", "part").applyInArrow(_mover(turn), ddl))
        settled.append(moved.where(~_open()))
        pending, turn = moved.where(_open()), turn + 1

    out = settled[0]
    for part in settled[1:]:
        out = out.union(part)
    out = out.withColumn("copies", F.col("copies") + F.round("x").cast("int"))
    return out.select("doc_id", "source", "digest", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixture(docs: DataFrame, mix: DataFrame) -> DataFrame:
    """The rows of the mix with the columns of ``docs``, each as often as ``mix`` (from ``mix_sources``) takes
    it. Rows of one id and text stand for each other."""
    name = fresh(docs, "__digest")
    wanted = mix.groupBy(F.col("doc_id").alias("__id"), F.col("digest").alias("__d")).agg(F.sum("copies").cast("int").alias("__n")).where("__n > 0")
    one = docs.withColumn(name, F.xxhash64("doc_id", "text")).dropDuplicates(["doc_id", name])
    found = one.join(wanted, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col(name) == F.col("__d")))
    return found.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*[F.col(f"`{c}`") for c in docs.columns])
