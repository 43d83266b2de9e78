"""Operator 1, token counts: edit-aware counting over segment trees of pre-tokens.

``build_trees`` cuts each document into pre-tokens of a byte-level vocabulary and keeps, per document,
the length and the token count of each (the leaves of a segment tree whose inner nodes hold sums).
``apply_edits`` replays edits: it finds the touched leaves by descending the tree, re-encodes only the
touched region plus boundary context until the new cuts meet an old one, and updates the sums on the
paths above. The rest of the document is neither split nor encoded again.

Boundary context. The pattern looks at most one character past the end of a match, and decides a run of
white space by the character after it. So a leaf stands if it ends two characters or more before an edit,
and scanning on from the last standing leaf may stop as soon as it cuts where an old leaf began.

Defined results: a null text is empty, with no leaves; strings of special tokens are ordinary text; edits are (start, length, text) in code points of
the text as it is by then, taken in order, with start and length clipped to the text and nulls read as 0
and empty; a null or empty list of edits changes nothing; repeated rows are counted each; extra columns
pass through ``build_trees``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .common import arrow_columns, fresh
from .tokens import MOST, Memo, PerWorker, plain_tokenizer, spelled

#: The pattern of byte-level vocabularies (a fixed value of the tokenizer's file format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

COUNTED = ("n_tokens_before", "n_tokens", "n_pretokens", "n_reencoded", "n_chars")


class Counter:
    """Cuts texts into pre-tokens and counts the tokens of each with the library's model."""

    def __init__(self, content: str):
        import regex

        self.pattern = regex.compile(PATTERN)
        model = plain_tokenizer(content).model
        self.tokens = Memo(lambda w: len(model.tokenize(spelled(w))))
        self.cuts = Memo(self._cut, MOST // 3)

    def _cut(self, part: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
        words = self.pattern.findall(part)
        return tuple(map(len, words)), tuple(map(self.tokens.__getitem__, words))

    def leaves(self, text: str) -> tuple[list[int], list[int]]:
        """Lengths and token counts of all pre-tokens. A cut always falls before a single space between
        two other characters, so the text is taken in pieces " word" that are remembered."""
        sizes: list[int] = []
        counts: list[int] = []
        if not text:
            return sizes, counts
        parts = text.split(" ")
        if "" in parts or any(x[0].isspace() or x[-1].isspace() for x in parts):  # runs of white space: no shortcut
            words = self.pattern.findall(text)
            return list(map(len, words)), list(map(self.tokens.__getitem__, words))
        get = self.cuts.__getitem__
        for a, b in map(get, [parts[0], *[" " + x for x in parts[1:]]]):
            sizes += a
            counts += b
        return sizes, counts


class Tree:
    """A segment tree over slots. A slot holds the leaves that now stand for one leaf of the original
    cut: one at first, none or several after edits. Nodes hold the sums of length and tokens."""

    def __init__(self, sizes: np.ndarray, counts: np.ndarray):
        self.n = max(1, len(sizes))
        self.width = 1 << (self.n - 1).bit_length()
        self.size, self.count = np.zeros(2 * self.width, np.int64), np.zeros(2 * self.width, np.int64)
        self.size[self.width:self.width + len(sizes)] = sizes
        self.count[self.width:self.width + len(counts)] = counts
        for a in (self.size, self.count):
            w = self.width
            while w > 1:
                a[w // 2:w] = a[w:2 * w:2] + a[w + 1:2 * w:2]
                w //= 2
        self.many: dict[int, list[tuple[int, int]]] = {}  # slots that don't hold one leaf

    @property
    def total(self) -> int:
        return int(self.count[1])

    def held(self, slot: int) -> list[tuple[int, int]]:
        if slot in self.many:
            return self.many[slot]
        size = int(self.size[self.width + slot])
        return [(size, int(self.count[self.width + slot]))] if size else []

    def hold(self, slot: int, leaves: list[tuple[int, int]]) -> None:
        self.many[slot] = leaves
        node = self.width + slot
        ds = sum(x for x, _ in leaves) - int(self.size[node])
        dc = sum(x for _, x in leaves) - int(self.count[node])
        while node:
            self.size[node] += ds
            self.count[node] += dc
            node //= 2

    def find(self, at: int) -> tuple[int, int]:
        """The slot that holds character ``at``, and the characters before that slot."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if before + self.size[node] <= at:
                before += int(self.size[node])
                node += 1
        return min(node - self.width, self.n - 1), before

    def leaves(self) -> tuple[list[int], list[int]]:
        flat = [leaf for slot in range(self.n) for leaf in self.held(slot)]
        return [x for x, _ in flat], [x for _, x in flat]


def edit(tree: Tree, text: str, start: int, length: int, new: str, counter: Counter) -> tuple[str, int]:
    """Apply one edit; the new text, and how many pre-tokens were encoded for it."""
    start = min(max(0, start), len(text))
    length = min(max(0, length), len(text) - start)
    if not length and not new:
        return text, 0
    after = text[:start] + new + text[start + length:]
    shift = len(new) - length
    # the first leaf that may not stand: it ends less than two characters before the edit
    slot, at = tree.find(max(0, start - 2))
    first, kept = slot, []
    for leaf in tree.held(slot):
        if at + leaf[0] + 2 <= start:
            kept.append(leaf)
            at += leaf[0]
        else:
            break
    # old cuts behind the edit, slot by slot, while the new scan goes on
    position, old, slot, rest = at, at, first, tree.held(first)[len(kept):]
    fresh_leaves: list[tuple[int, int]] = []
    encoded = 0
    for m in counter.pattern.finditer(after, position):
        while old + shift < position or old < start + length:  # pass old leaves that the scan has passed
            while not rest and slot < tree.n - 1:
                slot += 1
                rest = tree.held(slot)
            if not rest:
                break
            old += rest[0][0]
            rest = rest[1:]
        if old >= start + length and old + shift == position and position >= start + len(new):
            break
        fresh_leaves.append((m.end() - m.start(), counter.tokens[m.group()]))
        encoded += 1
        position = m.end()
    else:  # scanned to the end: no old leaf stands behind
        slot, rest = tree.n - 1, []
    if slot == first:
        tree.hold(first, kept + fresh_leaves + rest)
    else:
        tree.hold(first, kept + fresh_leaves)
        for s in range(first + 1, slot):
            if tree.held(s):
                tree.hold(s, [])
        tree.hold(slot, rest)
    return after, encoded


_PER_WORKER = PerWorker(Counter)


def counter(shared: Broadcast) -> Counter:
    return _PER_WORKER(shared)


def _dump(sizes: list[int], counts: list[int]) -> bytes:
    return np.array([sizes, counts], "<i4").tobytes()


def _load(tree: bytes) -> np.ndarray:
    return np.frombuffer(tree or b"", "<i4").reshape(2, -1)


def build_trees(docs: DataFrame, shared: Broadcast, text: str = "text", names: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with ``tree`` (binary: lengths, then token counts of the leaves) and ``n_tokens``."""

    def run(column: pa.Array) -> list:
        c = counter(shared)
        trees, total = [], []
        for scalar in column:  # one document at a time: lists of leaves are much larger than trees
            sizes, counts = c.leaves(scalar.as_py() or "")
            trees.append(_dump(sizes, counts))
            total.append(sum(counts))
        return [pa.array(trees, pa.binary()), pa.array(total, pa.int64())]

    names = names or (fresh(docs, "tree"), fresh(docs, "n_tokens"))
    return arrow_columns(docs, text, run, "tree binary, n_tokens bigint", list(names))


def apply_edits(trees: DataFrame, shared: Broadcast) -> DataFrame:
    """From ``doc_id``, ``text``, ``tree`` and ``edits`` (array of struct start, length, text): the
    edited text and tree, n_tokens before and after, the leaves of the old tree and the pre-tokens that
    were encoded again. Nothing but touched regions is split or encoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(shared)
        for b in batches:
            out = []
            for row in zip(*(b.column(i) for i in (1, 2, 3))):
                text, data, edits = (x.as_py() for x in row)
                text, tree, *numbers = _edited(c, text or "", edits, _load(data))
                out.append((text, _dump(*tree.leaves()), *numbers))
            cols = list(zip(*out)) or [()] * 7
            kinds = [pa.string(), pa.binary()] + [pa.int64()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, k) for x, k in zip(cols, kinds))],
                                             names=["doc_id", "text", "tree", *COUNTED])

    return (trees.selectExpr("cast(doc_id as bigint) doc_id", "text", "tree", "edits")
            .mapInArrow(run, "doc_id bigint, text string, tree binary, " + ", ".join(f"{n} bigint" for n in COUNTED)))


def count_after_edits(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """``build_trees`` and ``apply_edits`` in one pass for documents whose ``edits`` are at hand: the
    tree of a document lives only while its edits are applied, and one Python worker does both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(shared)
        for b in batches:
            out = []
            for row in zip(b.column(1), b.column(2)):
                text, edits = (x.as_py() for x in row)
                out.append(_edited(c, text or "", edits)[2:])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (zip(*out) if out else [()] * 5))],
                                             names=["doc_id", *COUNTED])

    return (docs.selectExpr("cast(doc_id as bigint) doc_id", "text", "edits")
            .mapInArrow(run, "doc_id bigint, " + ", ".join(f"{n} bigint" for n in COUNTED)))


def _edited(c: Counter, text: str, edits: list | None, leaves: np.ndarray | None = None) -> tuple:
    """The edited text, its tree, and the numbers COUNTED."""
    sizes, counts = c.leaves(text) if leaves is None else leaves
    tree, encoded = Tree(np.array(sizes, np.int64), np.array(counts, np.int64)), 0
    before = tree.total
    for e in edits or []:
        if e is not None:
            text, n = edit(tree, text, e["start"] or 0, e["length"] or 0, e["text"] or "", c)
            encoded += n
    return text, tree, before, tree.total, len(sizes), encoded, len(text)
