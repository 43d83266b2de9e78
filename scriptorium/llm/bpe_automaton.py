"""Operator 8, BPE encoding and decoding with a tokenization automaton.

The merges are compiled, in order of priority, into a deterministic automaton over tokens that accepts
exactly the token sequences BPE yields. The gadget of a merge (u, v) -> uv
  * redirects every u-arc to a copy of the state behind it that has no v-arc, and
  * gives each state that has a u-arc an arc uv to the state behind v.
All arcs of one label lead to one state, so a state is named by the label that leads to it. A copy is
not written out: it is a pointer to the state copied and the list of what was cut since, so the tables
hold one entry per merge. ``Automaton.follows`` reads an arc from them, and arcs in use are kept in a
table. A word is encoded left to right: for each prefix, exactly one label ends there whose arc leaves
the state of the prefix before it. Decoding emits the labels of the arcs.

Defined results: null and empty texts have no ids and decode to the empty text; repeated rows give
equal rows; texts of any length are read whole (time grows with the length, words are bounded by the
longest label); special tokens in a text are recognised as the library does.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .common import arrow_columns, as_text
from .tokens import WORDS, Memo, PerWorker, is_plain, pack, pieces, spelled

_LAST = 1 << 40  # after all merges
_ARCS = 1 << 20  # arcs kept in the table
_END = "\n"  # no vocabulary spells a line end by itself


class Automaton:
    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        size = max(vocab.values(), default=-1) + 1
        self.born, self.left, self.right = [-1] * size, [0] * size, [0] * size
        self.cut: dict[tuple[int, int], int] = {}
        for k, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self._gadget(k, vocab[a], vocab[b], vocab[a + b])
        self.labels: dict[int, str] = {i: s for s, i in vocab.items()}
        inner = {s: i for s, i in vocab.items() if not (suffix and s.endswith(suffix))}
        outer = {s[:len(s) - len(suffix)]: i for s, i in vocab.items() if s.endswith(suffix)} if suffix else inner
        self.inner, self.outer = {k: v for k, v in inner.items() if k}, {k: v for k, v in outer.items() if k}
        heads = {s[:i] for s in (*self.inner, *self.outer) for i in range(1, len(s) + 1)}
        self.next = _Matches(heads, self.inner, self.outer)
        self.arcs = _Arcs(self)

    def _gadget(self, k: int, u: int, v: int, uv: int) -> None:
        if self.born[uv] >= 0:
            raise ValueError(f"two merges make token {uv}")
        if self.follows(u, v, k):  # else the merge can never happen
            self.cut[u, v] = k
            self.born[uv], self.left[uv], self.right[uv] = k, u, v

    def follows(self, state: int, label: int, time: int = _LAST) -> bool:
        """Does the state behind ``state`` have an arc ``label`` after the gadgets before ``time``?"""
        born = self.born
        while True:
            if self.cut.get((state, label), _LAST) < time:
                return False
            s, a = born[state], born[label]
            if s < 0 and a < 0:
                return True
            if s > a:  # the state is a copy of the one behind its right part, as it was then
                state, time = self.right[state], s
            elif a > s:  # the arc was added where its left part had one, after that gadget's cut
                label, time = self.left[label], a + 1
            else:
                state, label, time = self.right[state], self.left[label], s

    def encode(self, word: str) -> list[int]:
        """The ids of one pre-split word, spelled in the vocabulary's characters."""
        n, at, step, arcs = len(word), "", self.next, self.arcs
        last, back = [0] * (n + 1), [0] * (n + 1)
        for i, letter in enumerate(word, 1):
            at, some, label, size = step[at + letter if i < n else at + letter + _END]
            for a, b in some:
                j = i - b
                if not j or arcs[last[j] << 20 | a]:
                    last[i], back[i] = a, j
                    break
            else:  # exactly one label fits, so the only one left does
                last[i], back[i] = label, i - size
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        return out[::-1]


class _Arcs(dict):
    def __init__(self, of: Automaton):
        super().__init__()
        self.of = of

    def __missing__(self, key: int) -> bool:
        if len(self) >= _ARCS:
            self.clear()
        got = self[key] = self.of.follows(key >> 20, key & 0xFFFFF)
        return got


class _Matches(dict):
    """What has been read plus a letter (and _END after a word's last) -> the longest end of it that
    begins a label, and the labels that end here, longest first, the last of them apart."""

    def __init__(self, heads: set[str], inner: dict[str, int], outer: dict[str, int]):
        super().__init__()
        self.heads, self.inner, self.outer = heads, inner, outer

    def __missing__(self, read: str) -> tuple:
        if len(self) >= _ARCS:
            self.clear()
        at = read.removesuffix(_END)
        while at and at not in self.heads:
            at = at[1:]
        labels = self.outer if read.endswith(_END) else self.inner
        ends = [(labels[at[i:]], len(at) - i) for i in range(len(at)) if at[i:] in labels]
        if not ends:
            raise ValueError(f"no token of the vocabulary ends {read!r}")
        got = self[read] = (at, tuple(ends[:-1]), *ends[-1])
        return got


class Codec:
    """Texts to ids and back with the automaton of a tokenizer file; the library splits odd texts."""

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        spec = json.loads(content)
        model = spec["model"]
        self.automaton = Automaton(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.library = Tokenizer.from_str(content)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.labels = {i: s.encode() for i, s in (self.automaton.labels | {i: s for s, i in self.special.items()}).items()}
        self.packed = {i: pack([i]) for i in self.labels}
        self.ids = Memo(self._word)
        self.spelling = Memo(lambda w: self.emit(np.frombuffer(self.ids[w], "<u4").tolist()))

    def _word(self, word: str) -> bytes:
        ids = self.automaton.encode(spelled(word))
        self.spelling.put(word, self.emit(ids))
        return self.pack(ids)

    def pack(self, ids: list[int]) -> bytes:
        return b"".join([self.packed[i] for i in ids])

    def _odd(self, piece: str) -> bytes:
        out = []
        for part in self.split_special.split(piece):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
                for w, _ in split:  # already spelled byte by byte
                    out += self.automaton.encode(w)
        return self.pack(out)

    def emit(self, ids: list[int]) -> bytes:
        """The arc labels of the ids, as the library joins them for a tokenizer without a decoder."""
        return b" ".join([self.labels[i] for i in ids])

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        return b"".join([b"".join(map(self.ids.__getitem__, WORDS.findall(piece.lower()))) if plain else self._odd(piece)
                         for plain, piece in pieces(text)])

    def decode(self, ids: bytes) -> str:
        return self.emit(np.frombuffer(ids, "<u4").tolist()).decode()

    def round_trip(self, text: str) -> tuple[bytes, bytes]:
        """Ids and decoded text at once; what the ids of a word decode to is remembered by word."""
        if not is_plain(text):
            ids = self.encode(text)
            return ids, self.decode(ids).encode()
        words = WORDS.findall(text.lower())
        return b"".join(map(self.ids.__getitem__, words)), b" ".join(map(self.spelling.__getitem__, words))


_PER_WORKER = PerWorker(Codec)


def codec(shared: Broadcast) -> Codec:
    return _PER_WORKER(shared)


def bpe_encode(docs: DataFrame, shared: Broadcast, text: str = "text", keep: list[str] | None = None,
               name: str = "ids") -> DataFrame:
    """Append the ids of each whole text (array of long)."""

    def run(column: pa.Array) -> list:
        c = codec(shared)
        rows = [np.frombuffer(c.encode(t), "<u4").astype(np.int64) for t in as_text(column)]
        return [pa.array(rows, pa.list_(pa.int64()))]

    return arrow_columns(docs, text, run, "ids array<bigint>", [name], keep)


def bpe_decode(df: DataFrame, shared: Broadcast, ids: str = "ids", keep: list[str] | None = None,
               name: str = "decoded") -> DataFrame:
    """Append the text that the arc labels of the ids spell; null ids decode to the empty text."""

    def run(column: pa.Array) -> list:
        c = codec(shared)
        return [pa.array([c.emit(x or []).decode() for x in column.to_pylist()], pa.string())]

    return arrow_columns(df, ids, run, "decoded string", [name], keep)


def bpe_digest(docs: DataFrame, shared: Broadcast, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row: encoding, then decoding of the ids."""

    def run(column: pa.Array) -> list:
        c = codec(shared)
        rows = [c.round_trip(t) for t in as_text(column)]
        return [pa.array([len(i) // 4 for i, _ in rows], pa.int64()),
                pa.array([hashlib.sha256(i).hexdigest() for i, _ in rows], pa.string()),
                pa.array([hashlib.sha256(d).hexdigest() for _, d in rows], pa.string())]

    return arrow_columns(docs, text, run, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", keep=["doc_id"])
