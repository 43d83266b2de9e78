"""Tokenizer files and bounded memos that operators on token ids share.

The tokenizer's file is read once on the driver and its content broadcast (a few MB, fixed by the
vocabulary), so executors need no copy of it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark import Broadcast
from pyspark.sql import SparkSession

#: Fixed values of the word tokenizer's file: the pattern WORDS and what passes its normal form unchanged.
#: Printable ASCII, Latin-1 letters and plain white space: here normal form and lower case go letter by
#: letter, and the word tokenizer's pattern reads as WORDS. Special tokens need a "<|".
PLAIN = re.compile("[ \\n\\t!-~À-ÖØ-öø-ÿ]*")
WORDS = re.compile("[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^ \\n\\ta-zß-öø-ÿ0-9]+")
LONG = 64  # longer words are not remembered
MOST = 250_000  # entries of a memo, about 50 MB of short strings


class TokenizerFile(NamedTuple):
    content: str
    digest: str  # of the whole content; names what workers build from it


def share(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer file, read and digested once, on the driver."""
    with open(path, encoding="utf-8") as f:
        content = f.read()
    return spark.sparkContext.broadcast(TokenizerFile(content, hashlib.sha256(content.encode()).hexdigest()))


class PerWorker:
    """What ``make`` builds from a tokenizer file, kept by a Python worker for the file it used last."""

    def __init__(self, make: Callable[[str], object]):
        self.make, self.digest, self.made = make, None, None

    def __call__(self, shared: Broadcast):
        file = shared.value
        if file.digest != self.digest:
            self.digest, self.made = None, None
            self.made, self.digest = self.make(file.content), file.digest
        return self.made


def byte_letters() -> dict[int, str]:
    """Byte -> the character that byte-level vocabularies write for it: printable Latin-1 stands for
    itself, the other bytes are numbered from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


LETTERS = byte_letters()


def spelled(word: str) -> str:
    """The word in the characters of a byte-level vocabulary."""
    return word if word.isascii() and word.isprintable() and " " not in word else (
        word.encode("utf-8", "replace").decode("latin-1").translate(LETTERS))


class Memo(dict):
    """word -> what ``make`` gives; forgets all when full, never keeps long words."""

    def __init__(self, make: Callable[[str], object], most: int = MOST, length: int = LONG):
        super().__init__()
        self.make, self.most, self.length = make, most, length

    def put(self, word: str, value: object) -> None:
        if len(word) <= self.length:
            if len(self) >= self.most:
                self.clear()
            self[word] = value

    def __missing__(self, word: str) -> object:
        got = self.make(word)
        self.put(word, got)
        return got


def plain_tokenizer(content: str):
    """The library's tokenizer with truncation and padding off."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(content)
    t.no_truncation()
    t.no_padding()
    return t


def pack(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def is_plain(text: str) -> bool:
    return PLAIN.fullmatch(text) is not None and "<|" not in text


def pieces(text: str) -> list[tuple[bool, str]]:
    """(plain?, piece): the whole text if it is plain, else what stands between spaces and line ends.
    White space is dropped by the word tokenizer and no token, normal form or special token crosses it,
    so the ids of a text are those of its pieces."""
    if is_plain(text):
        return [(True, text)]
    return [(is_plain(x), x) for x in text.replace("\n", " ").split(" ") if x]
