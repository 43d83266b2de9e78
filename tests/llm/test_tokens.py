"""Operators 1, 3 and 8 against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from scriptorium.llm import queries as Q
from scriptorium.llm import records, token_tree, tokens
from scriptorium.llm.bpe_automaton import Automaton, Codec, bpe_decode, bpe_digest, bpe_encode
from scriptorium.session import scratch_path

from ..conftest import SF_SMALL
from .conftest import ODD

WORD = open(P.path(Q.WORD_FILE), encoding="utf-8").read()
BYTE = open(P.path(Q.BYTE_FILE), encoding="utf-8").read()


def ids_of(content, text):
    t = tokens.plain_tokenizer(content)
    t.encode_special_tokens = content is BYTE  # operator 1 reads their strings as ordinary text
    return t.encode(text or "", add_special_tokens=False).ids


# ------------------------------------------------------------------ 8

def test_automaton_equals_merging_by_rank():
    def bpe(word, rank):
        parts = list(word)
        while True:
            pairs = [(rank[a, b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (a, b) in rank]
            if not pairs:
                return parts
            _, i = min(pairs)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    rnd = random.Random(5)
    for _ in range(60):
        vocab, merges = {c: i for i, c in enumerate("abc")}, []
        for _ in range(rnd.randint(0, 14)):  # merges of live tokens, as training makes them
            a, b = rnd.choice(list(vocab)), rnd.choice(list(vocab))
            if a + b not in vocab and bpe(a + b, {m: i for i, m in enumerate(merges)}) == [a, b]:
                vocab[a + b] = len(vocab)
                merges.append((a, b))
        auto, rank = Automaton(vocab, merges), {m: i for i, m in enumerate(merges)}
        for _ in range(60):
            w = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 14)))
            assert [auto.labels[i] for i in auto.encode(w)] == bpe(w, rank), (merges, w)


def test_codec_equals_library():
    rnd, codec, t = random.Random(1), Codec(WORD), tokens.plain_tokenizer(WORD)
    texts = [x or "" for x in ODD] + ["".join(rnd.choice("ab'.s <|>\n12 éßİ") for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    for x in texts:
        ids = t.encode(x, add_special_tokens=False).ids
        assert codec.encode(x) == tokens.pack(ids), x
        got, text = codec.round_trip(x)
        assert got == tokens.pack(ids) and text.decode() == t.decode(ids, skip_special_tokens=False) == codec.decode(got)


def test_bpe_query_and_interface(spark, odd, none):
    shared = tokens.share(spark, P.path(Q.WORD_FILE))
    t = tokens.plain_tokenizer(WORD)
    got = sorted(bpe_digest(odd, shared).collect(), key=str)
    want = []
    for r in odd.collect():
        ids = ids_of(WORD, r.text)
        want.append((r.doc_id, len(ids), hashlib.sha256(tokens.pack(ids)).hexdigest(),
                     hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    coded = bpe_encode(odd.drop("ids"), shared)
    assert [r.ids for r in coded.orderBy("text").collect()] == [ids_of(WORD, r.text) for r in odd.orderBy("text").collect()]
    assert bpe_decode(coded, shared).where("text = 'one'").first().decoded == "one</w>"
    assert bpe_digest(none, shared).collect() == []
    assert Q.QUERIES["op8_bpe_automaton"](spark, SF_SMALL).count() == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()


# ------------------------------------------------------------------ 3

def test_records_round_trip(spark, odd, small, none):
    shared = tokens.share(spark, P.path(Q.WORD_FILE))
    for df in (odd, small, none):
        got = sorted(records.record_digest(df, shared).collect(), key=lambda r: r.start)
        rows = sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0]))
        assert [r.doc_id for r in got] == [r[0] for r in rows]
        start, by_id = 0, {}
        for doc_id, text in rows:
            ids = tokens.pack([*ids_of(WORD, text), 2])
            by_id.setdefault(doc_id, []).append((len(ids) // 4, zlib.crc32(ids)))
        for r in got:
            assert r.start == start
            start += r.n_tokens
            by_id[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        assert not any(by_id.values())


def test_records_shuffled_reads_and_damage(spark, small):
    path = scratch_path(spark, "records-test")
    index = records.write_records(small, tokens.share(spark, P.path(Q.WORD_FILE)), path)
    some = index.where("doc_id % 7 = 3").repartition(3)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in records.read_records(spark, path, some).collect()}
    want = {r.doc_id: [*ids_of(WORD, r.text), 2] for r in small.where("doc_id % 7 = 3").collect()}
    assert got == want
    data = records.frame(records.payload(7, tokens.pack([1, 2])))
    assert records.parts(records.unframe(data)) == (7, tokens.pack([1, 2]))
    for i in range(len(data)):
        bad = bytearray(data)
        bad[i] ^= 4
        with pytest.raises(ValueError):
            records.unframe(bytes(bad))
    with pytest.raises(ValueError):
        records.unframe(data[:-1])


# ------------------------------------------------------------------ 1

def test_tree_edits_equal_counting_anew():
    rnd, c, t = random.Random(3), token_tree.Counter(BYTE), tokens.plain_tokenizer(BYTE)
    letters = "ab '  \n\tst12,.é½ll re漢"
    for _ in range(600):
        x = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60)))
        sizes, counts = c.leaves(x)
        assert sum(counts) == len(t.encode(x, add_special_tokens=False).ids)
        tree = token_tree.Tree(np.array(sizes, int), np.array(counts, int))
        for _ in range(5):
            start, length = rnd.randint(-2, len(x) + 3), rnd.choice([0, 0, 1, 3, 10, 70])
            new = "".join(rnd.choice(letters) for _ in range(rnd.choice([0, 0, 1, 2, 6])))
            at = min(max(0, start), len(x))
            want = x[:at] + new + x[min(len(x), at + length):]
            x, _ = token_tree.edit(tree, x, start, length, new, c)
            assert x == want and tree.leaves() == c.leaves(x) and tree.total == sum(c.leaves(x)[1])


def test_only_touched_regions_are_encoded():
    c, text = token_tree.Counter(BYTE), "some words in a row " * 5000
    tree = token_tree.Tree(*(np.array(x) for x in c.leaves(text)))
    text, n = token_tree.edit(tree, text, 50_000, 3, "and more", c)
    assert n < 12 and tree.total == sum(c.leaves(text)[1])


def test_token_counts_query(spark, odd, none):
    shared = tokens.share(spark, P.path(Q.BYTE_FILE))
    edited = Q.document_edits(odd)
    got = token_tree.apply_edits(token_tree.build_trees(edited, shared), shared).collect()
    want = []
    for r in edited.collect():
        text = r.text or ""
        for e in r.edits:
            text = text[:e.start] + e.text + text[e.start + e.length:]
        want.append((r.doc_id, text, len(ids_of(BYTE, r.text)), len(ids_of(BYTE, text))))
    assert sorted([(r.doc_id, r.text, r.n_tokens_before, r.n_tokens) for r in got], key=str) == sorted(want, key=str)
    both = token_tree.count_after_edits(edited, shared)
    assert sorted(map(tuple, both.collect()), key=str) == sorted(((r.doc_id, *(r[n] for n in token_tree.COUNTED)) for r in got), key=str)
    assert token_tree.count_after_edits(Q.document_edits(none), shared).collect() == []
    assert token_tree.apply_edits(token_tree.build_trees(Q.document_edits(none), shared), shared).collect() == []


def test_words_begin_with_the_commonest_kind():
    """op3's CPU: every word was tried as seven contractions first. The words are the same, and ids that don't fit still raise."""
    import itertools
    import re
    import struct

    from scriptorium.llm import records, tokens

    assert tokens.WORDS.pattern.startswith("[a-z")
    plain = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \\n\\ta-zß-öø-ÿ0-9]+")
    parts = ["'", "s", "t", "re", "ve", "m", "ll", "d", "x", "é", "÷", "7", " ", "\n", "\t", "!", "('", "''"]
    for text in ("".join(a) for n in (1, 2, 3) for a in itertools.product(parts, repeat=n)):
        assert tokens.WORDS.findall(text) == plain.findall(text)
    narrow = records.Encoder.__new__(records.Encoder)
    narrow.width = 2
    assert narrow.pack([1, 65535]) == b"\x01\x00\xff\xff" and narrow.pack([]) == b""
    try:
        narrow.pack([65536])
    except struct.error:
        return
    raise AssertionError("an id beyond 16 bits was stored")
