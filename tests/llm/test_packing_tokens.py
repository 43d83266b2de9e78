"""Operators 5 and 3 agree on lengths: bins hold tokens."""

from collections import Counter

import public_tokenizers as P

import corpus_pipeline
from scriptorium.llm import packing, tokens
from scriptorium.llm import queries as Q

from ..conftest import SF_SMALL
from .conftest import docs_of
from .test_filters import check_packing
from .test_tokens import WORD, ids_of


def test_packed_lengths_are_tokens(spark, odd, small):
    shared = tokens.share(spark, P.path(Q.WORD_FILE))
    want = sorted(((r.doc_id, len(ids_of(WORD, r.text)) + 1) for r in odd.collect()), key=str)
    lengths = packing.with_length(odd, shared=shared)
    assert sorted(map(tuple, lengths.collect()), key=str) == want
    check_packing(packing.best_fit_pack(lengths).collect(), want, packing.CAPACITIES)
    got = Counter()
    for r in Q.QUERIES["op5_best_fit_packing"](spark, SF_SMALL).collect():
        got[r.doc_id] += r.length
    assert got == {r.doc_id: len(ids_of(WORD, r.text)) + 1 for r in small.collect()}


def test_texts_without_spaces_are_cut(spark):
    shared = tokens.share(spark, P.path(Q.WORD_FILE))
    docs = docs_of(spark, ["漢字" * 6000, "q1z" * 6000])
    rows = packing.best_fit_pack(packing.with_length(docs, shared=shared)).collect()
    assert min(Counter(r.doc_id for r in rows).values()) > 1 and all(r.used <= r.capacity for r in rows)


def test_pipeline_packs_tokens(spark, small):
    texts, got = {r.doc_id: r.text for r in small.collect()}, Counter()
    for r in corpus_pipeline.run(spark, SF_SMALL).collect():
        got[r.doc_id] += r.length
        assert r.used <= r.capacity
    assert got == {d: len(ids_of(WORD, texts[d])) + 1 for d in got} and got
