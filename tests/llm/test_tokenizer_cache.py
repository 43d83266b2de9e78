"""A worker tells tokenizer files apart by all of their content."""

import json

import public_tokenizers as P

from scriptorium.llm import queries as Q
from scriptorium.llm import records, tokens
from scriptorium.llm.bpe_automaton import codec
from scriptorium.llm.token_tree import counter

from .conftest import docs_of


class Shared:
    def __init__(self, content):
        self.value = content


def swapped(tmp_path):
    """Two files of one length and a common beginning that differ in two ids far behind it."""
    with open(P.path(Q.WORD_FILE), encoding="utf-8") as f:
        data = json.load(f)
    vocab = data["model"]["vocab"]
    a, b = next((x, y) for x in ("the</w>",) for y in ("and</w>",))
    paths = []
    for name in ("one", "two"):
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(data, ensure_ascii=False), encoding="utf-8")
        paths.append(str(path))
        vocab[a], vocab[b] = vocab[b], vocab[a]
    one, two = (open(p, encoding="utf-8").read() for p in paths)
    assert len(one) == len(two) and one[:4096] == two[:4096] and one != two
    return paths


def test_two_files_in_one_worker(spark, tmp_path):
    docs = docs_of(spark, ["the cat and dog"]).coalesce(1)
    paths = swapped(tmp_path)
    for path in (*paths, *paths):
        shared = tokens.share(spark, path)
        want = tokens.plain_tokenizer(shared.value.content).encode("the cat and dog", add_special_tokens=False).ids
        assert records.encoder(shared).encode("the cat and dog") == records.encoder(shared).pack(want)
        assert codec(shared).encode("the cat and dog") == tokens.pack(want)
        row = records.record_digest(docs, shared).first()
        assert row.n_tokens == len(want) + 1
        folder = str(tmp_path / f"records-{shared.value.digest[:8]}-{paths.index(path)}-{id(shared)}")
        records.write_records(docs, shared, folder, partitions=1)
        assert records.read_records(spark, folder).first().ids == tokens.pack([*want, 2])


def test_worker_keeps_one(spark):
    shared = tokens.share(spark, P.path(Q.BYTE_FILE))
    assert counter(shared) is counter(tokens.share(spark, P.path(Q.BYTE_FILE)))
