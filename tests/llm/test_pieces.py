"""Encoding and decoding against the library whose model it is."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from geoplane.llm import pieces, spaced

PATH = pieces.model_path(pieces.MODEL)
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rnd = random.Random(0)
    odd = ["", "a", " ", "  ", "\x00", "a\x00", " " * 40 + "abc", "a" + " " * 33, "▁", "▁▁a b", "\n\t x", "a" * 20, "=" * 1000, "<s></s><0x41>", "🙂🙂 é", "abab" * 50, " a  b   c    d", "日本語テキスト" * 30, "the " * 10 + "x" * 100]
    odd += [" " * n + "w" for n in range(70)]
    for letters, n, size in (("abcdefghijklmnopqrstuvwxyz    theing▁=-.,\n🙂éßñ日", 800, 400), ("ABCabcdexyz0189+/", 5, 5000), ("the ing", 200, 300), ("athe", 200, 300)):
        odd += ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, size))) for _ in range(n)]
    return odd


def test_ids_are_those_of_the_library(library):
    v, own = pieces.vocabulary(PATH), texts()
    ids, counts = v.encode(own)
    for text, got, want in zip(own, np.split(ids, np.cumsum(counts)[:-1]), library.encode(own)):
        assert got.tolist() == want, text[:50]
        assert v.decode([v.begin, *got, v.end]) == library.decode([1, *want, 2]) == text.replace("▁", " ")


def test_any_ids_decode_as_by_the_library(library):
    v, rnd = pieces.vocabulary(PATH), random.Random(1)
    for _ in range(3000):
        ids = [rnd.choice([0, 1, 2, 3 + rnd.randrange(256), rnd.randrange(v.size)]) for _ in range(rnd.randrange(12))]
        assert v.decode(ids) == library.decode(ids)


def test_long_words_end_soon(library):
    """A word of 300,000 characters takes few rounds, as it falls apart."""
    rnd = random.Random(2)
    long = "".join(rnd.choice("ABCDEFabcdefghij0123456789+/") for _ in range(300_000))
    assert pieces.vocabulary(PATH).encode([long])[0].tolist() == library.encode(long)


def test_stretches_give_back_texts():
    rnd = random.Random(3)
    own = ["".join(rnd.choice("ab  \n") for _ in range(rnd.randrange(200))) for _ in range(50)] + [None, ""]
    back = [[] for _ in own]
    for rows, parts, first in spaced.stretches(own, 20):
        for row, part, begins in zip(rows, parts, first):
            assert begins == (not back[row])
            back[row].append(part)
    assert [" ".join(p) for p in back] == [t or "" for t in own]


def test_query_is_the_library(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    got = {r.doc_id: r for r in pieces.op12_pieces(spark, SF).collect()}
    assert len(got) == len(docs)
    for doc_id, text in zip(docs.doc_id, docs.text):
        ids = [1, *library.encode(text or ""), 2]
        sha = lambda b: hashlib.sha256(b).hexdigest()
        r = got[doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids).encode()))


def test_odd_rows(spark, odd_docs, no_docs, library):
    rows = pieces.encode(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    want = {r.doc_id: r.text or "" for r in odd_docs.collect() if r.doc_id is not None}
    for r in rows:
        if r.doc_id is not None:
            assert list(r.ids) == [1, *library.encode(want[r.doc_id]), 2] and r.decoded == want[r.doc_id]
    assert pieces.encode(no_docs).collect() == pieces.digests(no_docs).collect() == []
    assert len(pieces.digests(odd_docs).collect()) == len(rows)
