"""Alignment against a plain form that goes byte by byte, with both libraries on whole texts."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from geoplane.llm import alignment
from geoplane.llm.pieces import MODEL, model_path

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(model_path(alignment.BYTES_MODEL))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=model_path(MODEL))


def plain_tokens(libraries, text):
    """Ids of both sides and where they end, or nothing."""
    a, b = libraries
    letters = alignment._byte_letters()
    if not text:
        return [], [], [], []
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    spelled = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
    if any(b"".join(s) != b" " + text.encode() for s in spelled):
        return [], [], [], []
    return *ids, *(np.cumsum([len(t) for t in s]).tolist() for s in spelled)


def plain_measures(libraries, docs):
    each, pairs = [], Counter()
    for doc_id, text in docs:
        a, b, ends_a, ends_b = plain_tokens(libraries, text)
        at_a, at_b = ({e: k for k, e in enumerate(x)} for x in (ends_a, ends_b))
        common = sorted(set(at_a) & set(at_b))
        links = [(a[at_a[e]], b[at_b[e]]) for e in common]
        groups, i, j = [], 0, 0
        for e in common:
            groups.append(",".join(map(str, a[i : at_a[e] + 1])) + "|" + ",".join(map(str, b[j : at_b[e] + 1])))
            i, j = at_a[e] + 1, at_b[e] + 1
        pairs.update(links)
        each.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    most = Counter()
    for (_, y), n in pairs.items():
        most[y] = max(most[y], n)
    return sorted((d, na, nb, g, len(links), sum(pairs[x] == most[x[1]] for x in links), sum(pairs[x] for x in links), sha) for d, na, nb, g, links, sha in each)


def test_query_is_the_plain_form(spark, libraries):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    assert sorted(map(tuple, alignment.op13_alignment(spark, SF).collect())) == plain_measures(libraries, docs)


def odd_texts():
    rnd = random.Random(0)
    odd = ["", " ", "  ", "a", "▁", "a ▁ b", "\x00", "a \x00b", "<|endoftext|> <s>", "naïve café", "日本語 テキスト", "🙂🙂 é", " lead", "trail ", "a  b", "a b  c", "x\n\ny", "don't we'll", None]
    return odd + ["".join(rnd.choice("abe '\n é日🙂0.") for _ in range(rnd.randrange(60))) for _ in range(300)]


def test_odd_texts(spark, libraries):
    docs = list(enumerate(odd_texts()))
    got = sorted(map(tuple, alignment.measures(spark.createDataFrame(docs, "doc_id long, text string")).collect()))
    assert got == plain_measures(libraries, docs)
    rows = alignment.align(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    for r in rows:
        a, b, ends_a, ends_b = plain_tokens(libraries, docs[r.doc_id][1])
        starts_a, starts_b = [0, *ends_a][:-1], [0, *ends_b][:-1]
        want = {(i, j, ends_a[i] == ends_b[j]) for i in range(len(a)) for j in range(len(b)) if max(starts_a[i], starts_b[j]) < min(ends_a[i], ends_b[j])}
        assert (list(r.a_ids), list(r.b_ids)) == (a, b) and len(r.overlaps) == len(want) and set(map(tuple, r.overlaps)) == want


def test_a_text_of_several_stretches(spark, libraries):
    long = "some words that go on, and on; " * 80_000  # over two million characters
    docs = [(1, long), (2, long + "▁"), (3, "short")]
    got = sorted(map(tuple, alignment.measures(spark.createDataFrame(docs, "doc_id long, text string")).collect()))
    assert got == plain_measures(libraries, docs)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = alignment.measures(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {tuple(r[1:]) for r in rows if r.doc_id in (3, 4)} == {(0, 0, 0, 0, 0, 0, "")}
    assert alignment.measures(no_docs).collect() == alignment.align(no_docs).collect() == []
