import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from geoplane.llm import substrings

SF = "/root/testdata/sf0.01"


def brute(docs, n=50):
    """docs: (doc_id, text)."""
    least = {}
    data = [(d, (t or "").encode()) for d, t in docs]
    for d, t in data:
        if d is not None:
            for i in range(len(t) - n + 1):
                w = t[i : i + n]
                if d < least.get(w, d + 1):
                    least[w] = d
    out = []
    for d, t in data:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - n + 1):
            if d is not None and least[t[i : i + n]] < d:
                gone[i : i + n] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((d, len(t), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def test_query_is_brute_force(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    want = brute(docs)
    assert any(r[2] for r in want)
    assert rows(substrings.op8_substrings(spark, SF)) == want


@pytest.mark.parametrize("limit, chunk, part, piece", [(3, 300, 500, 1), (50, 500, 1 << 26, 40), (20_000, 1 << 21, 1 << 26, 10**6)])
def test_hard_texts(spark, limit, chunk, part, piece):
    rng = random.Random(2)
    noise = lambda k: "".join(rng.choice("ab ") for _ in range(k))
    passage = noise(120)
    docs = [(i, noise(rng.randrange(60)) + passage[rng.randrange(20) : 100 + rng.randrange(20)] + noise(30)) for i in range(60)]
    docs += [(100, "x" * 200), (101, "x" * 49), (102, "x" * 50), (103, "x" * 70), (104, "ab" * 60), (105, "ba" * 60), (99, "é" * 60), (98, "é" * 40 + "\0" * 55), (97, "\0" * 60)]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert rows(substrings.remove_repeats(df, limit=limit, chunk=chunk, part_bytes=part, piece=piece)) == brute(docs)


def test_odd_rows(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert rows(substrings.remove_repeats(odd_docs)) == brute(docs)
    assert substrings.remove_repeats(no_docs).collect() == []


@pytest.mark.parametrize("length, gram", [(20, 6), (21, 6)])
def test_no_sharing_segment_is_left_out(length, gram):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab") for _ in range(60)).encode() for _ in range(60)]
    texts += [t[: rng.randrange(30, 60)] + t[:5] for t in texts[:30]]
    own, first, last, hashed, _, _, place = substrings.anchors(texts, length, gram)
    segments = [texts[o][a : b + length] for o, a, b in zip(own, first, last)]
    keep = substrings.may_share(pa.array(segments), place, hashed.view(np.int64), own, length, gram)
    holders = {}
    for k, s in enumerate(segments):
        for i in range(len(s) - length + 1):
            holders.setdefault(s[i : i + length], []).append(k)
    sharing = {k for ks in holders.values() if len({own[k] for k in ks}) > 1 for k in ks}
    assert sharing and sharing <= set(np.flatnonzero(keep)) and not keep.all()


def test_classes_are_those_of_sorted_suffixes():
    rng = random.Random(4)
    segments = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 30))).encode() for _ in range(40)]
    text = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    for length in (1, 3, 8, 20):
        order = substrings.suffix_order(text, length)
        suffix = [bytes(text[i : i + length]) for i in order]
        assert suffix == sorted(suffix)
        starts = substrings.prefix_classes(text, order, length)
        for k in range(1, len(order)):
            if len(suffix[k]) == length == len(suffix[k - 1]):
                assert starts[k] == (suffix[k] != suffix[k - 1])


def test_blobs_follow_the_anchors(spark):
    """Not the chunks times the parts, which both grow with the input."""
    import random

    rng = random.Random(0)
    docs = spark.createDataFrame([(i, i, "".join(rng.choices("abcdefgh", k=2000))) for i in range(100)], "doc_id bigint, key bigint, text string").coalesce(1)
    blobs = substrings._blobs(docs, 40, 50, 16, 2000)
    rows = blobs.selectExpr("part", "size(gram) as n").collect()
    assert len(rows) <= 40 and sum(r.n for r in rows) > 5000  # before: each of 100 chunks had a blob for each part
