"""Operators that learn: held-out accuracy, and odd rows."""

import zlib

import duckdb
import numpy as np

from geoplane.llm import language, toxicity

SF = "/root/testdata/sf0.01"


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    truth = dict(duckdb.sql(f"select doc_id, toxic from '{sf}/labels.parquet'").fetchall())
    got = toxicity.op5_toxicity(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    own = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([p == t for p, t in own]) > 0.95
    assert sum(p for p, t in own if t) > 0.7 * sum(t for _, t in own) and sum(p for p, t in own if not t) < 0.03 * len(own)


def test_gapped_insults_and_odd_rows(spark, odd_docs, no_docs):
    rng = np.random.default_rng(0)
    clean = [" ".join(rng.choice("the of and to in that was for with hand stone river about under great".split(), 30)) for _ in range(60)]
    model = toxicity.Model([f"the {w} of that river. {t}" for t, w in zip(clean[:30], ["idiot", "moron", "worthless"] * 10)], clean[30:])
    texts = ["You idiot.", "you id-iot!", "what a m.oron", "WORTHLESS", "worthXless", "the great river", "", None]
    assert [int(s >= 0.5) for s in model.score(texts)] == [1, 1, 1, 1, 1, 0, 0, 0]
    got = toxicity.score(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    kept = toxicity.drop_toxic(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert toxicity.score(no_docs, model).collect() == []
    none = toxicity.train(odd_docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert {r.score for r in toxicity.score(odd_docs, none).collect()} == {0.0}


def test_kernel_is_the_sum_over_common_subsequences():
    from itertools import combinations

    def plain(s, t):
        each = lambda x: [("".join(x[i] for i in c), toxicity.DECAY ** (c[-1] - c[0] + 1)) for c in combinations(range(len(x)), toxicity.LENGTH)]
        return sum(a * b for u, a in each(s) for v, b in each(t) if u == v)

    for s, t in (("idiot", "idiot"), ("i-d-iot", "idiot"), ("moronic", "oomorrn"), ("abc", "abcd"), ("aaaaaa", "aaaaa")):
        got = toxicity.kernel(toxicity.codes([s]), toxicity.codes([t], 1))[0]
        assert np.isclose(got, plain(s, t), rtol=1e-5)


def test_language_held_out(spark):
    truth = dict(duckdb.sql(f"select doc_id, lang from '{SF}/documents.parquet'").fetchall())
    got = language.op9_language(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    own = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out]
    assert np.mean(own) > 0.98


def test_language_odd_rows(spark, odd_docs, no_docs):
    model = language.train(odd_docs)
    got = {(r.doc_id, r.lang_pred) for r in language.identify(odd_docs, model).collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (1, "en"), (8, "de")} <= got
    assert language.identify(no_docs, model).collect() == []
    assert {r.lang_pred for r in language.identify(odd_docs, language.train(no_docs)).collect()} == {"und"}


def test_code_lengths_are_of_a_distribution():
    grams = {b"abab": 3, b"abac": 1, b"bacc": 2}
    key = lambda g: int.from_bytes(g[-3:], "big")
    model = language.Model({"x": (np.array([key(g) for g in grams]), np.array(list(grams.values())))}, 2)
    p = np.exp2(-model.bits.reshape(-1, model.symbols, 1)[:, :, 0])
    p[:, -1] *= 256 - (model.symbols - 1)
    assert np.allclose(p.sum(axis=1), 1)
    # after "ba": b 3 times, c once, and so 4 of 6 parts; after "ac" comes c, 2 of 3 parts
    assert np.isclose(model.lengths([b"  bab"])[0, 0] - model.lengths([b"  ba"])[0, 0], -np.log2(3 / 6))
