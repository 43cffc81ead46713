"""Runs against all maximal stretches by their definition, and extensions against comparing symbol by symbol."""

import hashlib
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np

from geoplane.llm import periodic

SF = "/root/testdata/sf0.01"


def plain_runs(words):
    """(start, length, period): for each period the maximal stretches of words that equal those a period further."""
    w, out = np.unique(np.asarray(words), return_inverse=True)[1] if len(words) else np.zeros(0, int), {}
    for p in range(1, len(w) // 3 + 1):
        edges = np.flatnonzero(np.diff(np.r_[False, w[:-p] == w[p:], False].astype(int)))
        for s, e in zip(edges[::2], edges[1::2]):
            if e - s + p >= max(24, 3 * p):
                out.setdefault((int(s), int(e - s + p)), p)
    return sorted((s, n, p) for (s, n), p in out.items())


def repeating(rng, n, letters):
    w, i = rng.integers(0, letters, n), np.arange(n)
    if n and rng.random() < 0.7:
        a = rng.integers(0, n)
        w = w[np.where(i < a, i, a + (i - a) % (1 + (n - a) // int(rng.integers(3, 11))))]
    return w


def test_runs_are_all_maximal_stretches(monkeypatch):
    rng = np.random.default_rng(0)
    for places in (4_000_000, 500):
        monkeypatch.setattr(periodic, "PLACES", places)
        for _ in range(150):
            docs = [repeating(rng, int(rng.integers(0, 300)), int(rng.integers(1, 6))) for _ in range(rng.integers(1, 8))]
            got = periodic.runs_of(np.concatenate(docs), np.array([len(d) for d in docs]))
            for k, d in enumerate(docs):
                assert sorted(map(tuple, got[got[:, 0] == k][:, 1:].tolist())) == plain_runs(d)


def test_extensions_are_those_of_the_symbols():
    rng = np.random.default_rng(1)
    for letters in (1, 2, 5, 50):
        for _ in range(20):
            w = np.r_[1000, repeating(rng, 200, letters), 1001]
            g = periodic.Grammar(w)
            i, j = rng.integers(1, 201, 300), rng.integers(1, 201, 300)
            i, j = i[i != j], j[i != j]
            for a, b, f, back in zip(i, j, g.forward(i, j), g.backward(i, j)):
                ahead = next(k for k in range(300) if w[a + k] != w[b + k]) if w[max(a, b)] != 1001 else 0
                behind = next(k for k in range(300) if w[a - k] != w[b - k])
                assert (f, back) == (ahead, behind)


def test_grammar_is_small():
    """Nodes are a few times the symbols, and of a sequence that repeats only a few more than of what it repeats."""
    rng = np.random.default_rng(2)
    w = np.r_[10**6, rng.integers(0, 1000, 100_000), 10**6 + 1]
    assert len(periodic.Grammar(w).sym) < 6 * len(w)
    again = periodic.Grammar(np.r_[10**6, np.tile(rng.integers(0, 1000, 100), 1000), 10**6 + 1])
    assert len(set(again.sym[again.size :].tolist())) < 1500


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *four, sha("".join(f"{s},{m},{q}\n" for s, m, q in sorted(runs, key=lambda r: (r[0], r[2])))), sha(kept))


def test_query_is_the_plain_form(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    got = {r[0]: tuple(r[1:]) for r in periodic.op11_runs(spark, SF).collect()}
    assert got == {i: plain_row(i, t) for i, t in docs}
    assert sum(r[0] > 0 for r in got.values()) > 50


def test_odd_rows(spark, odd_docs, no_docs):
    rows = periodic.find_runs(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    texts = {r.doc_id: r.text for r in odd_docs.collect() if r.doc_id is not None}
    for r in rows:
        if r.doc_id is not None:
            words = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")
            if len(words) < 5000:
                assert [tuple(x) for x in r.runs] == plain_runs(words)
            if not r.runs:
                assert r.collapsed == " ".join(words)
    assert [len(r.runs) for r in rows if r.doc_id == 6] == [1]  # the long text repeats as a whole
    assert periodic.find_runs(no_docs).collect() == []
    assert len(periodic.planted(odd_docs).collect()) == len(rows)


def test_query_on_texts_without_words(spark, tmp_path):
    """Every tenth document by its hash repeats itself; one without words has no place to begin at."""
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    docs = list(zip(ids, ["", " \t\n", None, "a", "a b c", "x " * 50])) + [(10**6 + 1, "")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r[0]: tuple(r[1:]) for r in periodic.op11_runs(spark, str(tmp_path)).collect()} == {i: plain_row(i, t) for i, t in docs}
