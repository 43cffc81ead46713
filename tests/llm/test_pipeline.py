"""Each stage of the pipeline against a plain version of what it decides."""

from collections import Counter, defaultdict

import corpus_pipeline
from test_decontam import brute as brute_hits
from test_mixing import check as check_mix
from test_similar import brute_roots

from geoplane.llm import toxicity

SF = "/root/testdata/sf0.01"


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages, columns = dict(corpus_pipeline.STAGES), docs.columns
    model = toxicity.learned(spark, SF)
    before = rows(docs)

    after = stages["toxicity"](spark, docs, SF)
    assert after.columns == columns
    scores = model.score([r[1] for r in before])
    assert sorted(rows(after)) == sorted(r for r, s in zip(before, scores) if s < 0.5) and 0 < after.count() < len(before)

    docs = after.cache()
    before, after = rows(docs), stages["line dedup"](spark, docs, SF)
    assert after.columns == columns
    pages, holds = Counter(r[3] for r in before), defaultdict(Counter)
    for r in before:
        holds[r[3]].update({x.strip(" ") for x in r[1].split("\n")} - {""})
    bad = {s: {x for x, n in c.items() if n >= 5 and n > 0.1 * pages[s]} for s, c in holds.items()}
    want = []
    for r in before:
        kept = [x for x in r[1].split("\n") if x.strip(" ") not in bad[r[3]]]
        text = "\n".join(kept)
        want.append((r[0], text, r[2], r[3], r[4] if len(kept) == r[1].count("\n") + 1 else len(text)))
    assert sorted(rows(after)) == sorted(want) and sorted(want) != sorted(before)

    docs = after.cache()
    before, after = rows(docs), stages["near duplicates"](spark, docs, SF)
    roots, got = brute_roots([r[:2] for r in before]), {r[0] for r in rows(after)}
    keep = {d for d, r in roots.items() if d == r}
    assert after.columns == columns and sorted(rows(after)) == sorted(r for r in before if r[0] in got)
    assert keep <= got and len(got - keep) <= 0.1 * (len(before) - len(keep)) and len(got) < len(before)

    docs = after.cache()
    before, after = rows(docs), stages["decontamination"](spark, docs, SF)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {h[0] for h in brute_hits([r[:2] for r in before], items) if h[5]}
    assert after.columns == columns and sorted(rows(after)) == sorted(r for r in before if r[0] not in bad) and bad

    docs = after.cache()
    check_mix(stages["mixing"](spark, docs, SF).collect(), [(r[0], r[1], r[3]) for r in rows(docs)], 0.02)


def test_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "mixing":
                assert out.columns == docs.columns
                out.collect()
                docs = out
            else:
                assert out.count() == docs.count()
