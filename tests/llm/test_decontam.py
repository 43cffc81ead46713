import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from geoplane.llm import decontam

SF = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, bench):
    windows = {}
    for item, text in bench:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, items = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    items |= found
        digest = hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(items), digest, bool(hit)))
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)


def test_query_is_brute_force(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    bench = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    want = brute(docs, bench)
    assert any(r[5] for r in want)
    assert rows(decontam.op4_decontamination(spark, SF)) == want


@pytest.mark.parametrize("segment, block", [(10, 10**6), (50, 4)])
def test_odd_rows_small_segments_and_blocks(spark, odd_docs, no_docs, segment, block):
    bench = [(1, "alpha beta gamma delta"), (2, "one"), (3, None), (4, ""), (5, "one two three"), (11, "THETA iota, kappa lambda mu nu xi omicron pi rho sigma tau"), (11, "two"), (6, "one")]
    benchmark = spark.createDataFrame([(*b, 1) for b in bench], "item_id bigint, text string, doc_id int")
    want = brute([(r.doc_id, r.text) for r in odd_docs.collect()], bench)
    assert rows(decontam.contamination(odd_docs, benchmark, segment=segment, block=block)) == want
    assert decontam.contamination(no_docs, benchmark).collect() == []
    assert all(r[2] == 0 for r in rows(decontam.contamination(odd_docs, benchmark.limit(0))))
    kept = decontam.drop_contaminated(odd_docs, benchmark)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} == {3, 4, 5, 6, 9, None}


def test_phrases_and_proximity(spark):
    docs = spark.createDataFrame([(1, "x a b c d"), (2, "a b x c d"), (3, "a b"), (4, "c d"), (5, "d c b a")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(9, "a b c d")], "item_id bigint, text string")
    exact = decontam.phrase_matches(docs, bench).collect()
    assert [(r.doc_id, r.item_id, r.window, r.start) for r in exact] == [(1, 9, "a b c d", 1)]
    assert {r.doc_id for r in decontam.phrase_matches(docs, bench, slop=1).collect()} == {1, 2}
    assert {r.doc_id for r in decontam.phrase_matches(docs, bench, slop=6).collect()} == {1, 2, 5}


def test_large_benchmark_costs_little_more(spark):
    """The work follows the places of rarest words, not the windows times the segments."""
    import random
    import time

    rng = random.Random(0)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(2000)}" for _ in range(400))) for i in range(500)], "doc_id bigint, text string").coalesce(1).cache()
    docs.count()
    took = {}
    for n in (80, 5000):
        bench = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(2000)}" for _ in range(40))) for i in range(n)], "item_id bigint, text string")
        began = time.time()
        assert not any(r.contaminated for r in decontam.contamination(docs, bench).collect())
        took[n] = time.time() - began
    assert took[5000] < 6 * took[80] + 5


def test_files_of_the_index_hold_few_segments(spark):
    """Segments are large rows: Parquet holds a hundred before it looks at their size, and reads a file's rows at once."""
    docs = spark.range(0, 40, 1, 1).selectExpr("id as doc_id", "'a b c d e f' as text")
    bench = spark.createDataFrame([(1, "c d e f"), (2, "f a")], "item_id bigint, text string")
    index, _ = next(decontam._searches(docs, bench, 10, 0, 10, 10**6))
    held = [r["count"] for r in index.groupBy(F.input_file_name()).count().collect()]
    assert sum(held) == 40 and max(held) <= decontam.SEGMENTS_A_FILE
    assert rows(decontam.contamination(docs, bench, segment=10)) == brute([(i, "a b c d e f") for i in range(40)], [(1, "c d e f"), (2, "f a")])


def test_postings_pass_through_spark_whole(spark):
    """Half a million positions a row, as an array, cost executors over 3000 MB on 0.51 GB."""
    docs = spark.createDataFrame([(7, "b A b"), (8, None), (9, "a é")], "doc_id bigint, text string").coalesce(1)
    r = decontam.index_segments(docs.selectExpr("doc_id", "doc_id as row", "text"), 10).first()
    assert all(isinstance(x, (bytes, bytearray)) for x in (r.terms, r.counts, r.positions))
    assert (bytes(r.terms).decode().split(), r.doc_ids, r.bases, r.n_words) == (["b", "a", "é"], [7, 8, 9], [0, 13, 23], [3, 0, 2])
    numbers = lambda x: [int.from_bytes(x[i : i + 4], "little") for i in range(0, len(x), 4)]
    assert numbers(r.counts) == [2, 2, 1] and numbers(r.positions) == [0, 2, 1, 23, 24]
    empty = decontam.index_segments(docs.limit(0).selectExpr("doc_id", "doc_id as row", "text"), 10)
    assert empty.collect() == []


def test_small_parts_share_segments(spark):
    """A table in hundreds of small parts had as many small segments, files and tasks."""
    cores = spark.sparkContext.defaultParallelism
    docs = spark.range(0, 400, 1, 10 * cores).selectExpr("id as doc_id", "concat('a b c d e f ', id % 7) as text")
    bench = spark.createDataFrame([(1, "c d e f 3"), (2, "f a")], "item_id bigint, text string")
    index, _ = next(decontam._searches(docs, bench, 10, 0, 10**4, 10**6))
    assert index.count() == cores
    assert rows(decontam.contamination(docs, bench)) == brute([(i, f"a b c d e f {i % 7}") for i in range(400)], [(1, "c d e f 3"), (2, "f a")])
    small, _ = next(decontam._searches(docs, bench, 10, 0, 10, 10**6))
    assert small.count() > 2 * cores
