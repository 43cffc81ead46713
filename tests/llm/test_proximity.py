"""Windows that begin before their document."""

from geoplane.llm import decontam


def test_proximity_at_the_beginning_of_documents(spark):
    docs = spark.createDataFrame([(1, "b a c d"), (2, "x y a b c d"), (3, "b a c d"), (4, "z z")], "doc_id bigint, text string").coalesce(1)
    more = spark.createDataFrame([(5, "a a c c d d")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(9, "a b c d")], "item_id bigint, text string")
    # b is the rarest word: it stands a word early where the first two are swapped
    got = decontam.phrase_matches(docs.unionByName(more).coalesce(1), bench, slop=2).collect()
    assert sorted((r.doc_id, r.item_id, r.start) for r in got) == [(1, 9, -1), (2, 9, 2), (3, 9, -1)]
