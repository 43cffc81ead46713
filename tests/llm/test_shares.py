"""Training samples: no class of rows falls out of them, however large the input is."""

import pytest
from pyspark.sql import functions as F

from geoplane.llm import language, toxicity
from geoplane.llm.common import share_of


@pytest.mark.parametrize("n", [10, 10**9, 10**10, 10**15])
def test_share_is_never_zero(spark, n):
    df = spark.range(1).select(share_of(F.lit(-(1 << 63)), 2000, n).alias("least"), share_of(F.lit((1 << 63) - 1), 2000, n).alias("most"))
    assert tuple(df.first()) == (True, n <= 2000)


def test_share_is_near_what_is_asked_for(spark):
    got = spark.range(200_000).filter(share_of(F.xxhash64("id"), 2000, 200_000)).count()
    assert 1800 < got < 2200


def test_languages_of_all_sizes_are_learned(spark):
    rows = [(i, "en" if i % 50 else "de", f"some words {i}" if i % 50 else f"einige Worte {i}") for i in range(3000)]
    model = language.train(spark.createDataFrame(rows, "doc_id bigint, lang string, text string"), docs_a_language=30)
    assert model.langs == ["de", "en"] and model.predict(["einige Worte", "some words"])[0][0] == "de"


def test_conflicting_labels_and_texts(spark):
    docs = spark.createDataFrame([(i, t) for i in range(40) for t in ("b", "you rotten scumbag" if i % 2 else "a kind word")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, x) for i in range(40) for x in ((0, 1) if i % 2 else (0,))], "doc_id bigint, toxic int")
    one, two = (toxicity.train(d, labels.repartition(n)).score(["you rotten scumbag", "a kind word", ""]).tolist() for d, n in ((docs, 1), (docs.repartition(5), 3)))
    assert one == two
    none = toxicity.train(docs, labels, longest=0)
    assert none.score(["x"]).tolist() == [0.0]
