"""Rows without doc_id, and several texts of one doc_id: each row stands for its own text."""

from geoplane.llm import decontam, similar

DOCS = "doc_id bigint, text string, _row int"
ONE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
TWO = "the river runs under a bridge of stone and past the old mill at noon"
THREE = "many ships were lost near that coast before the lighthouse was built"


def kept(spark, rows, stage):
    docs = spark.createDataFrame([(*r, 0) for r in rows], DOCS)
    out = stage(docs)
    assert out.columns == docs.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


def test_one_row_of_each_component(spark):
    rows = [(None, ONE), (None, TWO), (None, TWO), (7, ONE), (8, THREE), (8, TWO + " again and again"), (9, THREE), (9, THREE)]
    want = [(7, ONE), (None, TWO), (8, THREE), (8, TWO + " again and again")]
    assert kept(spark, rows, similar.keep_one) == sorted(want, key=str)


def test_rows_that_hold_a_passage(spark):
    benchmark = spark.createDataFrame([(1, ONE), (2, "gamma delta")], "item_id bigint, text string")
    rows = [(None, ONE), (None, TWO), (None, None), (7, "so " + ONE), (7, THREE), (8, "gamma delta"), (9, TWO), (9, TWO)]
    want = [(None, TWO), (None, None), (7, THREE), (9, TWO), (9, TWO)]
    assert kept(spark, rows, lambda docs: decontam.drop_contaminated(docs, benchmark)) == sorted(want, key=str)
