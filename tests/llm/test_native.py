"""Operators that SQL can express, on odd rows and against their SQL."""

import duckdb
import pytest

from geoplane.llm import chat, licenses, lines, queries
from geoplane.llm.license_texts import TEXTS

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql_gives_the_same(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted((tuple(r) for r in got.select(*columns).collect()), key=str)
    assert rows == sorted((tuple(None if v != v or v is None else v for v in r) for r in want[columns].astype(object).itertuples(index=False)), key=str)


def test_snapshots_collapse(spark):
    a, b, c = ("user", "hi"), ("assistant", "hello"), ("user", "bye")
    logs = {1: [a], 2: [a, b], 3: [a, b, c], 4: [a, b, c], 5: [b, a], 6: [(None, None)], 7: [(None, ""), a]}
    rows = [(k, i, *t, "x") for k, v in logs.items() for i, t in enumerate(v)] + [(None, 0, "user", "lost", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, p1 string")
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert {k: (r.n_turns, r.n_logged) for k, r in got.items()} == {3: (3, 2), 5: (2, 1), 7: (2, 1)}
    assert got[5].text == "<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n"
    assert chat.format_chats(df.limit(0)).collect() == []


def test_turns_in_any_order_and_long_conversations(spark):
    many = [(1, i, "user", f"t{i}") for i in range(2000)]
    part = [(2, i, "user", f"t{i}") for i in range(1500)]
    df = spark.createDataFrame(part[::-1] + many[::-1], "conv_id bigint, turn bigint, role string, text string")
    assert [(r.conv_id, r.n_turns) for r in chat.format_chats(df).collect()] == [(1, 2000)]


def test_lines_of_a_site(spark, odd_docs, no_docs):
    rows = [(i, "h", f"menu\n text {i}\n\nfoot ") for i in range(10)] + [(10, None, "menu\nfoot"), (11, "h", None), (12, "h", "")]
    df = spark.createDataFrame(rows, "page_id bigint, site string, text string")
    got = {r.page_id: r for r in lines.drop_boilerplate(df, "site", "text", counts=("before", "gone")).collect()}
    assert got[3].text == " text 3\n" and got[3].gone == 2 and got[3].before == 4
    assert got[10].text == "menu\nfoot" and got[11].text is None and got[12].text == ""
    out = lines.drop_boilerplate(odd_docs, "source", "text")
    assert out.count() == odd_docs.count() and out.columns[: len(odd_docs.columns)] == odd_docs.columns
    assert lines.drop_boilerplate(no_docs, "source", "text").collect() == []


def test_licenses(spark, odd_docs, no_docs):
    mit = TEXTS["MIT"].replace("Copyright (c) <year> <copyright holders>", "Copyright 2024 Someone\nAll rights reserved.").replace("sublicense", "sub-licence")
    rows = [(1, mit.upper()), (2, "x " + mit), (3, None), (4, "---"), (5, TEXTS["ISC"].replace("\n", "\r\n")), (5, TEXTS["ISC"])]
    df = spark.createDataFrame([(*r, "d", "l") for r in rows], "doc_id bigint, text string, digest string, license_id string")
    got = licenses.scan(df, licenses.known(spark)).collect()
    assert sorted((r.doc_id, r.license_id) for r in got if r.license_id) == [(1, "MIT"), (5, "ISC"), (5, "ISC")]
    assert {r.doc_id for r in got if r.digest is None} == {3, 4} and len(got) == 6
    assert licenses.scan(odd_docs, licenses.known(spark)).count() == odd_docs.count()
    assert licenses.scan(no_docs, licenses.known(spark)).collect() == []


def test_users_columns_stay(spark):
    rows = [(i, "a", f"menu\n{i}", "h", 5, "m", "k", "l", "d") for i in range(8)]
    df = spark.createDataFrame(rows, "page_id bigint, site string, text string, _host string, host int, _marks string, _kept string, _lines string, _dropped string")
    out = lines.drop_boilerplate(df, "site", "text")
    assert out.columns == df.columns
    assert sorted(tuple(r) for r in out.collect()) == sorted((*r[:2], r[2][5:], *r[3:]) for r in rows)


def test_small_sites_keep_their_lines(spark):
    for n in (4, 5):
        df = spark.createDataFrame([(i, "a", f"menu\n{i}") for i in range(n)], "page_id bigint, site string, text string")
        got = {r.text for r in lines.drop_boilerplate(df, "site", "text").collect()}
        assert got == {f"menu\n{i}" if n < lines.MIN_PAGES else str(i) for i in range(n)}


def test_pages_without_html_or_url(spark, tmp_path):
    rows = [(i, u, h) for i, (u, h) in enumerate([(None, "<p>menu</p>x"), ("http://a.b/", None), (None, None), ("", ""), ("http://A.B/c", "<p>menu</p>"), ("nonsense", "<script>x</script>")] + [(None, "<p>menu</p>")] * 5)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, lines.op6_lines(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(con.sql(f"select page_id, host, n_lines, n_dropped, text from ({lines.SQL})").fetchall())
    assert got[1][4] is None and got[0][3] == 1 and got[4][3] == 0


def test_adjacent_spellings(spark):
    df = spark.createDataFrame([("Licence licence. LICENCE sub licence",), ("sub license per cent per cent",), ("a b",)], "text string")
    assert [r[0] for r in df.select(licenses.canonical(df.text)).collect()] == ["license license license sublicense", "sublicense percent percent", "a b"]


def test_forms_are_found(spark):
    got = {r.doc_id: r.license_id for r in licenses.license_forms(spark, SF).collect()}
    assert len(got) == 6 * len(TEXTS)
    assert all(v == (k.rsplit("/", 1)[0] if not k.endswith("/5") else None) for k, v in got.items())
