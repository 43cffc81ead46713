"""Turns that tie."""

import duckdb

from geoplane.llm import chat


def test_tied_turns_are_in_order_of_text(spark):
    rows = []
    for i in range(40):
        x, y = f"first {i}", f"second {i}"
        rows += [(4 * i, 0, "user", x), (4 * i + 1, 0, "user", y), (4 * i + 1, 0, "user", x)]  # collapses
        rows += [(4 * i + 2, 1, "user", y), (4 * i + 3, 1, "user", y), (4 * i + 3, 1, "user", x)]  # does not
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    con = duckdb.connect()
    con.register("conversations", df.toArrow())
    want = con.sql(chat.SQL).fetchall()
    got = chat.format_chats(df).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert len(want) == 80 and {r[0] % 4 for r in want} <= {1, 2, 3}
