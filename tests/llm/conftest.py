import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _n int, lo int, fp string, component_id string, _id string, _host string, _lines int, _dropped int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, columns with clashing names."""
    long = " ".join(f"word{i % 997} other{i % 13}" for i in range(60_000))
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon. " * 3
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, None, "en", None), (4, "", None, "b"), (5, " \n\t", "fr", "b"),
        (6, long, "en", "a"), (None, base, "en", "a"), (7, "one", None, None), (8, "one two", "de", "c"), (9, "Ünï çode — \U0001f600 text", "de", "c"),
        (10, base + "omega", "en", "b"), (None, None, None, None),
    ]
    return spark.createDataFrame([(*r, 0, 1, 2, "x", "y", "i", "h", 7, 8) for r in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
