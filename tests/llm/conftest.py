import pytest

LONG = "the quick brown fox jumps over a lazy dog. " * 20_000


PII_KEY = "the key of the tests"


@pytest.fixture(scope="session", autouse=True)
def key(spark):
    spark.conf.set("granulon.pii.key", PII_KEY)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns named like those the operators use."""
    rows = [
        (None, "no id here of the kind", "a"), (1, None, "a"), (1, None, "a"), (2, "", "b"), (3, "same text of the day", "c"), (4, "same text of the day", None), (4, "same text of the day", None),
        (5, LONG, "d"), (6, " \n\t ", "e"), (7, "x" * 50_000, "f"), (8, "日本語 🎉 ñandú\x00\x01", None), (-9, "card 4111111111111111 of a.b@c.de", "g"),
    ]
    df = spark.createDataFrame([(i, t, s, "mine", 1, 2.0) for i, t, s in rows], "doc_id bigint, text string, source string, _key string, fp int, score double")
    return df.withColumnsRenamed({}).selectExpr("*", "source as _pii", "1 as kept", "2 as id", "3 as text_hash", "4 as n_tokens", "'x' as _first", "5 as piece", "'z' as fingerprint")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
