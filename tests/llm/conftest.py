import pytest

LONG = "word " * 40_000 + "x" * 150_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, sig string, stratum string, length long, chunk long, held_out string, band int, comp string, task string, part long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, an id with two texts, columns with clashing names."""
    texts = [(1, "a b c d e f g h", "en"), (1, "a b c d e f g h", "en"), (2, None, "en"), (3, "", None), (None, "z y x w v u", "fr"), (None, None, None), (4, LONG, "en"), (5, " \n\t \n", "de"), (6, "ab c \U0001f600 ▁ \x00 '\"<b>", None), (7, "one", "xx"), (7, "another text entirely, with more words", "en")]
    return spark.createDataFrame([(i, t, lang, None, 3, "k", None, "s", 1, 2, "h", 3, "c", None, None) for i, t, lang in texts], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, None), (None, 0, 1), (7, None, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def local(docs):
    return {r.doc_id: r for r in docs.collect()}
