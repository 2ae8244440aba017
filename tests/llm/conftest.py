import pytest

SF = "/root/testdata/sf0.001"
KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(corpus):
    return {r["doc_id"]: r["text"] for r in corpus.collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and repeated rows, a long text, and columns named as operators name theirs."""
    rows = [
        (1, None, None, None, None), (None, "alpha beta gamma delta epsilon zeta", "en", "s", 5), (2, "", "en", "s", 0),
        (3, "one two three four five six seven", "en", None, 9), (3, "one two three four five six seven", "en", None, 9),
        (4, "one  two\nthree four\tfive six seven ", "de", "t", 9), (5, " \n\t ", "fr", "t", 4), (6, "12 34 !!", None, "t", 8),
        (7, "word " * 30_000, "en", "s", 150_000), (8, "x" * 200_000, "en", "u", 200_000),
        (9, "éß\U0001f600 中文\u0085  tail", "de", "u", 12),
    ]
    df = spark.createDataFrame(rows, KIND)
    from pyspark.sql import functions as F

    clash = ["kept", "score", "node", "size", "n", "ids", "digest", "row", "key", "_k", "_id", "_d", "_key", "_kept", "bucket", "sk", "place", "start", "block", "copies", "h"]
    return df.withColumns({c: F.lit("mine") for c in clash})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], KIND)
