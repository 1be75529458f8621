import pytest

from voxgauge.llm.shared import documents

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Names that the operators use inside, as columns of the input.
CLASHES = ("size", "digest", "owner", "body", "bits", "key", "root", "a", "b", "spans", "runs", "part", "seq", "length",
           "start", "piece", "ids", "shard", "slot", "word", "chunk", "held_out", "score", "payload", "media", "row")


@pytest.fixture(scope="session")
def docs(spark):
    return documents(spark, SF)


@pytest.fixture(scope="session")
def doc_rows(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, repeated rows, one very long text, characters of several widths."""
    long_text = " ".join(f"wörd{i % 977} {i}" for i in range(60_000))
    texts = [None, "", " ", "\t\n ", "a", "A", "Some words here", "some WORDS here", "ÄÖ ü", "äö ü", long_text, long_text,
             "🙂 emoji 漢字 text", None, "same row", "x" * 30_000, "a b", "1234567890" * 5]
    rows = [(i, t, "en", "s", len(t) if t else 0) for i, t in enumerate(texts)]
    return [*rows, rows[14], rows[14], (None, "no id", None, None, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, SCHEMA).repartition(3)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
