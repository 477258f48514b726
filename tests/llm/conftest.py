import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [
        (1, None, None), (2, "", "a"), (3, "", "a"), (None, "null id", "a"), (None, "null id", "b"), (5, "Same Text here", "b"),
        (5, "Same Text here", "b"), (6, "same text HERE", None), (7, "x " * 60_000, "c"), (8, "Ä" * 300, "c"), (9, "one", "c"), (10, "\0\t\r\n ", "c"),
    ]
    rows = [(*r, 0, "y", "z", k, "w") for k, r in enumerate(rows)]
    names = "doc_id long, text string, source string, n_chars long, size string, key string, row long, shard string"
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars long")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    return con
