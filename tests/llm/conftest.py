import duckdb
import pytest

SF_DIR = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet " * 20_000  # half a million signs


@pytest.fixture(scope="session")
def rows():
    """``rows(table)``: rows of a small test table, as tuples in the order of its columns."""
    return lambda table: duckdb.sql(f"SELECT * FROM '{SF_DIR}/{table}.parquet'").fetchall()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n int, term string, shard int, error string"


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and blank texts, a very long one, ties and repeated rows, one word without an end."""
    texts = [
        None, "", " \n\t ", LONG, "x" * 300_000, "one", "One two", "one two", "a b c", "A  B\tC", "?!?! 123", "été où ça", "日本語 テキスト",
        'key = "9f8e7d6c5b4a39281706f5e4d3c2b1a0"', "the same text here", "the same text here", "<|endoftext|> </s> İ́ 'tis ǅ ſ",
    ]
    made = [(i, t, ("en", "fr", None)[i % 3], "s", None, 0.5, 1, "t", 3, "e") for i, t in enumerate(texts)]
    return [*made, made[14], (None, "the same text here", None, None, None, None, None, None, None, None), (None,) * 10, (-5, "one two", "en", "s", 7, None, 0, "", 0, "")]


@pytest.fixture(scope="session")
def edges(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
