import pytest

#: Rows that every operator must take: null, empty, blank, long, repeated and tied texts.
ODD = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "one two three four five"), (4, "one two three four five"), (5, "ONE two"), (6, "x " * 30_000), (7, "é日本👍 <|endoftext|> a|b | ▁ c\x1cd e"), (None, "lost id"), (8, "same words here"), (9, "same words here")]


@pytest.fixture(scope="session")
def odd(spark):
    """With extra columns whose names clash with those that operators make."""
    return spark.createDataFrame([(*r, f"k{i}", i) for i, r in enumerate(ODD)], "doc_id long, text string, kept string, n_lines int")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet").cache()
