import pytest

from readloom.llm.common import cut

#: Texts that operators must take: null, empty, blank, repeated, very long, with odd characters.
ODD = [None, "", "  \t\n ", "the same text", "the same text", "a" * 5000, "word " * 3000, "x\x00y \x7f\x1c \x85 z\xa0q é ﬁ ½ 日本語 🙂", "It's  <|endoftext|> don't!!! ''s", "\n\n\n", "▁ mark ▁▁", "A\r\nB\x0bC\x0cD"]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts with repeated and null ids, nulls in all columns, and columns whose names clash with those operators make."""
    rows = [(None if i == 8 else i - (i == 4), t, None if i % 5 == 0 else f"host{i % 2}", None, 7, 7, "y") for i, t in enumerate(ODD)]
    return cut(spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, n_words long, score int, row string").repartition(3))


@pytest.fixture(scope="session")
def sample(spark):
    """The documents of the smallest test tables, and their labels."""
    import os

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
