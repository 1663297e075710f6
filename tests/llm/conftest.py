import pytest

from lathe.llm.batches import read_table

SF = "/root/testdata/sf0.001"
#: Rows that every operator must take: nulls, empty and odd texts, ties, repeated rows.
HARD = [
    (5, None),
    (5, ""),
    (None, "one two three four five six"),
    (7, "one two three four five six"),
    (7, "one two three four five six"),
    (8, " \t\n\x0b\r "),
    (9, "<|endoftext|> x <|startoftext|>'s don't É ſ \x1c\x85 漢字 🙂 12345"),
    (10, "x" * 50_000),
    (11, "word " * 20_000),
    (-3, "a\n\na\nb"),
]


@pytest.fixture
def hard(spark):
    """The hard rows, with columns whose names clash with results."""
    return spark.createDataFrame(
        [(i, t, "en", "s", 1, True, 2) for i, t in HARD],
        "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n_tokens int",
    )


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture
def docs(spark):
    return read_table(spark, SF, "documents")


@pytest.fixture
def rows(docs):
    return sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
