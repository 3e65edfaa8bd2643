import pytest

# Rows that any table of documents may hold: nulls, empty and long texts, ties, repeats, extra columns.
LONG = "word " * 4000 + "x" * 9000 + " 12'34 " * 900


@pytest.fixture(scope="session")
def odd_rows():
    text = "The same line of some length that stands in many documents\nand one more line, of its own"
    return [
        (3, None, "en"), (1, "", "en"), (2, " \n\t ", None), (4, LONG, "en"), (5, LONG, "fr"), (6, text, "en"),
        (6, text, "en"), (7, text, "de"), (8, text + " x", None), (9, text, "en"), (10, text, "en"), (11, text, "en"),
        (12, "No spaces:ÀÉÎ𝔘́漢字かなقلم <|endoftext|> it's  two  \n\n lines\x00\x1c", "fr"), (13, "password = 'abcdefgh12345678'", "en"),
        (None, text, "en"), (14, "a", "en"),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    rows = [(*r, "s", 1, 2, b"k", [1]) for r in odd_rows]
    # extra columns with names that operators may use themselves
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, part int, key binary, row array<int>"
    )


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("1 = 0")
