import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_hash long, score double, keep binary"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank and very long texts, ties, repeated rows, clashing extra columns."""
    line = "A line of more than twenty letters"
    passage = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, None, "en", "a", None, 1, 0.5, b"x"),
        (2, "", None, "a", 0, 1, None, None),
        (3, " \n\t \n", "en", None, 3, 1, 0.5, None),
        (None, f"{line}\nother text of the first null row", "fr", "b", 9, 1, 0.5, None),
        (None, "null twin", "fr", "b", 9, 1, 0.5, None),
        (4, f"{line}\nfour {passage}\nend", "en", "b", 9, 1, 0.5, None),
        (5, f"  {line.upper()} \nfive {passage}", "en", "b", 9, 1, 0.5, None),
        (6, f"{line}\n{line}\nsix é日本 🙂 [INST] \\ </s>", "de", "b", 9, 1, 0.5, None),
        (7, "the same words in two rows of one id", "en", "c", 9, 1, 0.5, None),
        (7, "the same words in two rows of one id", "en", "c", 9, 1, 0.5, None),
        (7, "another text of the id that repeats", "en", "c", 9, 1, 0.5, None),
        (8, "the SAME words in two rows of one id", "en", "c", 9, 1, 0.5, None),
        (9, "x", "en", "c", 1, 1, 0.5, None),
        (10, "ab" * 150_000, "en", "c", 1, 1, 0.5, None),
        (11, ("long words here " * 9000) + "<|endoftext|> end", "es", "d", 1, 1, 0.5, None),
        (12, f"before {passage} after", "en", "d", 1, 1, 0.5, None),
        (-3, "negative id " * 20, "es", "d", 1, 1, 0.5, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus(duck):
    """(doc_id, text) of all documents."""
    return duck.execute("SELECT doc_id, text FROM documents").fetchall()

