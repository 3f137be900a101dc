import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, block int, h long, n long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, long, repeated and tied rows, near copies, and columns named like those operators make."""
    base = " ".join(f"word{i}" for i in range(60))
    texts = [
        (1, None), (2, ""), (3, " \t\n"), (4, base), (5, base), (5, base), (6, base + " more"), (7, "a b c"), (8, "A b  c"),
        (9, "x" * 300), (10, base.replace("word7 ", "WORD7 ")), (11, "é中\U0001f600 <|endoftext|> a@b.co 1.2.3.4"),
        (12, "ab " * 4000), (13, "\n".join(f"line {i % 7} of many" for i in range(40))), (None, "no id at all"),
    ]
    rows = [(i, t, "en", None if i == 7 else f"s{(i or 0) % 2}", 0, 1, 2, 3) for i, t in texts]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
