import pytest

#: Texts that each operator must take: none, empty, blank, long, odd characters, repeated rows.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word " * 30_000), (5, "Ünïcödé 中文 😀 é\u0301 <|endoftext|> \u200b x"), (6, "same text here"), (7, "same text here"), (7, "same text here"), (None, "no id"), (8, "a")]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", 0.5, True) for i, t in ODD], "doc_id long, text string, lang_pred string, score double, fp boolean")


@pytest.fixture(scope="session")
def no_docs(odd):
    return odd.limit(0)
