import pytest

LONG = "wordy text goes on " * 20_000


@pytest.fixture
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns with names the operators use themselves."""
    rows = [
        (0, "the cat sat on the mat and the dog sat on the log", "en", "a"), (1, None, "en", "a"), (2, "", None, "b"), (3, "der hund und die katze sind nicht hier", "de", None),
        (3, "der hund und die katze sind nicht hier", "de", None), (4, LONG, "en", "a"), (None, "no id here at all", None, None), (5, "   \n\t ", "en", "b"), (6, "123 456", "en", "b"), (7, "Ünïcödé ß ﬁ 日本語 \U0001f600", None, "b"),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return d.selectExpr("*", "1 as t", "2 as k", "3 as x", "4 as d", "5 as n", "6 as size", "7 as h", "8 as id", "'q' as target", "0 as n_chars")
