import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, component_id string, items string, n_words string, kept string, verdict string, _id string, _hash string, _gone string, _keep_id string, _keep_null string, _keep_hash string, _lines string, _t string, _w string, _c string, _h string, _k1 string, _k2 string, row string, keys string, dropped string, text_hash string"


def row(doc_id, text, lang="en"):
    """A document with further columns whose names clash with those that operators write."""
    return (doc_id, text, lang, "s", len(text or ""), 9.0, "fp", "c", "i", "n", "k", "v", *"abcdefghijklmnopq")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empties, one very long text, ties, repeated rows."""
    long = " ".join(f"word{k % 977} of the run" for k in range(40_000))
    rows = [row(1, "the cat sat on the mat and it was a good day for all of them"), row(1, "the cat sat on the mat and it was a good day for all of them"), row(2, None), row(3, ""), row(4, "  \n\t\n "),
            row(None, "the cat sat on the mat and it was a good day for all of them"), row(None, None, None), row(5, long), row(6, "ß漢字 ñandú É\n\nÉ"), row(7, "short")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
