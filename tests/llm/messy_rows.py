"""A table of odd rows that the edge tests share."""
import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size string, copies int, _mix_pos int, "
          "_mix_rows string, ids string, lang_pred string, n_lines string, _lines string, found string, bands int, marks int, score string, _text string")


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), "x", 7, 1, "r", "i", "q", "n", "l", "f", 0, 1, "s", "t")


LONG = " ".join(f"word{i % 997} of{i % 89}" for i in range(20_000))


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns
    whose names the operators use themselves."""
    poem = "one two three four five six\nseven eight nine ten eleven twelve\nthe end of it all is near now"
    rows = [row(1, poem), row(2, poem), row(2, poem), row(3, ""), row(4, None), row(5, LONG, "en", "b"),
            row(6, "   \n\t "), row(7, "été à la plage", "fr", None), row(None, "no id at all", None, "b"),
            row(8, "1234 !!", "en", "c"), row(9, LONG + " tail", None, "b"), row(10, "one", "en", ""),
            (11, *[None] * 17), (None, *[None] * 17)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
