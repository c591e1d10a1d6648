"""Report line rendering. The texts must equal the reference's report files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Report line templates (pieces between the numbers).
PERCENTILE_LINE = ("Coverage at {p}th percentile: ", "% | Errors: ", " | Correct: ", " | Total: ")
POPULARITY_LINE = ("Coverage at {p}th popularity percentile: ", "% | Errors: ", " | Correct: ", " | Total: ")
ITEMS_LINE = ("Coverage at ", " items: ", "% | Errors: ", " | Correct: ", " | Total: ")
TOTAL_LINE = ("Total Coverage: ", "% | Total Errors: ")
TOTAL_ITEMS_SUFFIX = " | Total Items: "
BUCKET_LINE = ("Coverage for items [", "..", "]: ", "% | Errors: ", " | Correct: ", " | Group Size: ")
BUCKET_TOTAL_LINE = ("Total Coverage (all ", " items): ", "% | Total Errors: ")
INVALID_PERCENTILE = "Invalid percentile value: {p}. Must be between 0 and 100."
INVALID_COUNT = "Invalid item count: {c}. Must be between 1 and {n}."
NO_RESULTS = "No results to analyze."
NO_ITEMS = "No items to analyze."


def text(*parts) -> Column:
    """Concatenate literals (str) and columns rendered with Spark's number format,
    which prints doubles like Python (``100.0``, ``33.33``)."""
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.concat(*cols)


def py_number(value) -> str:
    """How Python prints a parameter inside an f-string."""
    return str(value)
