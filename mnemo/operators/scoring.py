"""Scoring model answers against the truth (ErrorFlag 0 = correct).

Answers come either from a response table joined on the probe key (replay, the
checkable path) or from :mod:`mnemo.operators.generate`. The thresholds differ
per probe, as in the reference.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.functions.similarity import similarity_flag
from mnemo.functions.text import (ERROR_TEXT, TITLE_ERROR_TEXT, UNKNOWN_TITLE, record_string,
                                  response_text)


@dataclass(frozen=True)
class Rule:
    threshold: float
    strict: bool  # '>' when True, '>=' otherwise


# Per-probe similarity thresholds on the rounded similarity.
TITLE_RULE = Rule(80, True)
INTERACTION_RULE = Rule(80, True)
USER_INTERACTION_RULE = Rule(90, True)
USER_ATTRIBUTE_RULE = Rule(90, False)


def title_lookup(keys: DataFrame, items: DataFrame, order_col: str) -> DataFrame:
    """keys LEFT JOIN items: RealTitle, 'Unknown' when missing; of duplicate ids the last
    row by ``order_col`` (the position in the items file) wins."""
    lookup = items.groupBy("MovieID").agg(F.max_by("Title", order_col).alias("RealTitle"))
    return (keys.join(lookup, "MovieID", "left")
            .withColumn("RealTitle", F.coalesce(F.col("RealTitle"), F.lit(UNKNOWN_TITLE))))


def attach_responses(prompts: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """prompts LEFT JOIN responses on the probe key; a missing row is a failed call."""
    return prompts.join(responses.select(key, "output"), key, "left")


def score_titles(items: DataFrame, responses: DataFrame, rule: Rule = TITLE_RULE) -> DataFrame:
    """(MovieID, GeneratedTitle, RealTitle, ErrorFlag, ItemPos) for every row of ``items``
    (MovieID, Title, ItemPos)."""
    keys = items.select("MovieID", "ItemPos")
    real = title_lookup(keys, items, "ItemPos")
    j = attach_responses(real, responses, "MovieID")
    gen = response_text("output", TITLE_ERROR_TEXT, key="MovieID")
    j = j.withColumn("GeneratedTitle", gen)
    flag = similarity_flag("GeneratedTitle", "RealTitle", rule.threshold, rule.strict)
    return j.select("MovieID", "GeneratedTitle", "RealTitle", flag.alias("ErrorFlag"), "ItemPos")


def score_interactions(interactions: DataFrame, responses: DataFrame,
                       rule: Rule = INTERACTION_RULE) -> DataFrame:
    """(RowIndex, GeneratedInteraction, RealInteraction, ErrorFlag, UserID)."""
    base = interactions.select("RowIndex", "UserID",
                               record_string("UserID", "MovieID").alias("RealInteraction"))
    j = attach_responses(base, responses, "RowIndex")
    j = j.withColumn("GeneratedInteraction", response_text("output", ERROR_TEXT))
    flag = similarity_flag("GeneratedInteraction", "RealInteraction", rule.threshold, rule.strict)
    return j.select("RowIndex", "GeneratedInteraction", "RealInteraction", flag.alias("ErrorFlag"), "UserID")


def score_users(users: DataFrame, responses: DataFrame, rule: Rule = USER_ATTRIBUTE_RULE) -> DataFrame:
    """(RowIndex, GeneratedUser, RealUser, ErrorFlag)."""
    base = users.select("RowIndex", record_string("UserID", "Gender", "Age", "Occupation", "Zip_code").alias("RealUser"))
    j = attach_responses(base, responses, "RowIndex")
    j = j.withColumn("GeneratedUser", response_text("output", ERROR_TEXT))
    flag = similarity_flag("GeneratedUser", "RealUser", rule.threshold, rule.strict)
    return j.select("RowIndex", "GeneratedUser", "RealUser", flag.alias("ErrorFlag"))
