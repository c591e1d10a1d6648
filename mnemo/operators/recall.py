"""Per-user recall and hit ratio over interaction-probe results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.functions.text import split_record


def recall_macro(results: DataFrame) -> DataFrame:
    """(recall, n_users): per user, correct / non-null flags; unweighted mean over users.
    The user is the text before the first '::' of RealInteraction."""
    per_user = (results.groupBy(split_record("RealInteraction", 0).alias("UserID"))
                .agg(F.count("ErrorFlag").alias("total"),
                     F.sum(F.when(F.col("ErrorFlag") == 0, 1).otherwise(0)).alias("correct")))
    per_user = per_user.withColumn("recall", F.try_divide(F.col("correct").cast("double"), F.col("total").cast("double")))
    return per_user.agg(F.round(F.avg("recall"), 6).alias("recall"), F.count(F.lit(1)).alias("n_users"))


def hit_ratio(results: DataFrame, top_k: int = 10, as_array: bool = False) -> DataFrame:
    """(mean_hit_ratio, binary_hit_count, n_users).

    A user has a hit when the true item id is among the first ``top_k`` generated
    ids (array input) or, as the reference does after a CSV round trip, is a
    substring of the first ``top_k`` characters of the generated text.
    """
    true_id = split_record("RealInteraction", 1)
    gen = F.col("GeneratedInteraction")
    if as_array:
        ids = F.split(split_record("GeneratedInteraction", 1), ",")
        hit = F.array_contains(F.slice(ids, 1, top_k), true_id)
    else:
        hit = F.substring(gen, 1, top_k).contains(true_id)
    per_user = (results.groupBy(split_record("RealInteraction", 0).alias("UserID"))
                .agg(F.max(F.when(hit, 1).otherwise(0)).alias("binary_hit")))
    return per_user.agg(F.round(F.avg("binary_hit"), 6).alias("mean_hit_ratio"),
                        F.sum("binary_hit").cast("long").alias("binary_hit_count"),
                        F.count(F.lit(1)).alias("n_users"))
