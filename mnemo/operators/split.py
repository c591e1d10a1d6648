"""Ordered per-user hold-out split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.operators.positions import index_within_group


def train_test_split(interactions: DataFrame, train_ratio: float = 0.8, order_col: str = "RowIndex") -> DataFrame:
    """Adds ``UserPos`` and ``split`` ('train'/'test').

    Per user in row order: fewer than two rows -> all train; otherwise the first
    max(1, floor(ratio * n)) rows train and the rest test. The position inside a
    user is two-level (bounded buckets), so a very active user is not one task, and comes
    with the user's number of rows out of the same shuffle.
    """
    pos = index_within_group(interactions, ["UserID"], order_col, "UserPos", size_col="_n")
    n = F.col("_n")
    cut = F.when(n < 2, n).otherwise(F.greatest(F.lit(1).cast("long"), F.floor(F.lit(float(train_ratio)) * n).cast("long")))
    return pos.withColumn("split", F.when(F.col("UserPos") < cut, F.lit("train")).otherwise(F.lit("test"))).drop("_n")


def split_sizes(split: DataFrame) -> DataFrame:
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
