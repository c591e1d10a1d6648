"""Activity and popularity aggregates, activity tiers and seeded user sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.operators.positions import global_index

TIERS = ("top", "middle", "bottom")


def user_activity(interactions: DataFrame) -> DataFrame:
    """(UserID, InteractionCount): distinct items per user (nulls ignored)."""
    return interactions.groupBy("UserID").agg(F.count_distinct("MovieID").alias("InteractionCount"))


def item_popularity(interactions: DataFrame) -> DataFrame:
    """(MovieID, PopularityScore, PopRank): distinct users per item, ranked by score
    descending then MovieID ascending (the reference leaves ties unordered)."""
    pop = interactions.groupBy("MovieID").agg(F.count_distinct("UserID").alias("PopularityScore"))
    return global_index(pop, [F.col("PopularityScore").desc(), F.col("MovieID").asc()], "PopRank", start=1)


def user_tiers(interactions: DataFrame, top_share: float = 0.2, bottom_share: float = 0.8) -> DataFrame:
    """(UserID, InteractionCount, ActivityRank, tier): top 20 %, middle 60 %, bottom 20 %
    of users by distinct items (ties: UserID ascending). Boundaries int(0.2 N), int(0.8 N)."""
    act = user_activity(interactions)
    ranked = global_index(act, [F.col("InteractionCount").desc(), F.col("UserID").asc()], "ActivityRank")
    n = ranked.count()
    top_idx, bottom_idx = int(top_share * n), int(bottom_share * n)
    tier = (F.when(F.col("ActivityRank") < top_idx, F.lit("top"))
            .when(F.col("ActivityRank") < bottom_idx, F.lit("middle"))
            .otherwise(F.lit("bottom")))
    return ranked.withColumn("tier", tier)


def sample_order(user_col: str = "UserID", seed: int = 42):
    """Seeded pseudo-random order: md5 of '<id>:<seed>', ties by id. md5 is the same
    in every SQL engine, so the sample can be checked exactly."""
    return F.md5(F.concat(F.col(user_col).cast("string"), F.lit(f":{seed}")))


def sample_users(tiers: DataFrame, n_per_group: int = 50, seed: int = 42) -> DataFrame:
    """(tier, UserID): min(n, tier size) users per tier. row_number() <= n lets Spark
    keep only the first n per tier in every partition before the shuffle."""
    from pyspark.sql import Window
    w = Window.partitionBy("tier").orderBy(sample_order("UserID", seed), F.col("UserID"))
    return (tiers.select("tier", "UserID").withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") <= n_per_group).drop("_rn"))


def users_first_seen(interactions: DataFrame) -> DataFrame:
    """(UserID, FirstRowIndex, UserOrder): users in order of first appearance."""
    first = interactions.groupBy("UserID").agg(F.min("RowIndex").alias("FirstRowIndex"))
    return global_index(first, ["FirstRowIndex"], "UserOrder")


def group_filter(interactions: DataFrame, users: DataFrame) -> DataFrame:
    """Rows of the sampled users only (semi join, membership)."""
    return interactions.join(users.select("UserID").distinct(), "UserID", "left_semi")
