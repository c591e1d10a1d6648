from pyspark.sql import functions as F

from mnemo.operators.activity import user_tiers
from mnemo.operators.split import train_test_split


def sizes(spark, n_by_user, ratio):
    rows, k = [], 0
    for u, n in n_by_user.items():
        for _ in range(n):
            rows.append((u, k, k))
            k += 1
    df = spark.createDataFrame(rows, "UserID long, MovieID long, RowIndex long")
    out = train_test_split(df, ratio).groupBy("UserID").agg(
        F.sum(F.when(F.col("split") == "train", 1).otherwise(0)).alias("tr"),
        F.sum(F.when(F.col("split") == "test", 1).otherwise(0)).alias("te"))
    return {r.UserID: (r.tr, r.te) for r in out.collect()}


def test_holdout(spark):
    assert sizes(spark, {1: 1, 2: 2, 3: 5, 4: 6}, 0.8) == {1: (1, 0), 2: (1, 1), 3: (4, 1), 4: (4, 2)}
    assert sizes(spark, {1: 2}, 0.1) == {1: (1, 1)}


def test_split_is_partition_and_ordered(spark):
    rows = [(u, i, u * 100 + i) for u in range(5) for i in range(u * 3 + 1)]
    df = spark.createDataFrame(rows, "UserID long, MovieID long, RowIndex long")
    out = train_test_split(df, 0.8).collect()
    assert sorted((r.UserID, r.MovieID) for r in out) == sorted((u, m) for u, m, _ in rows)
    for u in range(5):
        mine = sorted((r.RowIndex, r.split) for r in out if r.UserID == u)
        seen_test = False
        for _, s in mine:
            seen_test |= s == "test"
            assert not (seen_test and s == "train")


def test_tiers(spark):
    rows = [(u, m) for u in range(7) for m in range(u + 1)]
    df = spark.createDataFrame(rows, "UserID long, MovieID long")
    got = {r.tier: 0 for r in []}
    for r in user_tiers(df).collect():
        got[r.tier] = got.get(r.tier, 0) + 1
    assert got == {"top": 1, "middle": 4, "bottom": 2}
