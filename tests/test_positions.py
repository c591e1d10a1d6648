import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemo.operators.positions import global_index, index_within_group, prefix_sum


def test_global_index_equals_plain_window(spark):
    rnd = random.Random(1)
    rows = [(rnd.randint(0, 5), rnd.random(), i) for i in range(2000)]   # a hot leading key
    df = spark.createDataFrame(rows, "a int, b double, id long")
    got = global_index(df, [F.col("a").desc(), "b", "id"], "ix")
    ref = df.withColumn("rx", F.row_number().over(Window.orderBy(F.col("a").desc(), "b", "id")) - 1)
    j = got.join(ref, "id")
    assert j.filter(F.col("ix") != F.col("rx")).count() == 0
    assert got.count() == 2000


def test_prefix_sum_grouped_with_hot_group(spark):
    rnd = random.Random(2)
    rows = [(0 if i % 3 else rnd.randint(1, 20), i, rnd.randint(0, 1)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, o long, v int")
    got = prefix_sum(df, "v", "o", "cs", ["g"], bucket=64).collect()
    acc = {}
    expect = {}
    for g, o, v in sorted(rows, key=lambda r: r[1]):
        acc[g] = acc.get(g, 0) + v
        expect[o] = acc[g]
    assert all(r.cs == expect[r.o] for r in got)


def test_index_within_group(spark):
    rows = [(i % 4, i * 7) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, o long")
    got = index_within_group(df, ["g"], "o", "pos", bucket=16).collect()
    for r in got:
        assert r.pos == (r.o // 7) // 4


def test_index_beside_a_column_of_the_scans_name(spark):
    from mnemo.operators.positions import global_index
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("id"), F.lit("own").alias("_metadata"))
    got = global_index(df, ["id"], "at", start=5, num_partitions=7)
    assert got.columns == ["id", "_metadata", "at"]
    assert [tuple(r) for r in got.orderBy("at").collect()] == [(i, "own", i + 5) for i in range(1000)]
    assert global_index(df.limit(0), ["id"], "at").count() == 0
