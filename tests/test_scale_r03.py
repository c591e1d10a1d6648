"""What round 3 found to grow faster than the input: work that a plan shows, on rows of its own."""
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from mnemo.operators import prompts, recommend
from mnemo.operators.generate import generate
from mnemo.operators.positions import global_index, index_within_group, prefix_sum
from mnemo.operators.split import train_test_split
from mnemo.session import cpu_partitions, materialize


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_kept_table_is_read_by_columns(spark):
    kept = materialize(spark.range(100).select("id", F.lit("text").alias("t")))
    assert "parquet" in plan(kept.select("id")).lower() and "ReadSchema: struct<id:bigint>" in plan(kept.select("id"))
    assert kept.select("id").distinct().count() == 100


def test_the_split_moves_its_rows_once(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice([None, 0, 0, 0, *range(1, 30)]), i % 7, i) for i in range(3000)]
    out = train_test_split(spark.createDataFrame(rows, "UserID int, MovieID int, RowIndex long"), 0.8)
    assert plan(out).count("SortMergeJoin") <= 1  # with what stands before the buckets of large users; sizes need no join
    by_user = defaultdict(list)
    for u, _, i in rows:
        if u is not None:
            by_user[u].append(i)
    want = {(u, i, p, "train" if p < (len(at) if len(at) < 2 else max(1, int(0.8 * len(at)))) else "test")
            for u, at in by_user.items() for p, i in enumerate(sorted(at))}
    assert {(r.UserID, r.RowIndex, r.UserPos, r.split) for r in out.collect()} == want


def test_only_large_groups_are_cut(spark):
    rnd = random.Random(5)
    rows = [(0 if i % 3 else rnd.randint(1, 400), i, rnd.randint(0, 1)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, o long, v int")
    got = prefix_sum(df, "v", "o", "cs", ["g"], bucket=64, size_col="n")
    size, acc = defaultdict(int), defaultdict(int)
    for g, _, _ in rows:
        size[g] += 1
    want = set()
    for g, o, v in rows:
        acc[g] += v
        want.add((g, o, v, size[g], acc[g]))
    assert {tuple(r) for r in got.select("g", "o", "v", "n", "cs").collect()} == want
    pos = index_within_group(df.filter("g = 0"), ["g"], "o", "p", bucket=64).orderBy("o").collect()
    assert [r.p for r in pos] == list(range(2000))


def test_an_order_keeps_the_columns_asked_for(spark):
    df = spark.range(50).select("id", (49 - F.col("id")).alias("k"), F.lit("x").alias("unread"))
    got = global_index(df, ["k"], "at", keep=["id"])
    assert got.columns == ["id", "at"]
    assert [r.at for r in got.orderBy("id").collect()] == list(range(49, -1, -1))


def test_histories_of_small_and_large_users(spark):
    rows = [(u, i * 5 + u, f"T{u}-{i}") for u, n in ((1, 1), (2, 4), (3, 23)) for i in range(n)] + [(2, None, "first"), (3, 999, None), (None, 3, "no one")]
    df = spark.createDataFrame(rows, "UserID int, RowIndex long, Title string")
    got = {r.UserID: (r.n_titles, r.history) for r in recommend.user_histories(df, chunk=5).collect()}
    assert got == {1: (1, "T1-0"), 2: (5, ", ".join(["first", *(f"T2-{i}" for i in range(4))])),
                   3: (24, ", ".join(f"T3-{i}" for i in range(23)))}
    assert "isnull(_large" in plan(recommend.user_histories(df))  # small users' titles go through no global order


def test_answers_are_parsed_by_a_set_number_of_tasks(spark):
    answers = spark.range(400).select(F.col("id").alias("UserID"), F.lit("1. Heat").alias("output"))
    came = recommend.answered_users(answers, answers.select("UserID"))
    assert came.rdd.getNumPartitions() >= cpu_partitions(spark)


def test_lines_of_white_space_and_digits(spark):
    text = "  1.  Heat \x1f\r\n2.\n3.   \n 4 . no\nx5. no\n٦. no\n007.Up　\n12.3. Go\n99999999999999999999. far\n0. none"
    got = recommend.parse_ranked_lines(spark.createDataFrame([(1, text), (2, None)], "UserID int, output string")).orderBy("line_no").collect()
    assert [(r.line_no, r.Rank, r.Title, r.ok) for r in got] == [
        (0, 1, "Heat", True), (6, 7, "Up", True), (7, 12, "3. Go", True), (8, None, "far", False), (9, 0, "none", False)]


def test_prompts_become_python_objects_a_call_at_a_time(spark):
    rows = spark.range(40).select(F.col("id").alias("key"), F.array(F.struct(
        F.lit("user").alias("role"), F.col("id").cast("string").alias("content"))).alias("messages"))
    out = generate(rows, lambda batch: [f"{len(batch)}:{m[-1]['content']}" for m in batch], call_size=7, max_attempts=1)
    assert "MapInArrow" in plan(out)
    assert {r.key for r in out.collect() if r.status == "ok" and r.output.endswith(f":{r.key}") and int(r.output.split(":")[0]) <= 7} == set(range(40))


def test_messages_are_made_before_they_are_collected(spark):
    rows = spark.createDataFrame([(i, i, 0, f"q{i}", f"a{i}") for i in range(7)], "key long, pos long, flag int, user_msg string, asst_msg string")
    p = prompts.build_prompts(rows, "s", batch_size=3)
    got = {r.key: [m.content for m in r.messages] for r in p.collect()}
    assert got[1][-3:] == ["q0", "a0", "q1"] and got[5][-5:] == ["q3", "a3", "q4", "a4", "q5"] and got[6][-1] == "q6"
    logical = p._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(_pair" in logical


def test_pair_counts_keep_what_a_worker_has_learnt():
    import inspect
    from mnemo.llm import alignment
    counted = inspect.getsource(alignment.Alignment.pair_counts)
    assert counted.count("own.forget()") == 1  # where the bound is reached, not at each task
    assert np.repeat(np.zeros(0, np.int64), np.zeros(0, np.int64)).size == 0
