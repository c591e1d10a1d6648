from mnemo.operators import prompts as PR


def rows(spark, flags):
    data = [(i, i, f, f"u{i}", f"a{i}") for i, f in enumerate(flags)]
    return spark.createDataFrame(data, "key long, pos long, flag int, user_msg string, asst_msg string")


def examples(spark, flags, batch=2):
    ex = PR.fewshot_examples(rows(spark, flags), batch_size=batch).collect()
    out = {}
    for r in sorted(ex, key=lambda r: (r.batch, r.slot)):
        out.setdefault(r.batch, []).append(r.asst_msg)
    return out


def test_no_correct_rows_uses_initial_three(spark):
    assert examples(spark, [1, 1, 1, 1, 1, 1]) == {0: ["a0", "a1", "a2"], 1: ["a0", "a1", "a2"], 2: ["a0", "a1", "a2"]}


def test_one_correct_row_is_used_alone_and_frozen(spark):
    # row 1 correct: batch 1 sees only it; batch 2 also sees row 3 (correct, in batch 1)
    assert examples(spark, [1, 0, 1, 0, 1, 1]) == {0: ["a0", "a1", "a2"], 1: ["a1"], 2: ["a1", "a3"]}


def test_last_three_correct(spark):
    ex = examples(spark, [0, 0, 0, 0, 0, 1, 1, 1], batch=4)
    assert ex[1] == ["a1", "a2", "a3"]


def test_transcript_teacher_forced(spark):
    p = PR.build_prompts(rows(spark, [1, 1, 1]), "S {dataset}", batch_size=3, dataset="D").orderBy("pos").collect()
    contents = [[m.content for m in r.messages] for r in p]
    assert contents[0][0] == "S D"
    assert contents[2][-5:] == ["u0", "a0", "u1", "a1", "u2"]


def test_prompt_texts_equal_rendered_messages(spark):
    from pyspark.sql import functions as F
    r = rows(spark, [1, 0, 1, 0, 0, 1, 1, 0, 1, 1, 0])
    a = PR.build_prompts(r, PR.TITLE_SYSTEM, batch_size=4).select("key", F.size("messages").alias("n"), PR.render("messages").alias("t"))
    b = PR.prompt_texts(r, PR.TITLE_SYSTEM, batch_size=4).select("key", F.col("n_messages").alias("n2"), F.col("prompt").alias("t2"))
    j = a.join(b, "key").collect()
    assert len(j) == 11 and all(x.t == x.t2 and x.n == x.n2 for x in j)
