"""Failures, resume, duplicates and file layouts that the derived tables don't have."""
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF001 as SF
from mnemo.functions.similarity import lcs_batch, lcs_length
from mnemo.operators import coverage, prompts, recommend, scoring
from mnemo.operators.generate import PermanentError, generate
from mnemo.plans import flows
from mnemo.session import scratch_path
from mnemo.sources import derived as D
from mnemo.sources import files, ledger
from mnemo.streaming.ledger_stream import score_stream


def responder_that_fails_on_sevens():
    def fails_on_sevens(batch):
        out = []
        for msgs in batch:
            n = int(msgs[-1]["content"])
            if n % 7 == 0:
                raise PermanentError("no") if n % 2 else RuntimeError("maybe")
            out.append(f"answer {n}")
        return out
    return fails_on_sevens


@pytest.mark.parametrize("size", [1, 10_000])
def test_a_bad_prompt_loses_only_its_answer(spark, size):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        rows = spark.range(40).select(F.col("id").alias("key"), F.array(F.struct(
            F.lit("user").alias("role"), F.col("id").cast("string").alias("content"))).alias("messages"))
        got = {r.key: (r.output, r.status) for r in
               generate(rows, responder_that_fails_on_sevens(), max_attempts=2, backoff_min=0.0, backoff_max=0.0).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {n: (None, "failed") if n % 7 == 0 else (f"answer {n}", "ok") for n in range(40)}


def test_failed_calls_are_in_no_population(spark):
    eligible = spark.createDataFrame([(1,), (2,)], "UserID long")
    answers = spark.createDataFrame([(1, "1. Heat"), (2, None)], "UserID long, output string")
    test = spark.createDataFrame([(1, "Heat"), (2, "Up")], "UserID long, Title string")
    answered = recommend.answered_users(answers, eligible)
    m = recommend.ranking_metrics(recommend.parse_ranked_list(answered)[0], test, answered, recommend.INLINE).first()
    assert (m.hr, m.n_users) == (1.0, 1)


def write(path, name, text):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}", "w") as f:
        f.write(text)


def test_csv_columns_by_name_and_file_order(spark, tmp_path):
    p = str(tmp_path / "items")
    write(p, "a.csv", "Title,Genres,MovieID\n\"Up, and down\",x,3\nHeat,y|z,1\n")
    write(p, "b.csv", "Title,Genres,MovieID\nAlien,x,2\n")
    got = [(r.MovieID, r.Title, r.ItemPos) for r in files.read_items(spark, p, order=True).orderBy("ItemPos").collect()]
    assert got == [(3, "Up, and down", 0), (1, "Heat", 1), (2, "Alien", 2)]
    q = str(tmp_path / "inter")
    write(q, "a.csv", "MovieID,UserID,Rating\n10,1,5\n20,2,4\n")
    assert [tuple(r) for r in files.read_interactions(spark, q, order=True).orderBy("RowIndex").collect()] == [(1, 10, 0), (2, 20, 1)]
    u = str(tmp_path / "users")
    write(u, "a.csv", "UserID,Gender,Age,Occupation,Zip-code\n1,F,25,3,02115\n")
    assert tuple(files.read_users(spark, u).first()) == (1, "F", 25, 3, "02115")
    with pytest.raises(ValueError, match="Title"):
        files.read_items(spark, q)
    write(q, "b.csv", "UserID,MovieID,Rating\n1,1,1\n")
    with pytest.raises(Exception):  # noqa: B017 - another header in the second file
        files.read_interactions(spark, q).collect()


def test_report_from_csv_files(spark, tmp_path):
    p, q = str(tmp_path / "movies"), str(tmp_path / "ratings")
    write(p, "a.csv", "MovieID,Title,Genres\n1,Heat,x\n2,Up,y\n3,Alien,z\n")
    write(q, "a.csv", "UserID,MovieID,Rating,Timestamp\n1,1,5,0\n1,2,5,0\n2,2,4,0\n")
    answers = spark.createDataFrame([(1, "Heat"), (2, "Down"), (3, "Alien")], "MovieID long, output string")
    out = scratch_path(spark, "run")
    for _ in range(2):  # the second run adds nothing
        got = flows.memorization_report(files.read_items(spark, p, order=True), files.read_interactions(spark, q, order=True),
                                        answers, out, "org/m")
        assert got["ledger"].count() == 3
    lines = files.read_report(spark, f"{out}/analysis_summary_org_m.txt").orderBy("ord").collect()
    assert lines[-1].line.startswith("Total Coverage: 66.67%") and [r.ord for r in lines] == list(range(1, len(lines) + 1))


def test_long_reports_keep_their_order(spark):
    rep = spark.range(5000).select(F.col("id").alias("ord"), F.concat(F.lit("line "), F.col("id").cast("string")).alias("line"))
    path = scratch_path(spark, "report")
    files.write_report(rep.repartition(7), path)
    got = files.read_report(spark, path).orderBy("ord").collect()
    assert [(r.ord, r.line) for r in got] == [(i + 1, f"line {i}") for i in range(5000)]
    name = path.removeprefix("file:")
    assert open(name).read() == "".join(f"line {i}\n" for i in range(5000))
    files.write_report(rep.where("ord < 3"), path)  # written again: one file, the new lines
    assert open(name).read() == "line 0\nline 1\nline 2\n"
    files.write_report(rep.where("false"), path)
    assert open(name).read() == ""


def test_raw_lines_without_kept_columns(spark, tmp_path):
    write(str(tmp_path / "raw"), "a.dat", "1::a\n2::b::c::d::e\n3\n")
    got, rejects = files.ingest_delimited(spark, str(tmp_path / "raw"), ["id", "x", "y"])
    assert sorted(map(tuple, got.collect())) == [("1", "a", None, None), ("2", "b", "c", "d::e"), ("3", None, None, None)]
    assert rejects.count() == 0
    files.write_csv(got, scratch_path(spark, "csv"))


def test_last_duplicate_title(spark):
    items = spark.createDataFrame([(1, "Zed", 0), (1, "Alpha", 1)], "MovieID long, Title string, ItemPos long")
    keys = spark.createDataFrame([(1,), (2,)], "MovieID long")
    assert {r.MovieID: r.RealTitle for r in scoring.title_lookup(keys, items, "ItemPos").collect()} == {1: "Alpha", 2: "Unknown"}


def test_stream_takes_a_key_once(spark):
    src, path = scratch_path(spark, "in"), scratch_path(spark, "ledger")
    for output in ("b", "a"):
        spark.createDataFrame([(1, output)], "k long, output string").coalesce(1).write.mode("append").parquet(src)
    args = (spark, src, "k long, output string", lambda df: df, path)
    score_stream(*args, scratch_path(spark, "c1"), "k", "m")
    score_stream(*args, scratch_path(spark, "c2"), "k", "m")
    assert [(r.k, r.output) for r in ledger.read(spark, path).collect()] == [(1, "a")]


def test_cuts_between_ranks(spark):
    ranked = spark.createDataFrame([(1, 1), (3, 1), (200, 1)], "rank long, ErrorFlag int")
    few = {r.cut: r.errors for r in coverage.errors_at(ranked, [2, 3, 199, 500]).collect()}
    many = {r.cut: r.errors for r in coverage.errors_at(ranked, range(1, 600)).collect()}
    assert few == {2: 1, 3: 2, 199: 2, 500: 3} and all(many[c] == n for c, n in few.items()) and len(many) == 599


def test_resumed_examples(spark):
    rows = spark.createDataFrame([(i, i, 1, f"u{i}", f"a{i}") for i in range(100, 220)],
                                 "key long, pos long, flag int, user_msg string, asst_msg string")
    seed = spark.createDataFrame([(i, f"u{i}", f"a{i}") for i in (97, 98, 99)], "pos long, user_msg string, asst_msg string")
    got = prompts.fewshot_examples(rows, seed=seed).collect()
    assert sorted((r.batch, r.slot, r.asst_msg) for r in got) == [(b, s + 1, f"a{97 + s}") for b in (2, 3, 4) for s in range(3)]
    plain = prompts.fewshot_examples(rows).collect()  # nothing to go by: the first three rows there are
    assert sorted({(r.slot, r.asst_msg) for r in plain}) == [(1, "a100"), (2, "a101"), (3, "a102")]


def test_positions_of_a_heavy_user(spark):
    from mnemo.operators.positions import position_in_group
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("UserID"), (F.col("id") * 11).alias("RowIndex"))
    got = position_in_group(rows, ["UserID"], "RowIndex", "p").where("UserID = 7").orderBy("RowIndex").collect()
    assert [r.p for r in got] == list(range(1001))


def test_names_and_configuration():
    assert flows.model_name({"model_type": "hf", "model_name": "a/b"}) == "a_b"
    assert flows.model_name({"model_type": "foundry", "foundry_model_name": "c/d", "model_name": "x"}) == "c_d"
    assert flows.model_name({"model_type": "openai", "deployment_name": "e/f"}) == "e/f"
    assert flows.model_name({}) == "unknown"
    good = {"dataset_name": "d", "model_type": "hf", "model_name": "m", "batch_size": 50, "hf_key": "k"}
    flows.check_config(good)
    with pytest.raises(KeyError):
        flows.check_config({k: v for k, v in good.items() if k != "hf_key"})
    with pytest.raises(ValueError):
        flows.check_config(good | {"model_type": "other"})


def test_long_pair_among_short_ones():
    a = ["abc def"] * 50 + ["x" * 3000]
    b = ["abc dxf"] * 50 + ["xy" * 1500]
    assert lcs_batch(a, b).tolist() == [lcs_length(x, y) for x, y in zip(a, b)]


def test_log_numbers_absent_items_without_one_task(spark):
    from mnemo.plans import catalog
    plan = catalog.queries()["evaluation_log"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window" in x and "norm_title" in x]
    assert not windows


def test_similarity_in_sql(spark):
    from mnemo.functions.similarity import register_functions
    register_functions(spark)
    assert spark.sql("SELECT indel_ratio('abcd', 'abxd') AS r, indel_ratio('a', NULL) AS n").first()[:] == (75.0, None)


def test_total_of_an_empty_table(spark):
    none = spark.createDataFrame([], "rank long, ErrorFlag int")
    got = coverage.coverage_buckets(none, item_counts=[5, 10]).orderBy("ord").collect()
    assert got[-1].errors == 0 and got[-1].size == 0 and got[-1].coverage == 0.0
