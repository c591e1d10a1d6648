import os

from pyspark.sql import functions as F

from mnemo.plans import flows
from mnemo.session import scratch_path
from mnemo.sources import derived as D

SF = "/root/testdata/sf0.001"


def test_memorization_report_writes_reports(spark):
    out = scratch_path(spark, "run")
    res = flows.memorization_report(D.items_ordered(spark, SF), D.interactions(spark, SF), D.title_responses(spark, SF),
                                    out, "org/model-a", users=D.users(spark, SF), user_responses=D.user_responses(spark, SF))
    path = out.replace("file:", "")
    assert os.path.isfile(f"{path}/analysis_summary_org_model-a.txt")
    assert not [x for x in os.listdir(path) if ".parts-" in x]
    lines = [r.value for r in spark.read.text(f"{out}/Popularity_analysis_summary_org_model-a.txt").collect()]
    assert lines[0].startswith("Coverage at 1th popularity percentile: ") and lines[-1].startswith("Total Coverage: ")
    assert res["ledger"].count() == D.items(spark, SF).count()


def test_tier_probe_and_recommendation_flow(spark):
    out = scratch_path(spark, "run")
    inter = D.interactions(spark, SF)
    tp = flows.tier_probe(inter, D.interaction_responses(spark, SF), out, "org/model-a")
    assert {r.tier for r in tp["sampled"].collect()} <= {"top", "middle", "bottom"}
    from mnemo.operators.split import train_test_split
    sp = train_test_split(inter)
    ev = flows.recommendation_evaluation(sp.filter(F.col("split") == "train"), sp.filter(F.col("split") == "test"),
                                         D.items(spark, SF), D.rec_responses(spark, SF), out, "org/model-a")
    m = ev["metrics_exact"].orderBy("k").collect()
    assert [r.k for r in m] == [1, 3, 5, 10, 20, 50]
    assert all(a.hr <= b.hr for a, b in zip(m, m[1:]))       # HR@K non-decreasing in K


def test_stream_rerun_is_idempotent(spark):
    from mnemo.operators import scoring
    from mnemo.sources import ledger as L
    from mnemo.streaming.ledger_stream import score_stream
    src, led, ck = scratch_path(spark, "resp"), scratch_path(spark, "ledger"), scratch_path(spark, "ck")
    items = D.items_ordered(spark, SF)
    resp = D.title_responses(spark, SF)
    resp.filter(F.col("MovieID") % 2 == 0).write.parquet(src + "/part1")

    def score(b):
        return scoring.score_titles(items.join(b.select("MovieID"), "MovieID", "left_semi"), b).drop("ItemPos")

    run = lambda: score_stream(spark, src + "/*", "MovieID LONG, output STRING", score, led, ck, "MovieID", "m")
    run()
    first = L.read(spark, led).count()
    run()                                              # nothing new: ledger unchanged
    assert L.read(spark, led).count() == first
    resp.filter(F.col("MovieID") % 2 == 1).write.parquet(src + "/part2")
    run()                                              # only the new file is scored
    assert L.read(spark, led).count() == items.count()
    assert L.read(spark, led).select("MovieID").distinct().count() == items.count()


def test_hold_out_and_offline_evaluation_from_files(spark):
    from mnemo.sources import files as FS
    out = scratch_path(spark, "run")
    inter = D.interactions(spark, SF)
    train, test = flows.hold_out(inter, out)
    assert train.count() + test.count() == inter.count()
    items = D.items(spark, SF)
    FS.write_csv(items, f"{out}/movies.csv")
    FS.write_tsv(test.select("UserID", "MovieID", F.lit("1").alias("Interact")), f"{out}/test_nohdr.tsv", header=False)
    ev = flows.recommendation_evaluation(train, test, items, D.rec_responses(spark, SF), out, "org/model-a")
    saved = flows.evaluate_saved(f"{out}/org_model-a_recommendations.tsv", f"{out}/test_nohdr.tsv", f"{out}/movies.csv",
                                 similarity_threshold=1)
    a = {r.k: (r.hr, r.ndcg, r.mrr, r.n_users) for r in ev["metrics_exact"].collect()}
    b = {r.k: (r.hr, r.ndcg, r.mrr, r.n_users) for r in saved["metrics"].collect()}
    assert a == b
