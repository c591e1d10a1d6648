import math

from mnemo.operators import recommend as RC


def test_evaluator_threshold_truncates():
    assert RC.evaluator_threshold(0.57) == 56
    assert RC.evaluator_threshold(0.85) == 85
    assert RC.evaluator_threshold(1) == 100


def _fixture(spark):
    recs = spark.createDataFrame([(1, 0, 1, "Toy Story"), (1, 1, 2, "Toy Story"), (2, 0, 1, "Heat")],
                                 "UserID long, line_no long, Rank long, Title string")
    test = spark.createDataFrame([(1, 10, 0, "Toy Story"), (2, 11, 0, "Alien"), (3, 12, 0, "Heat")],
                                 "UserID long, MovieID long, RowIndex long, Title string")
    responded = spark.createDataFrame([(1,), (2,), (4,)], "UserID long")
    return recs, test, responded


def test_ndcg_above_one(spark):
    recs, test, responded = _fixture(spark)
    m = {r.k: r for r in RC.ranking_metrics(recs, test, responded, RC.EVALUATOR_EXACT, (3,)).collect()}
    assert m[3].n_users == 2                                   # users with recs and tests
    # user 1: HR 1, MRR 1, nDCG (1 + 1/log2(3)) / 1 = 1.63093; user 2: zeros
    assert math.isclose(m[3].hr, 0.5)
    assert math.isclose(m[3].ndcg, round((1 + 1 / math.log2(3)) / 2, 6))
    assert math.isclose(m[3].mrr, 0.5)


def test_populations_differ(spark):
    recs, test, responded = _fixture(spark)
    inline = {r.k: r.n_users for r in RC.ranking_metrics(recs, test, responded, RC.INLINE, (1,)).collect()}
    assert inline[1] == 3          # every answered user, including one with no parsed recs


def test_fuzzy_matches_brute_force(spark):
    from mnemo.functions.similarity import indel_ratio_py
    titles = ["red widget", "red widgets", "blue bolt", "small ring", "smal rings", "hot plate", "cold plate"]
    recs = spark.createDataFrame([(u, i, i + 1, t) for u in range(3) for i, t in enumerate(titles)],
                                 "UserID long, line_no long, Rank long, Title string")
    tests = [(0, "red widget"), (1, "small ring"), (1, "hot plate"), (2, "zzz")]
    test = spark.createDataFrame([(u, 0, 0, t) for u, t in tests], "UserID long, MovieID long, RowIndex long, Title string")
    got = {(r.UserID, r.Rank): r.match for r in RC.match_recs(recs, test, RC.INLINE).collect()}
    for u in range(3):
        for i, t in enumerate(titles):
            want = any(indel_ratio_py(t, tt) >= 80 for uu, tt in tests if uu == u)
            assert got[(u, i + 1)] == int(want), (u, t)


def test_history_in_chunks_keeps_order(spark):
    rows = [(1, i * 3 + 7, f"t{i}") for i in range(11)] + [(2, 5, "only")]
    df = spark.createDataFrame(rows, "UserID long, RowIndex long, Title string")
    got = {r.UserID: (r.n_titles, r.history) for r in RC.user_histories(df, chunk=4).collect()}
    assert got[1] == (11, ", ".join(f"t{i}" for i in range(11)))
    assert got[2] == (1, "only")
