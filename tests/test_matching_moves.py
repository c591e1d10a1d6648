"""F6 of round 3: rows of lists move to their user once, as numbers; results against plain Python."""
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from mnemo.functions.similarity import indel_ratio_py
from mnemo.operators import recommend as RC
from mnemo.session import materialize

PRESETS = {"inline": RC.INLINE, "evaluator": RC.EVALUATOR, "exact": RC.EVALUATOR_EXACT}
TITLES = ["Red Widget (1990)", "red widget (1991)", "Red Widgets", "Blue Bolt Brand#12 (2000)", "Blue Bolt Brand#13 (2000)", "blue bolt brand 12",
          "Small Ring", "Smal Rings", "Hot Plate", "Cold Plate", "(1999)", "!!", "Ünïcödé Ring", "A very long title of many words, part 1", "A very long title of many words, part 2"]


def rows(spark):
    rnd = random.Random(6)
    user = lambda: rnd.choice([None, 0, 0, 0, *range(1, 12)])
    title = lambda: rnd.choice([None, *TITLES])
    recs = [(user(), i % 50, rnd.randint(1, 60), title()) for i in range(400)]
    recs += recs[:40]  # the same rows again
    tests = [(user() if i < 150 else 20 + i, rnd.randint(1, 9), i, title()) for i in range(160)]
    tests += tests[:20]
    return (recs, tests, spark.createDataFrame(recs, "UserID long, line_no long, Rank long, Title string"),
            spark.createDataFrame(tests, "UserID long, MovieID long, RowIndex long, Title string"))


def norms(spark, preset):
    df = spark.createDataFrame([(t,) for t in TITLES], "Title string").select("Title", preset.normalizer(F.col("Title")).alias("norm"))
    return {None: None, **{r.Title: r.norm for r in df.collect()}}


def matched(recs, tests, norm, preset):
    own = defaultdict(set)
    for u, _, _, t in tests:
        if u is not None and t is not None:
            own[u].add(norm[t])
    return [int(u is not None and t is not None and any(norm[t] == x or indel_ratio_py(norm[t], x) >= preset.threshold for x in own[u]))
            for u, _, _, t in recs]


@pytest.mark.parametrize("name", PRESETS)
def test_matches_and_metrics_of_repeated_and_null_rows(spark, name):
    preset = PRESETS[name]
    recs, tests, r, t = rows(spark)
    norm = norms(spark, preset)
    flags = matched(recs, tests, norm, preset)
    got = RC.match_recs(r, t, preset)
    assert got.columns == ["UserID", "rec_norm", "Title", "line_no", "Rank", "match"]
    assert Counter(map(tuple, got.collect())) == Counter((u, norm[x], x, at, k, m) for (u, at, k, x), m in zip(recs, flags))

    population = {u for u, *_ in recs} if preset.population == "responded" else {u for u, *_ in recs} & {u for u, *_ in tests} - {None}
    n_test = Counter(u for u, *_ in tests)
    out = {x.k: x for x in RC.ranking_metrics(r, t, r.select("UserID"), preset, digits=None).collect()}
    for k in RC.CUTOFFS:
        ranks = defaultdict(list)
        for (u, _, rank, _), m in zip(recs, flags):
            if m and rank <= k:
                ranks[u].append(rank)
        ideal = {u: sum(1 / math.log2(i + 1) for i in range(1, min(n_test[u], k) + 1)) if u is not None else 0 for u in population}
        mean = lambda f: sum(f(u) for u in population) / len(population)
        assert out[k].n_users == len(population)
        assert math.isclose(out[k].hr, mean(lambda u: u in ranks), abs_tol=1e-9)
        assert math.isclose(out[k].mrr, mean(lambda u: 1 / min(ranks[u]) if u in ranks else 0), abs_tol=1e-9)
        assert math.isclose(out[k].ndcg, mean(lambda u: sum(1 / math.log2(x + 1) for x in ranks[u]) / ideal[u] if ideal[u] and u in ranks else 0), abs_tol=1e-9)


@pytest.mark.parametrize("name", PRESETS)
def test_metrics_move_titles_once(spark, name):
    _, _, r, t = rows(spark)
    r, t = materialize(r), materialize(t)
    out = RC.ranking_metrics(r, t, r.select("UserID"), PRESETS[name])._jdf.queryExecution()
    todo = out.executedPlan().toString()
    scans = [x for x in todo.splitlines() if "FileScan" in x and "Rank:" in x and "Title:" in x]
    assert len(scans) <= (name == "exact")  # below 100 the pairs are kept before, and hold no title
    assert "regexp_replace" not in todo  # titles are normalised once, before


def test_the_kernel_runs_on_distinct_pairs_in_a_set_number_of_tasks(spark):
    _, _, r, t = rows(spark)
    todo = RC.ranking_metrics(r, t, r.select("UserID"), RC.EVALUATOR)._jdf.queryExecution().executedPlan().toString()
    kernel, dealt = todo.index("ArrowEvalPython"), todo.index("RoundRobinPartitioning")
    assert kernel < dealt  # a plan reads from its end
    assert todo.count("ArrowEvalPython") == 1
