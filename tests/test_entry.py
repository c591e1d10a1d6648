import os, sys
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import __spark_entry__ as E  # noqa: E402


def test_contract_keys():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    from mnemo.plans import catalog
    assert set(catalog.queries()) <= set(q)  # the optional corpus operators only add to these


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 9 and rows
    assert df.columns == ["ord", "first_item", "last_item", "errors", "correct", "size", "coverage", "line"]


def test_plan_prunes_and_avoids_row_udfs(spark):
    from conftest import SF001
    from mnemo.operators import scoring
    from mnemo.sources import derived as D
    scored = scoring.score_titles(D.items_ordered(spark, SF001), D.title_responses(spark, SF001))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan
    assert "ArrowEvalPython" in plan
    plan2 = E.queries()["item_popularity"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan2


def test_oracle_smoke(spark):
    from conftest import SF001
    from oracle_check import compare, duck
    con = duck(SF001)
    names = ["coverage_popularity", "score_interactions", "metrics_exact", "prompts_title", "train_test_split",
             "buckets_counts", "parse_ranked_list", "user_tiers"]
    for n in names:
        r = compare(spark, n, E.queries()[n], E.oracle_sql()[n], SF001, con)
        assert r["ok"], r
