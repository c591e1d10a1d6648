"""Query catalogue: every operator as a (spark, sf_dir) -> DataFrame callable,
paired with DuckDB SQL over the driver's tables where an exact oracle exists."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemo.functions import text as T
from mnemo.operators import activity, coverage, scoring
from mnemo.plans import oracle_sql as Q
from mnemo.session import materialize, staged
from mnemo.sources import derived as D


@dataclass
class Entry:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = Entry(fn, sql)
        return fn
    return deco


# Report parameters used by the reference's driver script.
PERCENTILES = [1, 10, 20, 25, 50, 75, 90, 100]
POP_BUCKETS = [0.2, 0.8]
CURVE_COUNTS = [1, 5, 10, 0, 100000, 50, 20]
BUCKET_COUNTS = [100, 50, 500, 10 ** 9, 1000]
BUCKET_PERCENTILES = [0.1, 0.5, 0.9]
INVALID_PERCENTILES = [-5, 50, 101, 100, 12.5]

# ----------------------------------------------------------------- shared pieces (Spark)


def title_results(spark, sf):
    """The title-probe ledger: scored once per session, read by every report (the
    reference writes it to a results file and re-reads it for each report)."""
    return D._cached(spark, sf, "title_results", lambda: materialize(
        scoring.score_titles(D.items_ordered(spark, sf), D.title_responses(spark, sf))))


def title_ranked(spark, sf):
    return coverage.rank_results(title_results(spark, sf), "ItemPos", dense=True)


def popularity(spark, sf):
    """Item popularity with its rank, computed once and shared by the reports."""
    return D._cached(spark, sf, "popularity", lambda: materialize(activity.item_popularity(D.interactions(spark, sf))))


def popularity_merged(spark, sf):
    """Popularity and outcome, joined once a report: its count and its cuts read the result."""
    return staged(coverage.popularity_merge(title_results(spark, sf), popularity(spark, sf), "ItemPos"), "popularity")


# ----------------------------------------------------------------- shared pieces (SQL)

TITLE_CTES = {
    "title_gen": (("items_ordered", "title_responses"), f"""SELECT io.MovieID, io.ItemPos, io.Title AS RealTitle,
       {Q.response_text('r.output', T.TITLE_ERROR_TEXT, 'io.MovieID')} AS GeneratedTitle
FROM items_ordered io LEFT JOIN title_responses r ON r.MovieID = io.MovieID"""),
    **Q.lcs_ctes("title_lcs", "SELECT GeneratedTitle AS a, RealTitle AS b FROM title_gen"),
    "title_scores": (("title_gen", "title_lcs"), f"""SELECT g.MovieID, g.ItemPos, g.GeneratedTitle, g.RealTitle,
       {Q.sim_expr('g.GeneratedTitle', 'g.RealTitle', 'l.lcs')} AS similarity,
       CASE WHEN {Q.sim_expr('g.GeneratedTitle', 'g.RealTitle', 'l.lcs')} > 80 THEN 0 ELSE 1 END AS ErrorFlag
FROM title_gen g LEFT JOIN title_lcs l ON l.a = g.GeneratedTitle AND l.b = g.RealTitle"""),
    "title_ranked": (("title_scores",), "SELECT ItemPos + 1 AS rank, ErrorFlag FROM title_scores"),
    "pop_merged": (("popularity", "title_scores"), """SELECT p.PopRank AS rank, coalesce(s.ErrorFlag, 1) AS ErrorFlag
FROM popularity p LEFT JOIN title_scores s ON s.MovieID = p.MovieID"""),
}


def sql(body: str, *needs: str, extra: dict | None = None) -> str:
    defs = dict(TITLE_CTES)
    if extra:
        defs.update(extra)
    return Q.build(body, *needs, extra=defs)


def report_sql(src: str, pair) -> str:
    extra, body = pair
    return sql(body, src, *extra.keys(), extra=extra)


# ----------------------------------------------------------------- scoring & popularity


@register("indel_similarity", sql("""SELECT MovieID, GeneratedTitle, RealTitle, similarity FROM title_scores""", "title_scores"))
def q_indel_similarity(spark, sf):
    from mnemo.functions.similarity import similarity
    it = D.items_ordered(spark, sf)
    j = scoring.attach_responses(it.select("MovieID", F.col("Title").alias("RealTitle")), D.title_responses(spark, sf), "MovieID")
    j = j.withColumn("GeneratedTitle", T.response_text("output", T.TITLE_ERROR_TEXT, key="MovieID"))
    return j.select("MovieID", "GeneratedTitle", "RealTitle", similarity("GeneratedTitle", "RealTitle").alias("similarity"))


@register("score_titles", sql("SELECT MovieID, GeneratedTitle, RealTitle, ErrorFlag FROM title_scores", "title_scores"))
def q_score_titles(spark, sf):
    scored = scoring.score_titles(D.items_ordered(spark, sf), D.title_responses(spark, sf))
    return scored.select("MovieID", "GeneratedTitle", "RealTitle", "ErrorFlag")


@register("item_popularity", Q.build("SELECT MovieID, PopularityScore, PopRank FROM popularity", "popularity"))
def q_item_popularity(spark, sf):
    return activity.item_popularity(D.interactions(spark, sf))


@register("user_activity", Q.build("SELECT UserID, InteractionCount FROM activity", "activity"))
def q_user_activity(spark, sf):
    return activity.user_activity(D.interactions(spark, sf))


# ----------------------------------------------------------------- coverage reports


@register("coverage_percentiles", report_sql("title_ranked", Q.percentile_report("title_ranked", PERCENTILES, False)))
def q_coverage_percentiles(spark, sf):
    return coverage.coverage_percentiles(title_ranked(spark, sf), PERCENTILES)


@register("coverage_invalid_params", report_sql("title_ranked", Q.percentile_report("title_ranked", INVALID_PERCENTILES, False)))
def q_coverage_invalid_params(spark, sf):
    return coverage.coverage_percentiles(title_ranked(spark, sf), INVALID_PERCENTILES)


@register("coverage_popularity", report_sql("pop_merged", Q.percentile_report("pop_merged", PERCENTILES, True)))
def q_coverage_popularity(spark, sf):
    return coverage.coverage_popularity(popularity_merged(spark, sf), PERCENTILES)


@register("coverage_curve", report_sql("pop_merged", Q.curve_report("pop_merged")))
def q_coverage_curve(spark, sf):
    return coverage.coverage_curve(popularity_merged(spark, sf))


@register("coverage_curve_counts", report_sql("pop_merged", Q.curve_report("pop_merged", CURVE_COUNTS)))
def q_coverage_curve_counts(spark, sf):
    return coverage.coverage_curve(popularity_merged(spark, sf), CURVE_COUNTS)


@register("buckets_size", report_sql("title_ranked", Q.bucket_report("title_ranked", bucket_size=5)))
def q_buckets_size(spark, sf):
    return coverage.coverage_buckets(title_ranked(spark, sf), bucket_size=5)


@register("buckets_counts", report_sql("title_ranked", Q.bucket_report("title_ranked", item_counts=BUCKET_COUNTS)))
def q_buckets_counts(spark, sf):
    return coverage.coverage_buckets(title_ranked(spark, sf), item_counts=BUCKET_COUNTS)


@register("buckets_percentile", report_sql("title_ranked", Q.bucket_report("title_ranked", percentile_buckets=BUCKET_PERCENTILES)))
def q_buckets_percentile(spark, sf):
    return coverage.coverage_buckets(title_ranked(spark, sf), percentile_buckets=BUCKET_PERCENTILES)


@register("pop_buckets_percentile", report_sql("pop_merged", Q.bucket_report("pop_merged", percentile_buckets=POP_BUCKETS)))
def q_pop_buckets_percentile(spark, sf):
    return coverage.coverage_buckets(popularity_merged(spark, sf), percentile_buckets=POP_BUCKETS,
                                     empty_message="No items to analyze.")


@register("pop_buckets_size", report_sql("pop_merged", Q.bucket_report("pop_merged", bucket_size=7)))
def q_pop_buckets_size(spark, sf):
    return coverage.coverage_buckets(popularity_merged(spark, sf), bucket_size=7, empty_message="No items to analyze.")


@register("pop_buckets_counts", report_sql("pop_merged", Q.bucket_report("pop_merged", item_counts=BUCKET_COUNTS)))
def q_pop_buckets_counts(spark, sf):
    return coverage.coverage_buckets(popularity_merged(spark, sf), item_counts=BUCKET_COUNTS,
                                     empty_message="No items to analyze.")


# ----------------------------------------------------------------- split, tiers, sampling

from mnemo.operators import recommend as RC  # noqa: E402
from mnemo.operators import split as SP  # noqa: E402

TRAIN_RATIO = 0.8
SAMPLE_SEED = 42
SAMPLE_PER_TIER = 50


def stage(spark, sf, name, build):
    """A shared intermediate table, written once per session. These are the
    files the reference hands between its scripts (train/test TSVs, the
    recommendations checkpoint); later queries read the columns they need."""
    return D._cached(spark, sf, name, lambda: materialize(build()))


def split_table(spark, sf):
    return stage(spark, sf, "split", lambda: SP.train_test_split(D.interactions(spark, sf), TRAIN_RATIO))


def enriched(spark, sf, part):
    return RC.enrich_titles(split_table(spark, sf).filter(F.col("split") == part), D.items(spark, sf))


def train_titles(spark, sf):
    return stage(spark, sf, "train_titles", lambda: enriched(spark, sf, "train"))


def test_titles(spark, sf):
    return stage(spark, sf, "test_titles", lambda: enriched(spark, sf, "test"))


def eligible(spark, sf):
    """Eligibility asks for users only, so the titles of both sides need not be written for it."""
    return RC.eligible_users(enriched(spark, sf, "train"), enriched(spark, sf, "test"))


def answered(spark, sf):
    """Recommendation answers of eligible users (users without an answer failed)."""
    return stage(spark, sf, "answered", lambda: RC.answered_users(D.rec_responses(spark, sf), eligible(spark, sf)))


def parsed(spark, sf):
    return RC.split_parsed(stage(spark, sf, "parsed", lambda: RC.parse_ranked_lines(answered(spark, sf))))


SPLIT_CTES = {
    "split_pos": (("interactions",), """SELECT UserID, MovieID, RowIndex,
       CAST(row_number() OVER (PARTITION BY UserID ORDER BY RowIndex) - 1 AS BIGINT) AS UserPos,
       count(*) OVER (PARTITION BY UserID) AS n FROM interactions"""),
    "split": (("split_pos",), f"""SELECT UserID, MovieID, RowIndex, UserPos,
       CASE WHEN UserPos < (CASE WHEN n < 2 THEN n ELSE greatest(1, CAST(floor({TRAIN_RATIO!r} * n) AS BIGINT)) END)
            THEN 'train' ELSE 'test' END AS split FROM split_pos"""),
    "train_titles": (("split", "items"), """SELECT s.UserID, s.MovieID, s.RowIndex, s.UserPos, i.Title
FROM split s JOIN items i ON i.MovieID = s.MovieID WHERE s.split = 'train'"""),
    "test_titles": (("split", "items"), """SELECT s.UserID, s.MovieID, s.RowIndex, s.UserPos, i.Title
FROM split s JOIN items i ON i.MovieID = s.MovieID WHERE s.split = 'test'"""),
    "eligible": (("train_titles", "test_titles"), """SELECT DISTINCT UserID FROM train_titles
WHERE UserID IN (SELECT UserID FROM test_titles)"""),
    "answered": (("rec_responses", "eligible"), """SELECT UserID, output FROM rec_responses
WHERE output IS NOT NULL AND UserID IN (SELECT UserID FROM eligible)"""),
    "rec_raw": (("answered",), f"""SELECT UserID, CAST(line_no AS BIGINT) AS line_no, {Q.strip('raw')} AS line FROM (
  SELECT UserID, unnest(arr) AS raw, unnest(range(0, len(arr))) AS line_no
  FROM (SELECT UserID, string_split_regex(output, '{T.LINE_BREAKS}') AS arr FROM answered))"""),
    "recs_all": (("rec_raw",), f"""SELECT UserID, line_no, TRY_CAST(regexp_extract(line, '{T.RANKED_LINE_RE2}', 1) AS BIGINT) AS Rank,
       {Q.strip(f"regexp_extract(line, '{T.RANKED_LINE_RE2}', 2)")} AS Title
FROM rec_raw WHERE line <> '' AND regexp_matches(line, '{T.RANKED_LINE_RE2}')"""),
    "recs": (("recs_all",), "SELECT * FROM recs_all WHERE Rank IS NOT NULL AND Rank >= 1"),
    "rejects": (("recs_all",), "SELECT * FROM recs_all WHERE NOT (Rank IS NOT NULL AND Rank >= 1)"),
}


def ssql(body: str, *needs: str, extra: dict | None = None) -> str:
    defs = dict(SPLIT_CTES)
    if extra:
        defs.update(extra)
    return sql(body, *needs, extra=defs)


@register("train_test_split", ssql("SELECT UserID, MovieID, RowIndex, UserPos, split FROM split", "split"))
def q_train_test_split(spark, sf):
    return SP.train_test_split(D.interactions(spark, sf), TRAIN_RATIO).select("UserID", "MovieID", "RowIndex", "UserPos", "split")


@register("split_sizes", ssql("SELECT split, count(*) AS n FROM split GROUP BY split", "split"))
def q_split_sizes(spark, sf):
    return SP.split_sizes(split_table(spark, sf))


@register("enrich_titles", ssql("SELECT UserID, MovieID, RowIndex, Title FROM train_titles", "train_titles"))
def q_enrich_titles(spark, sf):
    return train_titles(spark, sf).select("UserID", "MovieID", "RowIndex", "Title")


@register("eligible_users", ssql("SELECT UserID FROM eligible", "eligible"))
def q_eligible_users(spark, sf):
    return eligible(spark, sf)


@register("user_histories", ssql("""SELECT UserID, count(*) AS n_titles, string_agg(Title, ', ' ORDER BY RowIndex) AS history
FROM train_titles GROUP BY UserID""", "train_titles"))
def q_user_histories(spark, sf):
    return RC.user_histories(train_titles(spark, sf))


@register("parse_ranked_list", ssql("SELECT UserID, line_no, Rank, Title FROM recs", "recs"))
def q_parse_ranked_list(spark, sf):
    return RC.parse_ranked_list(answered(spark, sf))[0]


@register("parse_rejects", ssql("SELECT UserID, line_no, Rank, Title FROM rejects", "rejects"))
def q_parse_rejects(spark, sf):
    return parsed(spark, sf)[1]


@register("rec_totals", ssql("SELECT count(*) AS total_recommendations, count(DISTINCT Title) AS unique_items FROM recs", "recs"))
def q_rec_totals(spark, sf):
    return RC.rec_totals(parsed(spark, sf)[0])


@register("rec_item_counts", ssql("SELECT Title, count(*) AS n FROM recs GROUP BY Title", "recs"))
def q_rec_item_counts(spark, sf):
    return RC.rec_item_counts(parsed(spark, sf)[0])


@register("rec_position_counts", ssql("SELECT Rank, Title, count(*) AS n FROM recs GROUP BY Rank, Title", "recs"))
def q_rec_position_counts(spark, sf):
    return RC.rec_position_counts(parsed(spark, sf)[0])


@register("top_items", ssql("SELECT Title, count(*) AS n FROM recs GROUP BY Title ORDER BY n DESC, Title LIMIT 10", "recs"))
def q_top_items(spark, sf):
    return RC.top_items(parsed(spark, sf)[0], 10)


@register("top_by_position", ssql("""SELECT Rank, Title, n, pos FROM (
  SELECT Rank, Title, n, CAST(row_number() OVER (PARTITION BY Rank ORDER BY n DESC, Title) AS BIGINT) AS pos
  FROM (SELECT Rank, Title, count(*) AS n FROM recs GROUP BY Rank, Title)) WHERE pos <= 5""", "recs"))
def q_top_by_position(spark, sf):
    return RC.top_by_position(parsed(spark, sf)[0], 5)


@register("short_rec_lists", ssql("""SELECT a.UserID, coalesce(c.n, 0) AS n_recs FROM (SELECT DISTINCT UserID FROM answered) a
LEFT JOIN (SELECT UserID, count(*) AS n FROM recs GROUP BY UserID) c ON c.UserID = a.UserID
WHERE coalesce(c.n, 0) < 50""", "answered", "recs"))
def q_short_rec_lists(spark, sf):
    return RC.short_rec_lists(parsed(spark, sf)[0], answered(spark, sf))


ABSENT_CTE = {"absent": (("recs", "items"), f"""SELECT norm_title, count(*) AS n FROM (SELECT {Q.normalize_clean('Title')} AS norm_title FROM recs)
GROUP BY norm_title
HAVING norm_title NOT IN (SELECT DISTINCT {Q.normalize_clean('Title')} FROM (SELECT DISTINCT Title FROM items WHERE Title IS NOT NULL))""")}


@register("absent_items", ssql("SELECT norm_title, n FROM absent", "absent", extra=ABSENT_CTE))
def q_absent_items(spark, sf):
    return RC.absent_items(parsed(spark, sf)[0], D.items(spark, sf))


@register("absent_totals", ssql("SELECT count(*) AS distinct_missing, coalesce(sum(n), 0) AS total_missing FROM absent",
                                "absent", extra=ABSENT_CTE))
def q_absent_totals(spark, sf):
    return RC.absent_totals(RC.absent_items(parsed(spark, sf)[0], D.items(spark, sf)))


# ----------------------------------------------------------------- ranking metrics

def _metrics_sql(preset: RC.Preset, norm_sql) -> str:
    t = preset.threshold
    if preset.population == "responded":
        pop = "SELECT DISTINCT UserID FROM answered"
    else:
        pop = "SELECT DISTINCT UserID FROM recs WHERE UserID IN (SELECT UserID FROM test_titles)"
    extra = {
        "m_pop": (("answered", "recs", "test_titles"), pop),
        "m_recs": (("recs", "m_pop"), f"SELECT UserID, Rank, {norm_sql('Title')} AS rec_norm FROM recs WHERE UserID IN (SELECT UserID FROM m_pop)"),
        "m_test": (("test_titles", "m_pop"), f"SELECT UserID, {norm_sql('Title')} AS test_norm FROM test_titles WHERE UserID IN (SELECT UserID FROM m_pop)"),
        "m_pairs": (("m_recs", "m_test"), """SELECT DISTINCT r.UserID, r.rec_norm, t.test_norm
FROM (SELECT DISTINCT UserID, rec_norm FROM m_recs) r JOIN (SELECT DISTINCT UserID, test_norm FROM m_test) t ON t.UserID = r.UserID"""),
    }
    if t >= 100:
        extra["m_hits"] = (("m_pairs",), "SELECT DISTINCT UserID, rec_norm FROM m_pairs WHERE rec_norm = test_norm")
    else:
        bound = "(CASE WHEN length(rec_norm) + length(test_norm) = 0 THEN 100.0 ELSE CAST(least(length(rec_norm), length(test_norm)) AS DOUBLE) * 200.0 / (length(rec_norm) + length(test_norm)) END)"
        extra.update(Q.lcs_ctes("m_lcs", f"SELECT rec_norm AS a, test_norm AS b FROM m_pairs WHERE rec_norm <> test_norm AND {bound} >= {t} - 1e-9"))
        extra["m_hits"] = (("m_pairs", "m_lcs"), f"""SELECT DISTINCT p.UserID, p.rec_norm FROM m_pairs p
LEFT JOIN m_lcs l ON l.a = p.rec_norm AND l.b = p.test_norm
WHERE p.rec_norm = p.test_norm OR {Q.ratio_expr('l.a', 'l.b', 'l.lcs')} >= {t}""")
    extra["m_matched"] = (("m_recs", "m_hits"), """SELECT r.UserID, r.Rank FROM m_recs r
JOIN m_hits h ON h.UserID = r.UserID AND h.rec_norm = r.rec_norm""")
    extra["m_ks"] = ((), "SELECT * FROM (VALUES " + ", ".join(f"({k})" for k in RC.CUTOFFS) + ") v(k)")
    extra["m_ntest"] = (("m_test",), "SELECT UserID, count(*) AS n_test FROM m_test GROUP BY UserID")
    extra["m_user"] = (("m_pop", "m_ks", "m_ntest", "m_matched"), f"""SELECT p.UserID, k.k,
       CAST(CASE WHEN EXISTS (SELECT 1 FROM m_matched m WHERE m.UserID = p.UserID AND m.Rank <= k.k) THEN 1 ELSE 0 END AS DOUBLE) AS hr,
       coalesce((SELECT sum(1 / log2(m.Rank + 1)) FROM m_matched m WHERE m.UserID = p.UserID AND m.Rank <= k.k), 0.0) AS dcg,
       (SELECT min(m.Rank) FROM m_matched m WHERE m.UserID = p.UserID AND m.Rank <= k.k) AS first_rank,
       least(coalesce(n.n_test, 0), k.k) AS n_ideal
FROM m_pop p CROSS JOIN m_ks k LEFT JOIN m_ntest n ON n.UserID = p.UserID""")
    body = f"""SELECT CAST(k.k AS INTEGER) AS k, round(coalesce(avg(hr), 0.0), 6) AS hr,
       round(coalesce(avg(CASE WHEN n_ideal > 0 THEN dcg / list_sum(list_transform(range(1, n_ideal + 1), lambda i: 1 / log2(i + 1))) ELSE 0.0 END), 0.0), 6) AS ndcg,
       round(coalesce(avg(coalesce(1.0 / first_rank, 0.0)), 0.0), 6) AS mrr,
       CAST(count(u.UserID) AS BIGINT) AS n_users
FROM m_ks k LEFT JOIN m_user u ON u.k = k.k GROUP BY k.k"""
    return ssql(body, *extra.keys(), extra=extra)


def _metrics(preset):
    def build(spark, sf):
        recs = parsed(spark, sf)[0]
        return RC.ranking_metrics(recs, test_titles(spark, sf), answered(spark, sf), preset)
    return build


register("metrics_inline", _metrics_sql(RC.INLINE, Q.normalize_plain))(_metrics(RC.INLINE))
register("metrics_evaluator", _metrics_sql(RC.EVALUATOR, Q.normalize_clean))(_metrics(RC.EVALUATOR))
register("metrics_exact", _metrics_sql(RC.EVALUATOR_EXACT, Q.normalize_clean))(_metrics(RC.EVALUATOR_EXACT))


def _matches_sql(preset, norm_sql):
    s = _metrics_sql(preset, norm_sql)
    head, _, _ = s.rpartition("SELECT CAST(k.k AS INTEGER)")
    return head + "SELECT r.UserID, r.Rank, r.rec_norm, CASE WHEN h.UserID IS NULL THEN 0 ELSE 1 END AS match FROM m_recs r LEFT JOIN m_hits h ON h.UserID = r.UserID AND h.rec_norm = r.rec_norm"


def _matches(preset):
    def build(spark, sf):
        recs = parsed(spark, sf)[0]
        users = RC.population(preset, answered(spark, sf), recs, test_titles(spark, sf))
        m = RC.match_recs(recs.join(users, "UserID", "left_semi"), test_titles(spark, sf), preset)
        return m.select("UserID", "Rank", "rec_norm", "match")
    return build


register("rec_matches_fuzzy", _matches_sql(RC.INLINE, Q.normalize_plain))(_matches(RC.INLINE))
register("rec_matches_exact", _matches_sql(RC.EVALUATOR_EXACT, Q.normalize_clean))(_matches(RC.EVALUATOR_EXACT))


@register("ideal_dcg", ssql(f"""SELECT UserID, k, n_test, least(n_test, k) AS n_ideal,
       round(CASE WHEN least(n_test, k) > 0 THEN list_sum(list_transform(range(1, least(n_test, k) + 1), lambda i: 1 / log2(i + 1))) ELSE 0.0 END, 6) AS ideal_dcg
FROM (SELECT UserID, count(*) AS n_test FROM test_titles GROUP BY UserID) CROSS JOIN (SELECT * FROM (VALUES {', '.join(f'({k})' for k in RC.CUTOFFS)}) v(k))""",
      "test_titles"))
def q_ideal_dcg(spark, sf):
    n_test = test_titles(spark, sf).groupBy("UserID").agg(F.count(F.lit(1)).alias("n_test"))
    ks = F.array(*[F.lit(k) for k in RC.CUTOFFS])
    ideal = F.array(*[F.lit(v) for v in RC.ideal_prefix()])
    out = n_test.select("UserID", F.explode(ks).alias("k"), "n_test")
    n_ideal = F.least(F.col("n_test"), F.col("k").cast("long"))
    return out.select("UserID", "k", "n_test", n_ideal.alias("n_ideal"),
                      F.round(F.when(n_ideal > 0, F.element_at(ideal, n_ideal.cast("int"))).otherwise(F.lit(0.0)), 6).alias("ideal_dcg"))


# ----------------------------------------------------------------- probes: interactions & users

from mnemo.operators import recall as RL  # noqa: E402


def interaction_results(spark, sf, rule=scoring.INTERACTION_RULE):
    """The interaction-probe ledger for one threshold rule, scored once per session."""
    return D._cached(spark, sf, f"interaction_results_{rule.threshold}_{rule.strict}", lambda: materialize(
        scoring.score_interactions(D.interactions(spark, sf), D.interaction_responses(spark, sf), rule)))


def user_results(spark, sf):
    """The user-attribute ledger, scored once per session."""
    return D._cached(spark, sf, "user_results", lambda: materialize(
        scoring.score_users(D.users(spark, sf), D.user_responses(spark, sf))))


PROBE_CTES = {
    "inter_gen": (("interactions", "interaction_responses"), f"""SELECT i.RowIndex, i.UserID,
       concat(CAST(i.UserID AS VARCHAR), '::', CAST(i.MovieID AS VARCHAR)) AS RealInteraction,
       {Q.response_text('r.output', T.ERROR_TEXT)} AS GeneratedInteraction
FROM interactions i LEFT JOIN interaction_responses r ON r.RowIndex = i.RowIndex"""),
    **Q.lcs_ctes("inter_lcs", "SELECT GeneratedInteraction AS a, RealInteraction AS b FROM inter_gen"),
    "inter_scores": (("inter_gen", "inter_lcs"), f"""SELECT g.RowIndex, g.UserID, g.GeneratedInteraction, g.RealInteraction,
       CASE WHEN {Q.sim_expr('g.GeneratedInteraction', 'g.RealInteraction', 'l.lcs')} > 80 THEN 0 ELSE 1 END AS ErrorFlag,
       CASE WHEN {Q.sim_expr('g.GeneratedInteraction', 'g.RealInteraction', 'l.lcs')} > 90 THEN 0 ELSE 1 END AS ErrorFlagUser
FROM inter_gen g LEFT JOIN inter_lcs l ON l.a = g.GeneratedInteraction AND l.b = g.RealInteraction"""),
    "user_gen": (("users", "user_responses"), f"""SELECT u.RowIndex,
       concat(CAST(u.UserID AS VARCHAR), '::', u.Gender, '::', CAST(u.Age AS VARCHAR), '::', CAST(u.Occupation AS VARCHAR), '::', u.Zip_code) AS RealUser,
       {Q.response_text('r.output', T.ERROR_TEXT)} AS GeneratedUser
FROM users u LEFT JOIN user_responses r ON r.RowIndex = u.RowIndex"""),
    **Q.lcs_ctes("user_lcs", "SELECT GeneratedUser AS a, RealUser AS b FROM user_gen"),
    "user_scores": (("user_gen", "user_lcs"), f"""SELECT g.RowIndex, g.GeneratedUser, g.RealUser,
       CASE WHEN {Q.sim_expr('g.GeneratedUser', 'g.RealUser', 'l.lcs')} >= 90 THEN 0 ELSE 1 END AS ErrorFlag
FROM user_gen g LEFT JOIN user_lcs l ON l.a = g.GeneratedUser AND l.b = g.RealUser"""),
    "tiers": (("activity",), """SELECT UserID, InteractionCount, ActivityRank,
       CASE WHEN ActivityRank < CAST(floor(0.2 * n) AS BIGINT) THEN 'top'
            WHEN ActivityRank < CAST(floor(0.8 * n) AS BIGINT) THEN 'middle' ELSE 'bottom' END AS tier
FROM (SELECT UserID, InteractionCount,
             CAST(row_number() OVER (ORDER BY InteractionCount DESC, UserID) - 1 AS BIGINT) AS ActivityRank,
             count(*) OVER () AS n FROM activity)"""),
    "sampled": (("tiers",), f"""SELECT tier, UserID FROM (
  SELECT tier, UserID, row_number() OVER (PARTITION BY tier ORDER BY md5(concat(CAST(UserID AS VARCHAR), ':{SAMPLE_SEED}')), UserID) AS rn
  FROM tiers) WHERE rn <= {SAMPLE_PER_TIER}"""),
}


def psql(body: str, *needs: str, extra: dict | None = None) -> str:
    defs = dict(PROBE_CTES)
    if extra:
        defs.update(extra)
    return ssql(body, *needs, extra=defs)


@register("score_interactions", psql("SELECT RowIndex, GeneratedInteraction, RealInteraction, ErrorFlag FROM inter_scores", "inter_scores"))
def q_score_interactions(spark, sf):
    scored = scoring.score_interactions(D.interactions(spark, sf), D.interaction_responses(spark, sf))
    return scored.drop("UserID")


@register("score_users", psql("SELECT RowIndex, GeneratedUser, RealUser, ErrorFlag FROM user_scores", "user_scores"))
def q_score_users(spark, sf):
    return scoring.score_users(D.users(spark, sf), D.user_responses(spark, sf))


@register("interaction_key", Q.build("SELECT RowIndex, concat(CAST(UserID AS VARCHAR), '::', CAST(MovieID AS VARCHAR)) AS record FROM interactions", "interactions"))
def q_interaction_key(spark, sf):
    return D.interactions(spark, sf).select("RowIndex", T.record_string("UserID", "MovieID").alias("record"))


@register("user_record", Q.build("""SELECT RowIndex, concat(CAST(UserID AS VARCHAR), '::', Gender, '::', CAST(Age AS VARCHAR), '::',
       CAST(Occupation AS VARCHAR), '::', Zip_code) AS record FROM users""", "users"))
def q_user_record(spark, sf):
    return D.users(spark, sf).select("RowIndex", T.record_string("UserID", "Gender", "Age", "Occupation", "Zip_code").alias("record"))


@register("user_tiers", psql("SELECT UserID, InteractionCount, ActivityRank, tier FROM tiers", "tiers"))
def q_user_tiers(spark, sf):
    return activity.user_tiers(D.interactions(spark, sf))


def sampled(spark, sf):
    """The sampled users per tier, drawn once per session and shared by the tier probe."""
    return D._cached(spark, sf, "sampled", lambda: materialize(
        activity.sample_users(activity.user_tiers(D.interactions(spark, sf)), SAMPLE_PER_TIER, SAMPLE_SEED)))


@register("sample_users", psql("SELECT tier, UserID FROM sampled", "sampled"))
def q_sample_users(spark, sf):
    return activity.sample_users(activity.user_tiers(D.interactions(spark, sf)), SAMPLE_PER_TIER, SAMPLE_SEED)


@register("sample_sizes", psql("SELECT tier, count(*) AS n FROM sampled GROUP BY tier", "sampled"))
def q_sample_sizes(spark, sf):
    return sampled(spark, sf).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@register("group_filter", psql("""SELECT s.tier, i.UserID, i.MovieID, i.RowIndex FROM interactions i JOIN sampled s ON s.UserID = i.UserID""",
                               "interactions", "sampled"))
def q_group_filter(spark, sf):
    s = sampled(spark, sf)
    rows = activity.group_filter(D.interactions(spark, sf), s)
    return rows.join(s, "UserID").select("tier", "UserID", "MovieID", "RowIndex")


@register("users_first_seen", Q.build("""SELECT UserID, FirstRowIndex, CAST(row_number() OVER (ORDER BY FirstRowIndex) - 1 AS BIGINT) AS UserOrder
FROM (SELECT UserID, min(RowIndex) AS FirstRowIndex FROM interactions GROUP BY UserID)""", "interactions"))
def q_users_first_seen(spark, sf):
    return activity.users_first_seen(D.interactions(spark, sf))


@register("recall_macro", psql("""SELECT round(avg(CAST(correct AS DOUBLE) / total), 6) AS recall, count(*) AS n_users FROM (
  SELECT split_part(RealInteraction, '::', 1) AS u, count(ErrorFlag) AS total, sum(CASE WHEN ErrorFlag = 0 THEN 1 ELSE 0 END) AS correct
  FROM inter_scores GROUP BY 1)""", "inter_scores"))
def q_recall_macro(spark, sf):
    return RL.recall_macro(interaction_results(spark, sf))


@register("hit_ratio_string", psql("""SELECT round(avg(h), 6) AS mean_hit_ratio, CAST(sum(h) AS BIGINT) AS binary_hit_count, count(*) AS n_users FROM (
  SELECT split_part(RealInteraction, '::', 1) AS u,
         max(CASE WHEN contains(substr(GeneratedInteraction, 1, 10), split_part(RealInteraction, '::', 2)) THEN 1 ELSE 0 END) AS h
  FROM inter_scores GROUP BY 1)""", "inter_scores"))
def q_hit_ratio_string(spark, sf):
    return RL.hit_ratio(interaction_results(spark, sf), 10, as_array=False)


@register("hit_ratio_array", psql("""SELECT round(avg(h), 6) AS mean_hit_ratio, CAST(sum(h) AS BIGINT) AS binary_hit_count, count(*) AS n_users FROM (
  SELECT split_part(RealInteraction, '::', 1) AS u,
         max(CASE WHEN list_contains(string_split(split_part(GeneratedInteraction, '::', 2), ',')[1:10], split_part(RealInteraction, '::', 2)) THEN 1 ELSE 0 END) AS h
  FROM inter_scores GROUP BY 1)""", "inter_scores"))
def q_hit_ratio_array(spark, sf):
    return RL.hit_ratio(interaction_results(spark, sf), 10, as_array=True)


@register("global_running_errors", psql("""SELECT RowIndex, ErrorFlag,
       CAST(sum(ErrorFlag) OVER (ORDER BY RowIndex ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_errors
FROM inter_scores""", "inter_scores"))
def q_global_running_errors(spark, sf):
    from mnemo.operators.positions import prefix_sum
    res = interaction_results(spark, sf).select("RowIndex", "ErrorFlag")
    return prefix_sum(res, "ErrorFlag", "RowIndex", "cum_errors")


def probe_report_sql(src: str, src_sql: tuple, pair) -> str:
    extra, body = pair
    return psql(body, src, *extra.keys(), extra={**extra, src: src_sql})


@register("coverage_interactions", probe_report_sql(
    "inter_ranked", (("inter_scores",), "SELECT RowIndex + 1 AS rank, ErrorFlagUser AS ErrorFlag FROM inter_scores"),
    Q.percentile_report("inter_ranked", [100], False)))
def q_coverage_interactions(spark, sf):
    res = interaction_results(spark, sf, scoring.USER_INTERACTION_RULE)
    return coverage.coverage_percentiles(coverage.rank_results(res, "RowIndex", dense=True), [100])


@register("coverage_users", probe_report_sql(
    "user_ranked", (("user_scores",), "SELECT RowIndex + 1 AS rank, ErrorFlag FROM user_scores"),
    Q.percentile_report("user_ranked", PERCENTILES, False)))
def q_coverage_users(spark, sf):
    return coverage.coverage_percentiles(coverage.rank_results(user_results(spark, sf), "RowIndex", dense=True), PERCENTILES)


# ----------------------------------------------------------------- string functions


@register("clean_title", Q.build(f"SELECT MovieID, {Q.clean_title('Title')} AS cleaned FROM items", "items"))
def q_clean_title(spark, sf):
    return D.items(spark, sf).select("MovieID", T.clean_title("Title").alias("cleaned"))


@register("normalize_title_plain", Q.build(f"SELECT MovieID, {Q.normalize_plain('Title')} AS norm FROM items", "items"))
def q_normalize_title_plain(spark, sf):
    return D.items(spark, sf).select("MovieID", T.normalize_title_plain("Title").alias("norm"))


@register("normalize_title_eval", Q.build(f"SELECT MovieID, {Q.normalize_clean('Title')} AS norm FROM items", "items"))
def q_normalize_title_eval(spark, sf):
    return D.items(spark, sf).select("MovieID", T.normalize_title_clean("Title").alias("norm"))


@register("strip_ws", f"SELECT doc_id, {Q.strip('text')} AS stripped FROM documents")
def q_strip_ws(spark, sf):
    return D.table(spark, sf, "documents", ["doc_id", "text"]).select("doc_id", T.py_strip("text").alias("stripped"))


@register("strip_key_echo", Q.build(f"""SELECT MovieID, {Q.strip("replace(output, CAST(MovieID AS VARCHAR) || '::', '')")} AS answer
FROM title_responses""", "title_responses"))
def q_strip_key_echo(spark, sf):
    r = D.title_responses(spark, sf)
    return r.select("MovieID", T.strip_key_echo("output", "MovieID").alias("answer"))


@register("response_sentinels", Q.build(f"""SELECT RowIndex, {Q.response_text('output', T.ERROR_TEXT)} AS answer FROM interaction_responses""",
                                        "interaction_responses"))
def q_response_sentinels(spark, sf):
    return D.interaction_responses(spark, sf).select("RowIndex", T.response_text("output", T.ERROR_TEXT).alias("answer"))


@register("split_interaction", psql("""SELECT RowIndex, split_part(RealInteraction, '::', 1) AS user_part,
       split_part(RealInteraction, '::', 2) AS item_part FROM inter_scores""", "inter_scores"))
def q_split_interaction(spark, sf):
    r = interaction_results(spark, sf)
    return r.select("RowIndex", T.split_record("RealInteraction", 0).alias("user_part"),
                    T.split_record("RealInteraction", 1).alias("item_part"))


@register("history_string", ssql("""SELECT UserID, string_agg(Title, ', ' ORDER BY RowIndex) AS history FROM train_titles GROUP BY UserID""",
                                 "train_titles"))
def q_history_string(spark, sf):
    return RC.user_histories(train_titles(spark, sf)).select("UserID", "history")


@register("last_message", """SELECT conv_id, text AS answer, role FROM (
  SELECT conv_id, text, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1""")
def q_last_message(spark, sf):
    c = D.table(spark, sf, "conversations", ["conv_id", "turn", "role", "text"])
    # the last message is an aggregate; the conversation is never gathered
    last = c.groupBy("conv_id").agg(F.max_by(F.array(F.struct("role", F.col("text").alias("content"))), "turn").alias("messages"))
    return last.select("conv_id", T.last_message("messages").alias("answer"), F.col("messages")[0]["role"].alias("role"))


@register("model_slug", """SELECT p_partkey, replace(concat(p_brand, '/', p_type), '/', '_') AS slug FROM part""")
def q_model_slug(spark, sf):
    p = D.table(spark, sf, "part", ["p_partkey", "p_brand", "p_type"])
    return p.select("p_partkey", T.model_slug(F.concat(F.col("p_brand"), F.lit("/"), F.col("p_type"))).alias("slug"))


@register("record_to_map", psql("""SELECT RowIndex, list_aggregate(list_transform(range(1, least(len(p), 5) + 1),
       lambda i: concat(['UserID', 'Gender', 'Age', 'Occupation', 'Zip_code'][i], '=', p[i])), 'string_agg', chr(10)) AS fields
FROM (SELECT RowIndex, string_split(GeneratedUser, '::') AS p FROM user_scores)""", "user_scores"))
def q_record_to_map(spark, sf):
    """dict(zip(names, record.split('::'))): zip stops at the shorter side."""
    names = F.array(*[F.lit(n) for n in ("UserID", "Gender", "Age", "Occupation", "Zip_code")])
    r = user_results(spark, sf)
    parts = F.split(F.col("GeneratedUser"), "::")
    n = F.least(F.size(parts), F.size(names))
    m = r.select("RowIndex", F.map_from_arrays(F.slice(names, 1, n), F.slice(parts, 1, n)).alias("m"))
    # a map has no order to compare by: its entries as lines, in the order of the names
    entries = F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return m.select("RowIndex", F.array_join(entries, "\n").alias("fields"))


@register("title_lookup", sql("""SELECT k.MovieID, coalesce(i.Title, 'Unknown') AS RealTitle FROM
  (SELECT DISTINCT l_partkey AS MovieID FROM lineitem UNION SELECT DISTINCT l_partkey + 100000 FROM lineitem) k
  LEFT JOIN (SELECT MovieID, CASE WHEN MovieID % 10 = 0 THEN 'Another ' || Title ELSE Title END AS Title FROM items) i
    ON i.MovieID = k.MovieID""", "items"))
def q_title_lookup(spark, sf):
    """Every tenth item is listed twice; the later row's title holds."""
    li = D.table(spark, sf, "lineitem", ["l_partkey"])
    keys = li.select(F.col("l_partkey").cast("long").alias("MovieID")).unionByName(
        li.select((F.col("l_partkey") + 100000).cast("long").alias("MovieID"))).distinct()
    items = D.items_ordered(spark, sf)
    again = (items.filter(F.col("MovieID") % 10 == 0)
             .select("MovieID", F.concat(F.lit("Another "), F.col("Title")).alias("Title"), (F.col("ItemPos") + (1 << 40)).alias("ItemPos")))
    return scoring.title_lookup(keys, items.unionByName(again), "ItemPos").select("MovieID", "RealTitle")


@register("popularity_join", sql("""SELECT p.MovieID, p.PopRank, coalesce(s.ErrorFlag, 1) AS ErrorFlag
FROM popularity p LEFT JOIN title_scores s ON s.MovieID = p.MovieID""", "popularity", "title_scores"))
def q_popularity_join(spark, sf):
    return popularity_merged(spark, sf).select("MovieID", F.col("rank").alias("PopRank"), "ErrorFlag")


@register("attach_responses", Q.build("""SELECT i.MovieID, r.output FROM items i LEFT JOIN title_responses r ON r.MovieID = i.MovieID""",
                                      "items", "title_responses"))
def q_attach_responses(spark, sf):
    return scoring.attach_responses(D.items(spark, sf).select("MovieID"), D.title_responses(spark, sf), "MovieID")


# ----------------------------------------------------------------- prompts

from mnemo.operators import prompts as PR  # noqa: E402
from mnemo.operators.positions import batch_ids as _batch_ids  # noqa: E402


def _pair_sql(u: str, a: str) -> str:
    return f"concat('user: ', {u}, chr(10), 'assistant: ', {a})"


def prompt_ctes(prow_sql: tuple, seed: tuple | None = None) -> dict:
    """CTEs over prow(key, grp, fb, pos, flag, user_msg, asst_msg, ord) -> examples, transcripts.
    ``seed`` (grp, pos, user_msg, asst_msg), with positions before all others, stands for
    what an earlier run left."""
    b = PR.BATCH_SIZE
    k = PR.N_EXAMPLES
    return {
        "pr_seed": seed or ((), "SELECT 0 AS grp, 0 AS pos, '' AS user_msg, '' AS asst_msg WHERE 1 = 0"),
        "prow": prow_sql,
        "pr_b": (("prow",), f"SELECT *, CAST(floor(pos / {b}) AS BIGINT) AS batch FROM prow"),
        "pr_c": (("pr_b", "pr_seed"), """SELECT *, row_number() OVER (PARTITION BY grp ORDER BY pos) AS cnum
FROM (SELECT grp, pos, user_msg, asst_msg FROM pr_b WHERE flag = 0 UNION ALL SELECT grp, pos, user_msg, asst_msg FROM pr_seed)"""),
        "pr_c0": (("pr_b", "pr_seed"), """SELECT grp, fb, batch, CAST(coalesce(sum(nc) OVER (PARTITION BY grp ORDER BY batch
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (SELECT count(*) FROM pr_seed) AS BIGINT) AS C0
FROM (SELECT grp, fb, batch, sum(CASE WHEN flag = 0 THEN 1 ELSE 0 END) AS nc FROM pr_b GROUP BY grp, fb, batch)"""),
        "pr_init": (("prow",), f"""SELECT fb, slot, user_msg, asst_msg FROM (
  SELECT fb, user_msg, asst_msg, row_number() OVER (PARTITION BY fb ORDER BY ord) AS slot FROM prow) WHERE slot <= {k}"""),
        "pr_ex": (("pr_c0", "pr_c", "pr_init"), f"""SELECT c0.grp, c0.batch, CAST(c.cnum - greatest(c0.C0 - {k - 1}, 1) + 1 AS BIGINT) AS slot,
       CAST(CASE WHEN c.pos >= 0 THEN c.pos END AS BIGINT) AS ex_pos, c.user_msg, c.asst_msg
FROM pr_c0 c0 JOIN pr_c c ON c.grp = c0.grp AND c.cnum BETWEEN greatest(c0.C0 - {k - 1}, 1) AND c0.C0 WHERE c0.C0 > 0
UNION ALL
SELECT c0.grp, c0.batch, CAST(i.slot AS BIGINT), CAST(NULL AS BIGINT), i.user_msg, i.asst_msg
FROM pr_c0 c0 JOIN pr_init i ON i.fb = c0.fb WHERE c0.C0 = 0"""),
        "pr_ext": (("pr_ex",), f"""SELECT grp, batch, count(*) AS n_ex,
       string_agg({_pair_sql('user_msg', 'asst_msg')}, chr(10) ORDER BY slot) AS ex_text FROM pr_ex GROUP BY grp, batch"""),
        "pr_tr": (("pr_b",), f"""SELECT a.grp, a.pos, count(b.pos) AS n_tr,
       string_agg(CASE WHEN b.pos IS NOT NULL THEN {_pair_sql('b.user_msg', 'b.asst_msg')} END, chr(10) ORDER BY b.pos) AS tr_text
FROM pr_b a LEFT JOIN pr_b b ON b.grp = a.grp AND b.batch = a.batch AND b.pos < a.pos GROUP BY a.grp, a.pos"""),
        "pr_out": (("pr_b", "pr_ext", "pr_tr"), """SELECT a.key, a.grp, a.pos, a.batch, 2 + 2 * coalesce(e.n_ex, 0) + 2 * t.n_tr AS n_messages,
       e.ex_text, t.tr_text, a.user_msg
FROM pr_b a LEFT JOIN pr_ext e ON e.grp = a.grp AND e.batch = a.batch JOIN pr_tr t ON t.grp = a.grp AND t.pos = a.pos"""),
    }


def prompt_text_sql(system: str) -> str:
    sys_line = Q.lit("system: " + system.format(dataset=PR.DATASET_NAME))
    return f"concat_ws(chr(10), {sys_line}, ex_text, tr_text, concat('user: ', user_msg))"


TITLE_PROW = (("title_scores",), """SELECT MovieID AS key, 0 AS grp, 0 AS fb, ItemPos AS pos, ErrorFlag AS flag,
       concat('Input: ', CAST(MovieID AS VARCHAR), '::') AS user_msg, concat(CAST(MovieID AS VARCHAR), '::', RealTitle, chr(10)) AS asst_msg,
       MovieID AS ord FROM title_scores""")
INTER_PROW = (("inter_scores",), """SELECT RowIndex AS key, 0 AS grp, 0 AS fb, RowIndex AS pos, ErrorFlag AS flag,
       concat(split_part(RealInteraction, '::', 1), '::') AS user_msg, RealInteraction AS asst_msg, RowIndex AS ord FROM inter_scores""")
USER_PROW = (("user_scores",), """SELECT RowIndex AS key, 0 AS grp, 0 AS fb, RowIndex AS pos, ErrorFlag AS flag,
       concat(split_part(RealUser, '::', 1), '::') AS user_msg, RealUser AS asst_msg, RowIndex AS ord FROM user_scores""")
# the sampled users' rows are scored by themselves: the LCS of all other rows isn't needed
SAMPLED_SCORES = {
    "inter_gen_s": (("inter_gen", "sampled"), "SELECT * FROM inter_gen WHERE UserID IN (SELECT UserID FROM sampled)"),
    **Q.lcs_ctes("inter_lcs_s", "SELECT GeneratedInteraction AS a, RealInteraction AS b FROM inter_gen_s"),
    "inter_scores_s": (("inter_gen_s", "inter_lcs_s"), f"""SELECT g.RowIndex, g.UserID, g.GeneratedInteraction, g.RealInteraction,
       CASE WHEN {Q.sim_expr('g.GeneratedInteraction', 'g.RealInteraction', 'l.lcs')} > 90 THEN 0 ELSE 1 END AS ErrorFlagUser
FROM inter_gen_s g LEFT JOIN inter_lcs_s l ON l.a = g.GeneratedInteraction AND l.b = g.RealInteraction"""),
}
PER_USER_PROW = (("inter_scores_s", "sampled"), """SELECT i.RowIndex AS key, i.UserID AS grp, s.tier AS fb,
       CAST(row_number() OVER (PARTITION BY i.UserID ORDER BY i.RowIndex) - 1 AS BIGINT) AS pos, i.ErrorFlagUser AS flag,
       concat(split_part(i.RealInteraction, '::', 1), '::') AS user_msg, i.RealInteraction AS asst_msg, i.RowIndex AS ord
FROM inter_scores_s i JOIN sampled s ON s.UserID = i.UserID""")


def prompt_sql(prow: tuple, body: str, seed: tuple | None = None) -> str:
    extra = SAMPLED_SCORES | prompt_ctes(prow, seed)
    return psql(body, *extra.keys(), extra=extra)


def title_prompt_rows(spark, sf):
    return PR.title_rows(title_results(spark, sf))


def per_user_rows(spark, sf):
    res = interaction_results(spark, sf, scoring.USER_INTERACTION_RULE)
    return PR.user_probe_rows(res, sampled(spark, sf))


@register("batch_ids", Q.build("SELECT RowIndex, CAST(floor(RowIndex / 50) AS BIGINT) AS batch FROM interactions", "interactions"))
def q_batch_ids(spark, sf):
    return _batch_ids(D.interactions(spark, sf), "RowIndex", PR.BATCH_SIZE).select("RowIndex", "batch")


@register("initial_examples", prompt_sql(TITLE_PROW, "SELECT slot, user_msg, asst_msg FROM pr_init"))
def q_initial_examples(spark, sf):
    return PR.initial_examples(title_prompt_rows(spark, sf)).select("slot", "user_msg", "asst_msg")


@register("last_three", psql("""SELECT RowIndex, GeneratedInteraction, RealInteraction, ErrorFlag FROM inter_scores
ORDER BY RowIndex DESC LIMIT 3""", "inter_scores"))
def q_last_three(spark, sf):
    return PR.last_three(interaction_results(spark, sf).drop("UserID"), "RowIndex")


@register("fewshot_examples", prompt_sql(TITLE_PROW, "SELECT batch, slot, ex_pos, asst_msg FROM pr_ex"))
def q_fewshot_examples(spark, sf):
    return PR.fewshot_examples(title_prompt_rows(spark, sf)).select("batch", "slot", "ex_pos", "asst_msg")


@register("fewshot_examples_user", prompt_sql(PER_USER_PROW, "SELECT grp AS UserID, batch, slot, ex_pos, asst_msg FROM pr_ex"))
def q_fewshot_examples_user(spark, sf):
    ex = PR.fewshot_examples(per_user_rows(spark, sf), group_cols=["UserID"], fallback_cols=["tier"])
    return ex.select("UserID", "batch", "slot", "ex_pos", "asst_msg")


@register("transcript", prompt_sql(TITLE_PROW, "SELECT key, batch, n_tr, coalesce(tr_text, '') AS tr_text FROM pr_b JOIN pr_tr USING (grp, pos)"))
def q_transcript(spark, sf):
    from pyspark.sql import Window
    rows = _batch_ids(title_prompt_rows(spark, sf), "pos", PR.BATCH_SIZE)
    w = Window.partitionBy("batch").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    tr = F.collect_list(F.struct("pos", "user_msg", "asst_msg")).over(w)
    rows = rows.withColumn("tr", tr)
    text = F.array_join(F.transform("tr", lambda s: F.concat(F.lit("user: "), s["user_msg"], F.lit("\nassistant: "), s["asst_msg"])), "\n")
    return rows.select("key", "batch", F.size("tr").cast("long").alias("n_tr"), text.alias("tr_text"))


@register("prompts_title", prompt_sql(TITLE_PROW, f"SELECT key, batch, n_messages, {prompt_text_sql(PR.TITLE_SYSTEM)} AS prompt FROM pr_out"))
def q_prompts_title(spark, sf):
    p = PR.build_prompts(title_prompt_rows(spark, sf), PR.TITLE_SYSTEM)
    return p.select("key", "batch", F.size("messages").cast("long").alias("n_messages"), PR.render("messages").alias("prompt"))


@register("prompts_interaction", prompt_sql(INTER_PROW, f"SELECT key, batch, n_messages, md5({prompt_text_sql(PR.INTERACTION_SYSTEM)}) AS prompt_md5 FROM pr_out"))
def q_prompts_interaction(spark, sf):
    rows = PR.record_rows(interaction_results(spark, sf), "RealInteraction")
    p = PR.prompt_texts(rows, PR.INTERACTION_SYSTEM)
    return p.select("key", "batch", "n_messages", F.md5("prompt").alias("prompt_md5"))


@register("prompts_user_interaction", prompt_sql(PER_USER_PROW, f"SELECT key, grp AS UserID, batch, n_messages, md5({prompt_text_sql(PR.USER_INTERACTION_SYSTEM)}) AS prompt_md5 FROM pr_out"))
def q_prompts_user_interaction(spark, sf):
    p = PR.prompt_texts(per_user_rows(spark, sf), PR.USER_INTERACTION_SYSTEM, group_cols=["UserID"], fallback_cols=["tier"])
    return p.select("key", "UserID", "batch", "n_messages", F.md5("prompt").alias("prompt_md5"))


@register("prompts_user_attr", prompt_sql(USER_PROW, f"SELECT key, batch, n_messages, {prompt_text_sql(PR.USER_ATTRIBUTE_SYSTEM)} AS prompt FROM pr_out"))
def q_prompts_user_attr(spark, sf):
    rows = PR.record_rows(user_results(spark, sf), "RealUser")
    p = PR.build_prompts(rows, PR.USER_ATTRIBUTE_SYSTEM)
    return p.select("key", "batch", F.size("messages").cast("long").alias("n_messages"), PR.render("messages").alias("prompt"))


@register("prompts_recommend", ssql(f"""SELECT UserID, 2 AS n_messages,
       concat({Q.lit('system: ' + PR.RECOMMEND_SYSTEM.format(dataset=PR.DATASET_NAME))}, chr(10), 'user: ',
              replace(replace({Q.lit(PR.RECOMMEND_USER)}, '{{user}}', CAST(UserID AS VARCHAR)), '{{history}}', history)) AS prompt
FROM (SELECT UserID, string_agg(Title, ', ' ORDER BY RowIndex) AS history FROM train_titles
      WHERE UserID IN (SELECT UserID FROM eligible) GROUP BY UserID)""", "train_titles", "eligible"))
def q_prompts_recommend(spark, sf):
    hist = RC.user_histories(train_titles(spark, sf).join(eligible(spark, sf), "UserID", "left_semi"))
    p = PR.recommend_prompts(hist)
    return p.select("UserID", F.size("messages").cast("long").alias("n_messages"), PR.render("messages").alias("prompt"))


# ----------------------------------------------------------------- sources, sinks, ledger, streaming

from mnemo.sources import files as FS  # noqa: E402
from mnemo.sources import ledger as LG  # noqa: E402
from mnemo.session import scratch_path  # noqa: E402

MODEL_NAME = "org/model-a"
MODEL_SLUG = "org_model-a"
USER_COLS = ["UserID", "Gender", "Age", "Occupation", "Zip-code"]

RAW_CTES = {
    "raw_lines": (("users",), r"""SELECT RowIndex, CASE WHEN UserID % 13 = 0 THEN concat_ws('::', CAST(UserID AS VARCHAR), g)
            WHEN UserID % 11 = 0 THEN concat(' ' || chr(9), full_line, '  ') ELSE full_line END AS value
FROM (SELECT *, concat_ws('::', CAST(UserID AS VARCHAR), g, CAST(Age AS VARCHAR), CAST(Occupation AS VARCHAR), Zip_code) AS full_line
      FROM (SELECT *, CASE WHEN UserID % 9 = 0 THEN concat('"', Gender, '" x') ELSE Gender END AS g FROM users))"""),
    "raw_parts": (("raw_lines",), f"SELECT value, string_split({Q.strip('value')}, '::') AS p FROM raw_lines"),
}
RAW_ACCEPTED = """SELECT p[1] AS UserID, p[2] AS Gender, p[3] AS Age, p[4] AS Occupation, p[5] AS "Zip-code" FROM raw_parts WHERE len(p) >= 5"""


def raw_ingested(spark, sf):
    path = scratch_path(spark, "users.dat")
    D.raw_user_lines(spark, sf).select("value").write.mode("overwrite").text(path)
    return FS.ingest_delimited(spark, path, USER_COLS, [0, 1, 2, 3, 4])


@register("raw_delimited_ingest", psql(RAW_ACCEPTED, "raw_parts", extra=RAW_CTES))
def q_raw_delimited_ingest(spark, sf):
    return raw_ingested(spark, sf)[0]


@register("raw_delimited_rejects", psql("SELECT value FROM raw_parts WHERE len(p) < 5", "raw_parts", extra=RAW_CTES))
def q_raw_delimited_rejects(spark, sf):
    return raw_ingested(spark, sf)[1]


@register("sink_csv_roundtrip", psql(RAW_ACCEPTED, "raw_parts", extra=RAW_CTES))
def q_sink_csv_roundtrip(spark, sf):
    path = scratch_path(spark, "users.csv")
    FS.write_csv(raw_ingested(spark, sf)[0], path)
    return FS.read_csv(spark, path, ", ".join(f"`{c}` STRING" for c in USER_COLS))


@register("decode_lines", "SELECT doc_id, regexp_replace(text, '[\\r\\n]+', ' ', 'g') AS text FROM documents")
def q_decode_lines(spark, sf):
    path = scratch_path(spark, "documents.txt")
    docs = D.document_lines(spark, sf).select(F.concat(F.col("doc_id").cast("string"), F.lit("\t"), F.col("text")).alias("line"), "doc_id")
    FS.write_latin1_lines(docs, "line", F.col("doc_id") % 2 == 0, path)
    lines = FS.decode_lines(spark, path)
    return lines.select(F.split_part("value", F.lit("\t"), F.lit(1)).cast("long").alias("doc_id"),
                        F.expr("substr(value, instr(value, '\t') + 1)").alias("text"))


@register("scan_csv_items", Q.build("SELECT MovieID, Title FROM items", "items"))
def q_scan_csv_items(spark, sf):
    path = scratch_path(spark, "items.csv")
    FS.write_csv(D.items(spark, sf), path)
    return FS.read_items(spark, path)


@register("scan_pruned", Q.build("SELECT UserID, MovieID FROM interactions", "interactions"))
def q_scan_pruned(spark, sf):
    path = scratch_path(spark, "interactions.csv")
    FS.write_csv(D.interactions(spark, sf).select("UserID", "MovieID", "RowIndex"), path)
    return FS.read_interactions(spark, path)


@register("scan_tsv", ssql("SELECT UserID, MovieID, RowIndex FROM split WHERE split = 'train'", "split"))
def q_scan_tsv(spark, sf):
    path = scratch_path(spark, "training.tsv")
    FS.write_tsv(split_table(spark, sf).filter(F.col("split") == "train").select("UserID", "MovieID", "RowIndex"), path)
    return FS.read_tsv(spark, path, "UserID LONG, MovieID LONG, RowIndex LONG")


@register("scan_tsv_noheader", ssql("SELECT UserID, MovieID FROM split WHERE split = 'test'", "split"))
def q_scan_tsv_noheader(spark, sf):
    path = scratch_path(spark, "test.tsv")
    test = split_table(spark, sf).filter(F.col("split") == "test").select("UserID", "MovieID", F.lit("1").alias("Interact"))
    FS.write_tsv(test, path, header=False)
    return FS.read_test_noheader(spark, path)


def _crash_point(n: int) -> int:
    """A previous run stopped after the first third of the rows (ceil)."""
    return -(-n // 3)


@register("resume_pending", Q.build("""SELECT MovieID, ItemPos, CAST(floor(ItemPos / 50) AS BIGINT) AS batch FROM items_ordered
WHERE ItemPos >= CAST(ceil((SELECT count(*) FROM items) / 3.0) AS BIGINT)""", "items_ordered"))
def q_resume_pending(spark, sf):
    from mnemo.operators.positions import batch_ids
    items = D.items_ordered(spark, sf)
    res = title_results(spark, sf)
    crash = _crash_point(items.count())
    path = scratch_path(spark, "ledger")
    LG.append(res.filter(F.col("ItemPos") < crash).drop("ItemPos"), path, MODEL_NAME)
    done = LG.of_model(LG.read(spark, path), MODEL_NAME)
    return LG.pending(batch_ids(items, "ItemPos", 50), done, "MovieID").select("MovieID", "ItemPos", "batch")


@register("prompts_title_resumed", prompt_sql(
    (("title_scores", "items"), TITLE_PROW[1] + " WHERE ItemPos >= CAST(ceil((SELECT count(*) FROM items) / 3.0) AS BIGINT)"),
    f"SELECT key, batch, n_messages, {prompt_text_sql(PR.TITLE_SYSTEM)} AS prompt FROM pr_out",
    (("title_scores", "items"), """SELECT 0 AS grp, -rn AS pos, user_msg, asst_msg FROM (
  SELECT concat('Input: ', CAST(MovieID AS VARCHAR), '::') AS user_msg, concat(CAST(MovieID AS VARCHAR), '::', RealTitle, chr(10)) AS asst_msg,
         row_number() OVER (ORDER BY ItemPos DESC) AS rn
  FROM title_scores WHERE ItemPos < CAST(ceil((SELECT count(*) FROM items) / 3.0) AS BIGINT)) WHERE rn <= 3""")))
def q_prompts_title_resumed(spark, sf):
    """The prompts of a second run: rows that the ledger lacks, examples seeded by its last three."""
    res = title_results(spark, sf)
    crash = _crash_point(D.items_ordered(spark, sf).count())
    path = scratch_path(spark, "ledger")
    LG.append(res.filter(F.col("ItemPos") < crash), path, MODEL_NAME)
    done = LG.read(spark, path)
    seed = PR.last_three(PR.title_rows(done), "pos")
    pending = PR.title_rows(LG.pending(res, done, "MovieID"))
    p = PR.build_prompts(pending, PR.TITLE_SYSTEM, seed=seed)
    return p.select("key", "batch", F.size("messages").cast("long").alias("n_messages"), PR.render("messages").alias("prompt"))


@register("probe_static", sql("""SELECT MovieID, '' AS GeneratedTitle, Title AS RealTitle, 1 AS ErrorFlag FROM items""", "items"))
def q_probe_static(spark, sf):
    """The title probe end to end, run, broken off and run again: every item once."""
    from mnemo.operators.generate import echo_responder
    from mnemo.plans import flows
    items = D.items_ordered(spark, sf)
    out = scratch_path(spark, "probe")
    part = items.filter(F.col("ItemPos") < _crash_point(items.count()))
    for rows in (part, items, items):
        stored = flows.probe_titles(rows, echo_responder, out, MODEL_NAME, max_attempts=1)
    return stored.select("MovieID", "GeneratedTitle", "RealTitle", "ErrorFlag")


def _resumed_ctes(scores: str, real: str, n: str) -> tuple[tuple, tuple]:
    """(prow, seed) of a second run of a record probe whose first stopped after a third of the rows."""
    cut = f"CAST(ceil((SELECT count(*) FROM {n}) / 3.0) AS BIGINT)"
    user = f"concat(split_part({real}, '::', 1), '::') AS user_msg, {real} AS asst_msg"
    return (((scores, n), f"""SELECT RowIndex AS key, 0 AS grp, 0 AS fb, RowIndex AS pos, ErrorFlag AS flag, {user}, RowIndex AS ord
FROM {scores} WHERE RowIndex >= {cut}"""),
            ((scores, n), f"""SELECT 0 AS grp, -rn AS pos, user_msg, asst_msg FROM (
  SELECT {user}, row_number() OVER (ORDER BY RowIndex DESC) AS rn FROM {scores} WHERE RowIndex < {cut}) WHERE rn <= 3"""))


def _resumed(spark, probe, table, results):
    """Prompts of the second run over ``table``, the first having published the first third."""
    from mnemo.plans import probing
    crash = _crash_point(table.count())
    log = probing.ledger(spark, scratch_path(spark, "resume"), probe, MODEL_NAME)
    run = log.begin()
    run.write(results.filter(F.col(probe.key) < crash), "ledger")
    run.commit()
    flags = results.select(F.col(probe.key).alias("key"), F.col("ErrorFlag").alias("flag"))
    p = probing.resumed_prompts(table, probe, log.read("ledger", probe.schema), flags)
    return p.select("key", "batch", F.size("messages").cast("long").alias("n_messages"), F.md5(PR.render("messages")).alias("prompt_md5"))


@register("prompts_interaction_resumed", prompt_sql(
    _resumed_ctes("inter_scores", "RealInteraction", "interactions")[0],
    f"SELECT key, batch, n_messages, md5({prompt_text_sql(PR.INTERACTION_SYSTEM)}) AS prompt_md5 FROM pr_out",
    _resumed_ctes("inter_scores", "RealInteraction", "interactions")[1]))
def q_prompts_interaction_resumed(spark, sf):
    """As ``prompts_title_resumed``, of the interaction probe."""
    from mnemo.plans import probing
    return _resumed(spark, probing.INTERACTIONS, D.interactions(spark, sf), interaction_results(spark, sf))


@register("prompts_user_attr_resumed", prompt_sql(
    _resumed_ctes("user_scores", "RealUser", "users")[0],
    f"SELECT key, batch, n_messages, md5({prompt_text_sql(PR.USER_ATTRIBUTE_SYSTEM)}) AS prompt_md5 FROM pr_out",
    _resumed_ctes("user_scores", "RealUser", "users")[1]))
def q_prompts_user_attr_resumed(spark, sf):
    """As ``prompts_title_resumed``, of the user probe."""
    from mnemo.plans import probing
    return _resumed(spark, probing.USERS, D.users(spark, sf), user_results(spark, sf))


# the live probe's stand-in answers every question of user u with 'u::1', which is near enough for some rows
LIVE_SCORES = SAMPLED_SCORES | {"inter_gen_s": (("inter_gen", "sampled"), """SELECT RowIndex, UserID, RealInteraction,
       concat(CAST(UserID AS VARCHAR), '::1') AS GeneratedInteraction
FROM inter_gen WHERE UserID IN (SELECT UserID FROM sampled)""")}


def live_sql(body: str) -> str:
    extra = LIVE_SCORES | prompt_ctes(PER_USER_PROW)
    return psql(body, *extra.keys(), extra=extra)


@register("probe_live_users", live_sql(f"""SELECT o.key, o.grp AS UserID, o.n_messages, md5({prompt_text_sql(PR.USER_INTERACTION_SYSTEM)}) AS prompt_md5,
       b.flag AS ErrorFlag FROM pr_out o JOIN (SELECT key AS k, flag FROM pr_b) b ON b.k = o.key"""))
def q_probe_live_users(spark, sf):
    """The per-user probe asked live, wave after wave over all sampled users: what every
    prompt was, with the examples that the answers before it had earned, and its outcome."""
    from mnemo.operators.generate import user_one_responder
    from mnemo.plans import probing
    who = sampled(spark, sf)
    table = D.interactions(spark, sf).join(who.select("UserID", "tier"), "UserID")
    out = scratch_path(spark, "live")
    done = probing.probe_live(table, probing.USER_INTERACTIONS, user_one_responder, out, MODEL_NAME, keep_prompts=True, max_attempts=1)
    asked = probing.ledger(spark, out, probing.USER_INTERACTIONS, MODEL_NAME).read("prompts", probing.PROMPTS)
    return asked.join(done.withColumnRenamed("RowIndex", "key"), "key").select(
        "key", "UserID", F.size("messages").cast("long").alias("n_messages"), F.md5(PR.render("messages")).alias("prompt_md5"), "ErrorFlag")


@register("rec_resume", ssql("""SELECT t.UserID, CASE WHEN e.UserID IS NULL THEN 'skipped' ELSE 'done' END AS status,
       CAST(coalesce(n.n, 0) AS BIGINT) AS n_recs
FROM (SELECT DISTINCT UserID FROM train_titles) t LEFT JOIN eligible e ON e.UserID = t.UserID LEFT JOIN answered a ON a.UserID = t.UserID
LEFT JOIN (SELECT UserID, count(*) AS n FROM recs GROUP BY UserID) n ON n.UserID = t.UserID
WHERE e.UserID IS NULL OR a.UserID IS NOT NULL""", "train_titles", "eligible", "answered", "recs"))
def q_rec_resume(spark, sf):
    """Progress of recommendation runs: a first run answers a third of the users, later ones the
    rest; failed calls stay open, users without both sides are skipped, nobody is done twice."""
    from mnemo.plans import flows
    out = scratch_path(spark, "recommend")
    answers = D.rec_responses(spark, sf)
    first = answers.withColumn("output", F.when(F.col("UserID") % 3 == 0, F.col("output")))
    for responses in (first, answers, answers):
        done, recs = flows.recommend_resumable(train_titles(spark, sf), test_titles(spark, sf), responses, out)
    n = recs.groupBy("UserID").agg(F.count(F.lit(1)).alias("n_recs"))
    return done.join(n, "UserID", "left").select("UserID", "status", F.coalesce("n_recs", F.lit(0)).cast("long").alias("n_recs"))


@register("coverage_tiers", psql(f"""SELECT tier, CAST(sum(ErrorFlagUser) AS BIGINT) AS errors, CAST(count(*) - sum(ErrorFlagUser) AS BIGINT) AS correct,
       count(*) AS size, {Q.coverage('count(*) - sum(ErrorFlagUser)', 'count(*)')} AS coverage
FROM inter_scores_s i JOIN sampled s ON s.UserID = i.UserID GROUP BY tier""", "inter_scores_s", "sampled", extra=SAMPLED_SCORES))
def q_coverage_tiers(spark, sf):
    """The report of each sampled activity tier over all its rows."""
    s = sampled(spark, sf)
    scored = scoring.score_interactions(activity.group_filter(D.interactions(spark, sf), s), D.interaction_responses(spark, sf),
                                        scoring.USER_INTERACTION_RULE)
    scored = materialize(scored.join(s, "UserID"))
    out = None
    for tier in activity.TIERS:
        rep = coverage.coverage_percentiles(coverage.rank_results(scored.filter(F.col("tier") == tier), "RowIndex"), [100])
        part = rep.filter(F.col("ord") == 1).select(F.lit(tier).alias("tier"), "errors", "correct", "size", "coverage")
        out = part if out is None else out.unionByName(part)
    return out


@register("ledger_append", sql(f"SELECT '{MODEL_SLUG}' AS model, MovieID, GeneratedTitle, RealTitle, ErrorFlag FROM title_scores", "title_scores"))
def q_ledger_append(spark, sf):
    res = title_results(spark, sf)
    crash = _crash_point(D.items_ordered(spark, sf).count())
    path = scratch_path(spark, "ledger")
    LG.append(res.filter(F.col("ItemPos") < crash).drop("ItemPos"), path, MODEL_NAME)
    LG.append(res.filter(F.col("ItemPos") >= crash).drop("ItemPos"), path, MODEL_NAME)
    return LG.read(spark, path).select("model", "MovieID", "GeneratedTitle", "RealTitle", "ErrorFlag")


@register("report_lines", report_sql("pop_merged", Q.percentile_report("pop_merged", PERCENTILES, True)).replace(
    "\nSELECT ord, first_item", "\nSELECT ord, line FROM (SELECT ord, first_item", 1) + ")")
def q_report_lines(spark, sf):
    path = scratch_path(spark, "Popularity_analysis_summary.txt")
    FS.write_report(q_coverage_popularity(spark, sf), path)
    return FS.read_report(spark, path)


@register("generate_stub", Q.build("SELECT MovieID AS key, concat(CAST(MovieID AS VARCHAR), '::') AS output FROM items", "items"))
def q_generate_stub(spark, sf):
    from mnemo.operators.generate import echo_responder, generate
    p = PR.build_prompts(title_prompt_rows(spark, sf), PR.TITLE_SYSTEM)
    return generate(p, echo_responder, key="key", max_attempts=2, backoff_min=0.0, backoff_max=0.0).select("key", "output")


def _stream_ledger(spark, sf):
    from mnemo.streaming.ledger_stream import score_stream
    src = scratch_path(spark, "responses")
    D.title_responses(spark, sf).repartition(4, "MovieID").write.mode("overwrite").parquet(src)
    items = D.items_ordered(spark, sf)
    ledger_path = scratch_path(spark, "ledger")

    def score(batch):
        return scoring.score_titles(items.join(batch.select("MovieID"), "MovieID", "left_semi"), batch).drop("ItemPos")

    for run in ("ckpt1", "ckpt2"):  # the second run sees all files again and adds nothing
        score_stream(spark, src, "MovieID LONG, output STRING", score, ledger_path, scratch_path(spark, run), "MovieID", MODEL_NAME)
    return ledger_path


@register("stream_score_ledger", sql("SELECT MovieID, GeneratedTitle, RealTitle, ErrorFlag FROM title_scores", "title_scores"))
def q_stream_score_ledger(spark, sf):
    path = _stream_ledger(spark, sf)
    return LG.read(spark, path).select("MovieID", "GeneratedTitle", "RealTitle", "ErrorFlag")


@register("stream_coverage", sql(f"""SELECT '{MODEL_SLUG}' AS model, count(*) AS n, CAST(sum(ErrorFlag) AS BIGINT) AS errors,
       {Q.coverage('count(*) - sum(ErrorFlag)', 'count(*)')} AS coverage FROM title_scores""", "title_scores"))
def q_stream_coverage(spark, sf):
    from mnemo.streaming.ledger_stream import coverage_stream
    ledger_path = _stream_ledger(spark, sf)
    out = scratch_path(spark, "coverage")
    schema = "MovieID LONG, GeneratedTitle STRING, RealTitle STRING, ErrorFlag INT, model STRING"
    coverage_stream(spark, ledger_path, schema, out, scratch_path(spark, "ckpt3"))
    r = spark.read.parquet(out)
    return r.select("model", "n", "errors", coverage.coverage_value(F.col("n") - F.col("errors"), F.col("n")).alias("coverage"))


# ----------------------------------------------------------------- evaluation log


def _fixed4_sql(x: str) -> str:
    return f"printf('%.4f', round_even(CAST({x} AS DOUBLE) * 10000.0, 0) / 10000.0)"


def _evaluation_log_sql() -> str:
    m = _metrics_sql(RC.EVALUATOR_EXACT, Q.normalize_clean)
    head, _, _ = m.rpartition("SELECT CAST(k.k AS INTEGER) AS k, round(")
    metrics = """SELECT k.k AS k, coalesce(avg(hr), 0.0) AS hr,
       coalesce(avg(CASE WHEN n_ideal > 0 THEN dcg / list_sum(list_transform(range(1, n_ideal + 1), lambda i: 1 / log2(i + 1))) ELSE 0.0 END), 0.0) AS ndcg,
       coalesce(avg(coalesce(1.0 / first_rank, 0.0)), 0.0) AS mrr
FROM m_ks k LEFT JOIN m_user u ON u.k = k.k GROUP BY k.k"""
    k = "CAST(k AS VARCHAR)"
    q = "chr(39)"
    six = lambda x: f"printf('%.6f', round_even(CAST({x} AS DOUBLE) * 1000000.0, 0) / 1000000.0)"
    absent = ABSENT_CTE["absent"][1]
    return head + f"""SELECT 0 AS section, CAST(k AS BIGINT) AS p1, CAST(0 AS BIGINT) AS p2,
       concat('Cutoff ', {k}, ' -> HR@', {k}, ': ', {_fixed4_sql('hr')}, ', nDCG@', {k}, ': ', {_fixed4_sql('ndcg')},
              ', MRR@', {k}, ': ', {_fixed4_sql('mrr')}) AS line FROM ({metrics})
UNION ALL SELECT 1, 0, 0, 'Evaluation Metrics with 100% threshold:'
UNION ALL SELECT 2, k, 0, concat('Cutoff ', {k}, ': {{', {q}, 'HR@', {k}, {q}, ': ', {six('hr')}, ', ', {q}, 'nDCG@', {k}, {q}, ': ',
              {six('ndcg')}, ', ', {q}, 'MRR@', {k}, {q}, ': ', {six('mrr')}, '}}') FROM ({metrics})
UNION ALL SELECT 3, 0, 0, ''
UNION ALL SELECT 3, 1, 0, 'Overall Recommendation Statistics:'
UNION ALL SELECT 3, 2, 0, concat('Total recommendations: ', CAST(count(*) AS VARCHAR)) FROM recs
UNION ALL SELECT 3, 3, 0, concat('Unique items recommended: ', CAST(count(DISTINCT Title) AS VARCHAR)) FROM recs
UNION ALL SELECT 3, 4, 0, 'Top recommended items:'
UNION ALL SELECT 4, row_number() OVER (ORDER BY n DESC, Title), 0, concat('  ', Title, ': ', CAST(n AS VARCHAR), ' times')
  FROM (SELECT Title, count(*) AS n FROM recs GROUP BY Title ORDER BY n DESC, Title LIMIT 10)
UNION ALL SELECT 5, 0, 0, ''
UNION ALL SELECT 5, 1, 0, 'Recommendation Frequency by Position:'
UNION ALL SELECT 6, Rank, 0, concat('Rank ', CAST(Rank AS VARCHAR), ':') FROM (SELECT DISTINCT Rank FROM recs)
UNION ALL SELECT 6, Rank, pos, concat('    ', Title, ': ', CAST(n AS VARCHAR), ' times') FROM (
  SELECT Rank, Title, n, row_number() OVER (PARTITION BY Rank ORDER BY n DESC, Title) AS pos
  FROM (SELECT Rank, Title, count(*) AS n FROM recs GROUP BY Rank, Title)) WHERE pos <= 5
UNION ALL SELECT 7, 0, 0, concat('Distinct recommended items missing from dataset: ', CAST(count(*) AS VARCHAR)) FROM ({absent})
UNION ALL SELECT 7, 1, 0, concat('Total missing recommendations (with duplicates): ', CAST(coalesce(sum(n), 0) AS VARCHAR)) FROM ({absent})
UNION ALL SELECT 7, 2, 0, CASE WHEN count(*) > 0 THEN 'Missing items and their counts:' ELSE 'All recommended items are present in the dataset.' END FROM ({absent})
UNION ALL SELECT 8, 0, row_number() OVER (ORDER BY n DESC, norm_title), concat('  ', norm_title, ': ', CAST(n AS VARCHAR), ' times') FROM ({absent})"""


@register("evaluation_log", _evaluation_log_sql())
def q_evaluation_log(spark, sf):
    recs = parsed(spark, sf)[0]
    metrics = RC.ranking_metrics(recs, test_titles(spark, sf), answered(spark, sf), RC.EVALUATOR_EXACT, digits=None)
    return RC.evaluation_log(metrics, recs, RC.absent_items(recs, D.items(spark, sf)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v.build for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v.sql for k, v in REGISTRY.items() if v.sql is not None}
