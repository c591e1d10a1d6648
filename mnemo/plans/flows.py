"""End-to-end runs, the counterparts of the reference's driver scripts.

Each flow takes DataFrames (read them with :mod:`mnemo.sources.files` or derive
them with :mod:`mnemo.sources.derived`) and an output folder on shared storage,
writes the same artefacts (result ledger, report text files, recommendation
TSV) and returns the result DataFrames.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.functions.names import model_name, output_name  # noqa: F401 - model_name is part of this module's interface
from mnemo.operators import activity, coverage, generate, prompts, recommend, scoring
from mnemo.plans import probing
from mnemo.session import materialize, staged
from mnemo.sources import files, ledger
from mnemo.sources.commits import RunLog

# Report parameters of the reference's driver script.
PERCENTILES = (1, 10, 20, 25, 50, 75, 90, 100)
POPULARITY_BUCKETS = (0.2, 0.8)


# Configuration keys of each kind of back end.
REQUIRED_KEYS = ("dataset_name", "model_type", "model_name", "batch_size")
TYPE_KEYS = {"hf": ("hf_key",), "openai": ("azure_endpoint", "azure_openai_key", "api_version", "deployment_name"),
             "sglang": ("hf_key",), "foundry": ("foundry_model_name", "foundry_endpoint", "foundry_api_key")}
def check_config(config: dict) -> None:
    """Raise KeyError for a missing parameter, ValueError for an unknown kind of back end."""
    if config["model_type"] not in TYPE_KEYS:
        raise ValueError(f"Invalid model_type {config['model_type']!r}: one of {', '.join(sorted(TYPE_KEYS))}")
    for key in (*REQUIRED_KEYS, *TYPE_KEYS[config["model_type"]]):
        if key not in config:
            raise KeyError(f"Missing required config parameter: {key}")


def _append_pending(log: RunLog, schema: str, rows: DataFrame, key: str, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Score the rows that the log's ledger lacks, publish them as one run, and return the ledger."""
    pending = ledger.pending(rows, log.read("ledger", schema), key)
    if not pending.isEmpty():
        run = log.begin()
        run.write(score(pending), "ledger")
        run.commit()
    return log.read("ledger", schema)


def probe_titles(items: DataFrame, responder, out_dir: str, model: str, batch_size: int = prompts.BATCH_SIZE,
                 max_attempts: int = generate.MAX_ATTEMPTS, renew: int | None = None) -> DataFrame:
    """The title probe with a live responder, resumable: the rows of the ledger after all
    items that it lacks were asked. Without ``renew`` the examples are fixed for the run (the
    ledger's last three rows, or the table's first three), and all prompts are one job; with
    1 they follow the answers from batch to batch (:func:`probing.probe_live`)."""
    return probing.probe_live(items, probing.TITLES, responder, out_dir, model, batch_size, renew, max_attempts=max_attempts)


PROCESSED = "UserID long, status string"
RECOMMENDED = "UserID long, Title string, Rank long"


def recommend_resumable(train: DataFrame, test: DataFrame, responses: DataFrame, out_dir: str) -> tuple[DataFrame, DataFrame]:
    """One run of the recommender over (UserID, output) answers, resumable: it adds to
    ``processed`` (UserID, status) and ``recommendations`` (UserID, Title, Rank) below
    ``out_dir``, both or neither, and returns both. ``train`` and ``test`` have titles.

    Users without both sides are ``skipped``; users with an answer are ``done``, whether or
    not a line of it parses; a failed call (null output) or none leaves a user open.
    """
    log = RunLog(train.sparkSession, out_dir)
    users = materialize(ledger.pending(train.select("UserID").distinct(), log.read("processed", PROCESSED), "UserID"))
    eligible = users.join(recommend.eligible_users(train, test), "UserID", "left_semi")
    answered = materialize(recommend.answered_users(responses, eligible))
    recs = recommend.parse_ranked_list(answered)[0].select("UserID", "Title", "Rank")
    skipped = users.join(eligible, "UserID", "left_anti").select("UserID", F.lit("skipped").alias("status"))
    done = answered.select("UserID").distinct().select("UserID", F.lit("done").alias("status"))
    run = log.begin()
    run.write(recs, "recommendations")
    run.write(done.unionByName(skipped), "processed")
    run.commit()
    return log.read("processed", PROCESSED), log.read("recommendations", RECOMMENDED)


def memorization_report(items: DataFrame, interactions: DataFrame, title_responses: DataFrame,
                        out_dir: str, model: str, percentiles: Sequence[float] = PERCENTILES,
                        users: DataFrame | None = None, user_responses: DataFrame | None = None) -> dict[str, DataFrame]:
    """Title probe (and optionally the user-attribute probe) with all coverage reports.

    ``items`` needs (MovieID, Title, ItemPos); ``users`` (UserID, Gender, Age,
    Occupation, Zip_code, RowIndex). Publishes the ledger below ``out_dir`` and writes one text file per report.
    """
    slug = output_name(model)
    # the reports read what was stored: nothing is scored twice
    stored = _append_pending(probing.ledger(items.sparkSession, out_dir, probing.TITLES, model), probing.TITLES.schema, items, "MovieID",
                             lambda rows: scoring.score_titles(rows, title_responses))
    ranked = coverage.rank_results(stored, "ItemPos")
    pop = activity.item_popularity(interactions)
    # (rank, flag) rows, written once: the counts and all reports below read these alone
    merged = staged(coverage.popularity_merge(stored, pop, "ItemPos"), "popularity")
    reports = {
        f"analysis_summary_{slug}.txt": coverage.coverage_percentiles(ranked, percentiles),
        f"Popularity_analysis_summary_{slug}.txt": coverage.coverage_popularity(merged, percentiles),
        f"Aggregate_Popularity_analysis_summary_{slug}.txt": coverage.coverage_curve(merged),
        f"Aggregate_Popularity_Bucket_analysis_summary_{slug}.txt":
            coverage.coverage_buckets(merged, percentile_buckets=POPULARITY_BUCKETS, empty_message="No items to analyze."),
    }
    if users is not None and user_responses is not None:
        user_results = scoring.score_users(users, user_responses)
        reports[f"user_analysis_summary_{slug}.txt"] = coverage.coverage_percentiles(
            coverage.rank_results(user_results, "RowIndex", dense=True), percentiles)
    for name, rep in reports.items():
        files.write_report(rep, f"{out_dir}/{name}")
    return {"ledger": stored, "popularity": pop, **reports}


def tier_probe(interactions: DataFrame, responses: DataFrame, out_dir: str, model: str,
               n_per_group: int = 50, seed: int = 42) -> dict[str, DataFrame]:
    """Next-interaction probe over users sampled from three activity tiers.

    ``interactions`` needs (UserID, MovieID, RowIndex); ``responses`` (RowIndex,
    output). All tiers run as one job, partitioned by ``user_group``.
    """
    slug = output_name(model)
    tiers = activity.user_tiers(interactions)
    sampled = activity.sample_users(tiers, n_per_group, seed)
    rows = activity.group_filter(interactions, sampled)
    probe = probing.USER_INTERACTIONS
    results = _append_pending(probing.ledger(interactions.sparkSession, out_dir, probe, model), probe.schema, rows, probe.key,
                              lambda new: probe.score(new, responses))
    results = results.join(sampled.withColumnRenamed("tier", "user_group"), "UserID")
    out = {"sampled": sampled, "results": results}
    for tier in activity.TIERS:
        part = results.filter(F.col("user_group") == tier)
        rep = coverage.coverage_percentiles(coverage.rank_results(part, "RowIndex"), [100])
        files.write_report(rep, f"{out_dir}/analysis_summary_{slug}_{tier}_users.txt")
        out[tier] = rep
    return out


def recommendation_evaluation(train: DataFrame, test: DataFrame, items: DataFrame, responses: DataFrame,
                              out_dir: str, model: str) -> dict[str, DataFrame]:
    """Leave-n-out run: parse answers, score in-run and offline presets, list statistics.

    ``train``/``test``: (UserID, MovieID, RowIndex); ``responses``: (UserID, output)
    null where the call failed.
    """
    slug = output_name(model)
    train_t = recommend.enrich_titles(train, items)
    test_t = recommend.enrich_titles(test, items)
    eligible = recommend.eligible_users(train_t, test_t)
    answered = materialize(recommend.answered_users(responses, eligible))
    recs, rejects = recommend.split_parsed(materialize(recommend.parse_ranked_lines(answered)))  # every result below reads them
    test_t = materialize(test_t)
    files.write_tsv(recs.select("UserID", "Title", "Rank"), f"{out_dir}/{slug}_recommendations.tsv")
    return {
        "recommendations": recs, "rejects": rejects,
        "metrics_inline": recommend.ranking_metrics(recs, test_t, answered, recommend.INLINE),
        "metrics_evaluator": recommend.ranking_metrics(recs, test_t, answered, recommend.EVALUATOR),
        "metrics_exact": recommend.ranking_metrics(recs, test_t, answered, recommend.EVALUATOR_EXACT),
        "totals": recommend.rec_totals(recs),
        "top_items": recommend.top_items(recs),
        "top_by_position": recommend.top_by_position(recs),
        "absent_items": recommend.absent_items(recs, items),
    }


def hold_out(interactions: DataFrame, out_dir: str, train_ratio: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Ordered per-user split written as training.tsv / test.tsv (header on)."""
    from mnemo.operators.split import train_test_split
    sp = train_test_split(interactions, train_ratio)
    train = sp.filter(F.col("split") == "train").select("UserID", "MovieID", "RowIndex")
    test = sp.filter(F.col("split") == "test").select("UserID", "MovieID", "RowIndex")
    files.write_tsv(train, f"{out_dir}/training.tsv")
    files.write_tsv(test, f"{out_dir}/test.tsv")
    return train, test


def evaluate_saved(recommendations_path: str, test_path: str, items_path: str,
                   similarity_threshold: float = 0.85, test_has_header: bool = False) -> dict[str, DataFrame]:
    """Offline evaluator over saved files: recommendations TSV (UserID, Title, Rank),
    the test TSV (headerless UserID, MovieID, Interact by default) and the items CSV.
    A missing path raises; without recommendations every result is an empty table, with a warning."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    recs = files.read_tsv(spark, recommendations_path, "UserID LONG, Title STRING, Rank LONG")
    recs = recs.withColumn("line_no", F.col("Rank"))
    if test_has_header:
        test = files.read_tsv(spark, test_path, "UserID LONG, MovieID LONG, RowIndex LONG").select("UserID", "MovieID")
    else:
        test = files.read_test_noheader(spark, test_path)
    items = files.read_items(spark, items_path)
    test_t = recommend.enrich_titles(test, items)
    preset = recommend.Preset(recommend.normalize_title_clean, recommend.evaluator_threshold(similarity_threshold),
                              "with_recs")
    metrics = recommend.ranking_metrics(recs, test_t, recs.select("UserID").distinct(), preset)
    if recs.isEmpty():
        warnings.warn(f"no recommendations in {recommendations_path}", stacklevel=2)
        none = recs.filter(F.lit(False))
        return {"metrics": metrics.filter(F.lit(False)), "totals": recommend.rec_totals(none).filter(F.lit(False)),
                "top_items": recommend.top_items(none), "top_by_position": recommend.top_by_position(none),
                "absent_items": recommend.absent_items(none, items)}
    return {"metrics": metrics, "totals": recommend.rec_totals(recs), "top_items": recommend.top_items(recs),
            "top_by_position": recommend.top_by_position(recs), "absent_items": recommend.absent_items(recs, items)}
