"""Leave-n-out recommendation evaluation: list parsing, title matching,
HR@K / nDCG@K / MRR@K, list statistics and absent-item checks.

Matching is an equi join on UserID with a residual of two bounds that lose no match: of
lengths, and of bag signatures, 256 bits a title. Strings are normalised and signed once and
go by numbers from there on: rows of lists move once, with number and signature, equal
numbers match without the kernel, and the kernel runs once per distinct likely
(recommended, test) string pair across all users.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemo.functions.similarity import BAG_WORDS, bag_bound_ok, bag_signature, edit_bound_ok, indel_ratio_here, length_bound_of
from mnemo.operators.positions import global_index, position_in_group
from mnemo.session import cpu_partitions, staged
from mnemo.functions.text import WS_CHARS, normalize_title_clean, normalize_title_plain, py_strip, split_lines

# Metric cutoffs and list length used by the reference.
CUTOFFS = (1, 3, 5, 10, 20, 50)
LIST_LENGTH = 50


@dataclass(frozen=True)
class Preset:
    """How one of the two reference code paths scores a list."""
    normalizer: Callable[[Column], Column]
    threshold: int            # on the 0-100 scale, compared with '>='
    population: str           # 'responded' or 'with_recs'


def evaluator_threshold(similarity_threshold: float) -> int:
    """int(threshold * 100), truncating like the reference (0.57 -> 56)."""
    return int(similarity_threshold * 100)


# The in-run scorer (plain normaliser, >= 80, every user that got an answer)
# and the offline evaluator (parentheses removed, int(0.85*100), users with >= 1 rec).
INLINE = Preset(normalize_title_plain, 80, "responded")
EVALUATOR = Preset(normalize_title_clean, evaluator_threshold(0.85), "with_recs")
EVALUATOR_EXACT = Preset(normalize_title_clean, evaluator_threshold(1), "with_recs")


# --------------------------------------------------------------------------- parsing

def parse_ranked_lines(responses: DataFrame, key: str = "UserID") -> DataFrame:
    """(key, line_no, Rank, Title, ok) of every stripped line 'Rank. Title', in one pass.

    A line counts if it begins with digits and a dot and has more than white space after
    them; duplicates and ranks above 50 are kept. ``ok`` is false where the rank is 0 or
    does not fit a long. One regular expression finds the digits; the rest of the line
    is cut off by position.
    """
    # stripped in the array: what comes out of an explode is computed once, not again in each filter
    lines = F.transform(split_lines("output"), lambda x: py_strip(x))
    s = responses.select(key, F.posexplode(lines).alias("line_no", "line"))
    s = s.filter(F.substring("line", 1, 1).between("0", "9")).withColumn("_digits", F.regexp_extract("line", r"^([0-9]+)\.", 1))
    # a stripped line ends in no white space, so whatever stands after the dot is more than that
    s = s.filter((F.col("_digits") != "") & (F.length("line") > F.length("_digits") + 1))
    title = F.ltrim(F.expr("substring(line, length(_digits) + 2)"), F.lit("".join(WS_CHARS)))
    s = s.select(key, F.col("line_no").cast("long").alias("line_no"), F.col("_digits").try_cast("bigint").alias("Rank"), title.alias("Title"))
    return s.withColumn("ok", F.col("Rank").isNotNull() & (F.col("Rank") >= 1))


def parse_ranked_list(responses: DataFrame, key: str = "UserID") -> tuple[DataFrame, DataFrame]:
    """(recs, rejects): both sides of :func:`parse_ranked_lines`. To use both, materialise
    the parsed lines first (:func:`split_parsed`), or the answers are parsed for each."""
    return split_parsed(parse_ranked_lines(responses, key))


def split_parsed(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    return parsed.filter("ok").drop("ok"), parsed.filter(~F.col("ok")).drop("ok")


# --------------------------------------------------------------------------- inputs

def enrich_titles(rows: DataFrame, items: DataFrame) -> DataFrame:
    """rows INNER JOIN items on MovieID (unknown items drop out, duplicates multiply)."""
    return rows.join(items.select("MovieID", "Title"), "MovieID")


def answered_users(responses: DataFrame, eligible: DataFrame) -> DataFrame:
    """Answers that came: of eligible users, without those of failed calls (null output),
    which are in no population. They are dealt over a fixed number of partitions: lists of
    the same titles shrink so well that merging partitions by size would leave a few tasks
    with all the parsing."""
    came = responses.filter(F.col("output").isNotNull()).repartition(cpu_partitions(responses.sparkSession), "UserID")
    return came.join(eligible, "UserID", "left_semi")


def eligible_users(train: DataFrame, test: DataFrame) -> DataFrame:
    """Users with at least one training and one test title (after the item join)."""
    return train.select("UserID").distinct().join(test.select("UserID").distinct(), "UserID", "left_semi")


HISTORY_CHUNK = 1 << 12


def user_histories(train_titles: DataFrame, order_col: str = "RowIndex", chunk: int = HISTORY_CHUNK) -> DataFrame:
    """(UserID, n_titles, history): training titles in row order joined with ', '.

    The history is the prompt text, so it is one value per user. Users of at most ``chunk``
    rows, all but one for each ``chunk`` rows of the table, are joined as they are. The
    others are built in two levels so that no task sorts a very active user's whole list:
    chunks of ``chunk`` consecutive positions are joined in parallel, then the chunk strings.
    """
    rows = train_titles.filter(F.col("UserID").isNotNull())
    large = rows.groupBy("UserID").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > chunk).select("UserID", F.lit(True).alias("_large"))
    marked = rows.select("UserID", F.col(order_col).alias("_at"), "Title").join(F.broadcast(large), "UserID", "left")

    def texts(df: DataFrame, *by: str) -> DataFrame:
        parts = F.transform(F.array_sort(F.collect_list(F.struct("_at", "Title"))), lambda s: s["Title"])
        return df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.array_join(parts, ", ").alias("_part"))

    whole = texts(marked.filter(F.col("_large").isNull()), "UserID").select("UserID", F.col("_n").alias("n_titles"), F.col("_part").alias("history"))
    pos = position_in_group(marked.filter(F.col("_large").isNotNull()), ["UserID"], "_at", "_hpos")
    parts = texts(pos.select("UserID", F.col("_hpos").alias("_at"), "Title", F.floor(F.col("_hpos") / chunk).alias("_chunk")), "UserID", "_chunk")
    joined = F.transform(F.array_sort(F.collect_list(F.struct("_chunk", "_part"))), lambda s: s["_part"])
    return whole.unionByName(parts.groupBy("UserID").agg(F.sum("_n").alias("n_titles"), F.array_join(joined, ", ").alias("history")))


# --------------------------------------------------------------------------- matching

def title_ids(recs: DataFrame, test_titles: DataFrame, preset: Preset) -> tuple[DataFrame, DataFrame]:
    """(Title, id, ...) of every title of either side, and (id, norm) of every normalised one.

    Titles repeat across users, so each is normalised once and each normalised string signed
    once; equal ids are equal strings. Both tables are kept: a scan ends what the planner would
    infer for the rows of lists (their titles normalised once more to see that they aren't
    null), and a small one is broadcast before any row moves. Below a threshold of 100 the ids
    come with what the bounds ask for: ``len`` and the words of the bag signature."""
    titles = recs.select("Title").union(test_titles.select("Title")).filter(F.col("Title").isNotNull()).distinct()
    named = staged(titles.select("Title", preset.normalizer(F.col("Title")).alias("norm")), "titles")
    norms = named.select("norm").distinct().withColumn("id", F.monotonically_increasing_id())  # fixed by being written
    if preset.threshold < 100:
        norms = (norms.withColumn("_sig", bag_signature("norm"))
                 .select("id", "norm", F.length("norm").alias("len"), *[F.get("_sig", F.lit(w)).alias(f"sig{w}") for w in range(BAG_WORDS)]))
    norms = staged(norms, "norms")
    return staged(named.join(norms, "norm").drop("norm"), "title_ids"), norms.select("id", "norm")


def matching_pairs(recs: DataFrame, test_titles: DataFrame, preset: Preset, ids: DataFrame, norms: DataFrame) -> DataFrame:
    """recs without ``Title`` + (rec_id, test_id): a row for each row of ``recs`` and each
    different normalised test title of its user that is similar enough.

    Rows move to their user once, as ids with signatures. The join's condition drops what
    the lengths and the bag signatures rule out (neither ever rules out a match); what is
    left are ids alone, which are kept, and the kernel runs once for each distinct pair."""
    own = lambda df, side: df.join(ids, "Title").drop("Title").withColumnsRenamed(
        {c: f"{side}_{c}" for c in ids.columns if c != "Title"})
    r = own(recs, "rec")
    t = own(test_titles.select("UserID", "Title"), "test").distinct()
    keep = [c for c in recs.columns if c != "Title"] + ["rec_id", "test_id"]
    equal = F.col("rec_id") == F.col("test_id")
    if preset.threshold >= 100:  # ratio >= 100 <=> equal strings: a plain equi join
        return r.join(t.withColumn("rec_id", F.col("test_id")), ["UserID", "rec_id"]).select(*keep)
    la, lb = F.col("rec_len"), F.col("test_len")
    signature = lambda side: F.array(*[F.col(f"{side}_sig{w}") for w in range(BAG_WORDS)])
    likely = ((length_bound_of(la, lb) >= F.lit(preset.threshold - 1e-9))
              & bag_bound_ok(signature("rec"), signature("test"), la, lb, preset.threshold))
    pairs = staged(r.join(t, "UserID").filter(equal | likely).select(*keep), "pairs")
    strings = lambda side: norms.select(F.col("id").alias(f"{side}_id"), F.col("norm").alias(f"{side}_norm"))
    # a fixed partition count keeps AQE from coalescing this small-in-bytes, CPU-bound
    # stage into a few tasks
    kernel = (pairs.filter(~equal).select("rec_id", "test_id").distinct()
              .join(strings("rec"), "rec_id").join(strings("test"), "test_id")
              .filter(edit_bound_ok("rec_norm", "test_norm", preset.threshold))
              .repartition(cpu_partitions(recs.sparkSession))
              .withColumn("ratio", indel_ratio_here("rec_norm", "test_norm"))
              .filter(F.col("ratio") >= F.lit(float(preset.threshold)))
              .select("rec_id", "test_id"))
    near = pairs.filter(~equal).join(kernel, ["rec_id", "test_id"], "left_semi").select(*keep)
    return pairs.filter(equal).unionByName(near)


def match_recs(recs: DataFrame, test_titles: DataFrame, preset: Preset) -> DataFrame:
    """recs + ``rec_norm``, ``match`` (1 when any test title of the user is similar enough)."""
    ids, norms = title_ids(recs, test_titles, preset)
    hits = (matching_pairs(recs.select("UserID", "Title"), test_titles, preset, ids, norms)
            .select("UserID", "rec_id").distinct().withColumn("match", F.lit(1)))
    named = ids.select("Title", F.col("id").alias("rec_id")).join(norms.select(F.col("id").alias("rec_id"), F.col("norm").alias("rec_norm")), "rec_id")
    return (recs.join(named, "Title", "left").join(hits, ["UserID", "rec_id"], "left")
            .select("UserID", "rec_norm", "Title", *[c for c in recs.columns if c not in ("UserID", "Title")], F.coalesce(F.col("match"), F.lit(0)).alias("match")))


def matched_ranks(recs: DataFrame, test_titles: DataFrame, preset: Preset) -> DataFrame:
    """(UserID, Rank, match = 1) of the rows of ``recs`` that match, repeated rows repeated:
    what :func:`user_metrics` asks of :func:`match_recs`, without moving the other rows again."""
    ids, norms = title_ids(recs, test_titles, preset)
    pairs = matching_pairs(recs.select("UserID", "Rank", "Title"), test_titles, preset, ids, norms)
    # as many rows of a pair as there are rows of recs with this rank and string, whatever the test title
    copies = (pairs.repartition("UserID").groupBy("UserID", "Rank", "rec_id", "test_id").agg(F.count(F.lit(1)).alias("_n"))
              .groupBy("UserID", "Rank", "rec_id").agg(F.max("_n").alias("_n")))
    return copies.select("UserID", "Rank", F.explode(F.array_repeat(F.lit(1), F.col("_n").cast("int"))).alias("match"))


# --------------------------------------------------------------------------- metrics

def discounts(max_rank: int = max(CUTOFFS)) -> list[float]:
    """1 / log2(r + 1) for r = 1..max_rank, computed like the reference (math.log2)."""
    return [1 / math.log2(r + 1) for r in range(1, max_rank + 1)]


def ideal_prefix(max_rank: int = max(CUTOFFS)) -> list[float]:
    """Ideal DCG for n relevant items, n = 1..max_rank (sequential sums)."""
    out, acc = [], 0.0
    for d in discounts(max_rank):
        acc = acc + d
        out.append(acc)
    return out


def _lookup(values: Sequence[float], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), idx.cast("int"))


def user_metrics(matched: DataFrame, test_titles: DataFrame, users: DataFrame,
                 cutoffs: Sequence[int] = CUTOFFS) -> DataFrame:
    """(UserID, k, hr, ndcg, mrr) for every user of ``users`` and every cutoff.

    DCG adds a discount for every matching rec with Rank <= k (so nDCG can
    exceed 1); the ideal uses min(#test rows, k), duplicates counted.
    """
    disc = discounts(max(cutoffs))
    ideal = ideal_prefix(max(cutoffs))
    m = matched.filter(F.col("match") == 1)
    aggs = []
    for k in cutoffs:
        hit = F.col("Rank") <= k
        aggs += [F.max(F.when(hit, F.lit(1)).otherwise(F.lit(0))).alias(f"hr_{k}"),
                 F.sum(F.when(hit, _lookup(disc, F.col("Rank")))).alias(f"dcg_{k}"),
                 F.min(F.when(hit, F.col("Rank"))).alias(f"first_{k}")]
    per_user = m.groupBy("UserID").agg(*aggs)
    n_test = test_titles.groupBy("UserID").agg(F.count(F.lit(1)).alias("n_test"))
    base = users.select("UserID").distinct().join(n_test, "UserID", "left").join(per_user, "UserID", "left")
    rows = []
    for k in cutoffs:
        n_ideal = F.least(F.coalesce(F.col("n_test"), F.lit(0)), F.lit(k))
        idcg = F.when(n_ideal > 0, _lookup(ideal, n_ideal)).otherwise(F.lit(0.0))
        dcg = F.coalesce(F.col(f"dcg_{k}"), F.lit(0.0))
        rows.append(F.struct(F.lit(k).alias("k"),
                             F.coalesce(F.col(f"hr_{k}"), F.lit(0)).cast("double").alias("hr"),
                             F.when(idcg > 0, dcg / idcg).otherwise(F.lit(0.0)).alias("ndcg"),
                             F.coalesce(F.lit(1.0) / F.col(f"first_{k}"), F.lit(0.0)).alias("mrr")))
    return base.select("UserID", F.explode(F.array(*rows)).alias("m")).select("UserID", "m.*")


def population(preset: Preset, responded: DataFrame, recs: DataFrame, test_titles: DataFrame) -> DataFrame:
    """Users averaged over: every eligible user that got an answer (in-run scorer),
    or users with >= 1 parsed rec and >= 1 test title (offline evaluator)."""
    if preset.population == "responded":
        return responded.select("UserID").distinct()
    return (recs.select("UserID").distinct()
            .join(test_titles.select("UserID").distinct(), "UserID", "left_semi"))


def ranking_metrics(recs: DataFrame, test_titles: DataFrame, responded: DataFrame, preset: Preset,
                    cutoffs: Sequence[int] = CUTOFFS, digits: int | None = 6) -> DataFrame:
    """(k, hr, ndcg, mrr, n_users): means over the preset's population; 0.0 when empty."""
    users = population(preset, responded, recs, test_titles)
    # other users' rows need not be taken out first: the metrics of a user ask for that user's alone
    per = user_metrics(matched_ranks(recs, test_titles, preset), test_titles, users, cutoffs)
    ks = recs.sparkSession.createDataFrame([(int(k),) for k in cutoffs], "k int")
    agg = per.groupBy("k").agg(F.avg("hr").alias("hr"), F.avg("ndcg").alias("ndcg"), F.avg("mrr").alias("mrr"),
                               F.count(F.lit(1)).alias("n_users"))
    out = ks.join(agg, "k", "left")
    rnd = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return out.select("k", *[rnd(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in ("hr", "ndcg", "mrr")],
                      F.coalesce(F.col("n_users"), F.lit(0)).cast("long").alias("n_users"))


# --------------------------------------------------------------------------- statistics

def rec_totals(recs: DataFrame) -> DataFrame:
    """(total_recommendations, unique_items): raw titles, not normalised."""
    return recs.agg(F.count(F.lit(1)).alias("total_recommendations"),
                    F.count_distinct("Title").alias("unique_items"))


def rec_item_counts(recs: DataFrame) -> DataFrame:
    return recs.groupBy("Title").agg(F.count(F.lit(1)).alias("n"))


def rec_position_counts(recs: DataFrame) -> DataFrame:
    return recs.groupBy("Rank", "Title").agg(F.count(F.lit(1)).alias("n"))


def top_items(recs: DataFrame, n: int = 10) -> DataFrame:
    """Most recommended titles (ties by title): a top-k report, so the limit is the feature."""
    return rec_item_counts(recs).orderBy(F.col("n").desc(), F.col("Title").asc()).limit(n)


def top_by_position(recs: DataFrame, n: int = 5) -> DataFrame:
    """Top titles per rank; row_number() <= n becomes a per-partition group limit."""
    w = Window.partitionBy("Rank").orderBy(F.col("n").desc(), F.col("Title").asc())
    return (rec_position_counts(recs).withColumn("pos", F.row_number().over(w))
            .filter(F.col("pos") <= n).withColumn("pos", F.col("pos").cast("long")))


def short_rec_lists(recs: DataFrame, responded: DataFrame, expected: int = LIST_LENGTH) -> DataFrame:
    """(UserID, n_recs) for answered users with fewer than ``expected`` parsed recs."""
    counts = recs.groupBy("UserID").agg(F.count(F.lit(1)).alias("n_recs"))
    return (responded.select("UserID").distinct().join(counts, "UserID", "left")
            .select("UserID", F.coalesce(F.col("n_recs"), F.lit(0)).alias("n_recs"))
            .filter(F.col("n_recs") < expected))


def absent_items(recs: DataFrame, items: DataFrame) -> DataFrame:
    """(norm_title, n): normalised recommended titles missing from the catalogue."""
    per_title = recs.groupBy("Title").agg(F.count(F.lit(1)).alias("n"))
    freq = (per_title.select(normalize_title_clean(F.col("Title")).alias("norm_title"), "n")
            .groupBy("norm_title").agg(F.sum("n").alias("n")))
    catalogue = (items.select("Title").dropna().distinct()
                 .select(normalize_title_clean(F.col("Title")).alias("norm_title")).distinct())
    # left join + null filter instead of left_anti: an anti join would be pushed below the
    # two aggregates and normalise every recommendation row instead of every distinct title
    hit = catalogue.withColumn("_in_catalogue", F.lit(True))
    return (freq.join(hit, "norm_title", "left").filter(F.col("_in_catalogue").isNull())
            .drop("_in_catalogue"))


def absent_totals(absent: DataFrame) -> DataFrame:
    return absent.agg(F.count(F.lit(1)).alias("distinct_missing"),
                      F.coalesce(F.sum("n"), F.lit(0)).alias("total_missing"))


def fixed4(col: Column) -> Column:
    """'{:.4f}' text of a double, from the half-even scaled rounding (same digits in every engine)."""
    return F.format_string("%.4f", F.rint(col * 10000.0) / 10000.0)


# The lines of the offline evaluator's log, in their order.
LOG_CUTOFF = "Cutoff {k} -> HR@{k}: {hr}, nDCG@{k}: {ndcg}, MRR@{k}: {mrr}"
LOG_HEADER = "Evaluation Metrics with {threshold}% threshold:"
LOG_DICT = "Cutoff {k}: {{'HR@{k}': {hr}, 'nDCG@{k}': {ndcg}, 'MRR@{k}': {mrr}}}"
LOG_TOTALS = ("", "Overall Recommendation Statistics:", "Total recommendations: {total}", "Unique items recommended: {unique}",
              "Top recommended items:")
LOG_POSITIONS = ("", "Recommendation Frequency by Position:")
LOG_MISSING = ("Distinct recommended items missing from dataset: {distinct}", "Total missing recommendations (with duplicates): {total}")
LOG_SOME_MISSING = "Missing items and their counts:"
LOG_NONE_MISSING = "All recommended items are present in the dataset."


def _fill(template: str, **columns: Column) -> Column:
    """A line template with its places filled by columns."""
    out: Column = F.lit(template.replace("{{", "{").replace("}}", "}") if "{{" in template else template)
    for name, value in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def _counted(indent: str, name: str) -> Column:
    return F.concat(F.lit(indent), F.col(name), F.lit(": "), F.col("n").cast("string"), F.lit(" times"))


def fixed6(col: Column) -> Column:
    return F.format_string("%.6f", F.rint(col * 1000000.0) / 1000000.0)


def evaluation_log(metrics: DataFrame, recs: DataFrame, absent: DataFrame, similarity_threshold: float = 1) -> DataFrame:
    """(section, p1, p2, line): the offline evaluator's log, ordered by (section, p1, p2).

    Metrics per cutoff, the same again under a header (values with six places, where the
    text of a float depends on the library's version), totals, the 10 most recommended
    titles, the 5 most frequent titles per rank, and the absent items, all of them: their
    number is the model's to choose, so they are ranked over a range partitioning."""
    def rows(section: int, df: DataFrame, p1: Column, p2: Column, line: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), p1.cast("long").alias("p1"), p2.cast("long").alias("p2"), line.alias("line"))

    def listed(section: int, df: DataFrame, lines: list[Column]) -> DataFrame:
        return (df.select(F.posexplode(F.array(*lines)).alias("p1", "line"))
                .select(F.lit(section).alias("section"), F.col("p1").cast("long"), F.lit(0).cast("long").alias("p2"), "line"))

    zero = F.lit(0)
    k = F.col("k")
    form = lambda f: {"k": k, **{c: f(F.col(c)) for c in ("hr", "ndcg", "mrr")}}
    tot, at = rec_totals(recs), absent_totals(absent)
    totals = {"total": F.col("total_recommendations"), "unique": F.col("unique_items")}
    missing = {"distinct": F.col("distinct_missing"), "total": F.col("total_missing")}
    top = top_items(recs, 10).withColumn("p", F.row_number().over(Window.orderBy(F.col("n").desc(), F.col("Title").asc())))  # 10 rows
    pos = top_by_position(recs, 5)
    ranked = global_index(absent, [F.col("n").desc(), F.col("norm_title").asc()], "p", start=1)
    parts = [
        rows(0, metrics, k, zero, _fill(LOG_CUTOFF, **form(fixed4))),
        listed(1, tot, [F.lit(LOG_HEADER.format(threshold=similarity_threshold * 100))]),
        rows(2, metrics, k, zero, _fill(LOG_DICT, **form(fixed6))),
        listed(3, tot, [_fill(x, **totals) for x in LOG_TOTALS]),
        rows(4, top, F.col("p"), zero, _counted("  ", "Title")),
        listed(5, tot, [F.lit(x) for x in LOG_POSITIONS]),
        rows(6, pos.select("Rank").distinct(), F.col("Rank"), zero, F.concat(F.lit("Rank "), F.col("Rank").cast("string"), F.lit(":"))),
        rows(6, pos, F.col("Rank"), F.col("pos"), _counted("    ", "Title")),
        listed(7, at, [*[_fill(x, **missing) for x in LOG_MISSING],
                       F.when(F.col("distinct_missing") > 0, F.lit(LOG_SOME_MISSING)).otherwise(F.lit(LOG_NONE_MISSING))]),
        rows(8, ranked, zero, F.col("p"), _counted("  ", "norm_title")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
