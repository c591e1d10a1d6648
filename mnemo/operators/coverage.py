"""Coverage reports: share of correct answers over prefixes and buckets of a
ranked result table.

Input convention: a DataFrame with a dense 1-based ``rank`` and an int
``ErrorFlag``. Cut points depend only on the row count N, so they are computed
on the driver from one count; the error counts at the cuts come from one
conditional aggregate (no window, no shuffle beyond partial sums) or, for many
cuts, from the two-level prefix sum joined on the cut.

Every report returns rows ``(ord, first_item, last_item, errors, correct, size,
coverage, line)``; invalid parameters give a row with null numbers and the
message in ``line``, as the reference does.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from mnemo.functions import report as R
from mnemo.functions.text import rint2
from mnemo.operators.positions import global_index, prefix_sum

REPORT_SCHEMA = StructType([
    StructField("ord", LongType()), StructField("first_item", LongType()),
    StructField("last_item", LongType()), StructField("errors", LongType()),
    StructField("correct", LongType()), StructField("size", LongType()),
    StructField("coverage", DoubleType()), StructField("line", StringType()),
])
MANY_CUTS = 64
RANK, FLAG = "rank", "ErrorFlag"


def coverage_value(correct, size):
    """round((correct / size) * 100, 2) with numpy rounding; 0.0 for an empty slice."""
    c, n = F.col(correct) if isinstance(correct, str) else correct, F.col(size) if isinstance(size, str) else size
    return F.when(n > 0, rint2((c.cast("double") / n.cast("double")) * 100.0)).otherwise(F.lit(0.0))


# --------------------------------------------------------------------------- ranking

def rank_results(results: DataFrame, order_col: str, dense: bool = False) -> DataFrame:
    """Attach the 1-based ``rank`` of each result row in ``order_col`` order.

    With ``dense=True`` the order column already is a 0-based position 0..N-1.
    """
    if dense:
        return results.withColumn(RANK, F.col(order_col).cast("long") + 1)
    return global_index(results, [order_col], RANK, start=1)


def dedupe_results(results: DataFrame, order_col: str | None = None) -> DataFrame:
    """One ErrorFlag per MovieID; the latest row wins when an order is known,
    otherwise the pessimistic one (error)."""
    flag = F.max_by(FLAG, order_col) if order_col else F.max(FLAG)
    return results.groupBy("MovieID").agg(flag.cast("int").alias(FLAG))


def popularity_merge(results: DataFrame, popularity: DataFrame, order_col: str | None = None) -> DataFrame:
    """popularity LEFT JOIN results on MovieID; a missing result counts as an error.
    ``popularity`` carries the popularity rank as ``PopRank`` (1-based)."""
    res = dedupe_results(results, order_col)
    return (popularity.join(res, "MovieID", "left")
            .select("MovieID", F.col("PopRank").alias(RANK),
                    F.coalesce(F.col(FLAG), F.lit(1)).cast("int").alias(FLAG)))


# --------------------------------------------------------------------------- cut sums

def errors_at(ranked: DataFrame, cuts: Sequence[int]) -> DataFrame:
    """(cut, errors): errors among ranks <= cut, for each distinct cut (cut 0 -> 0)."""
    spark = ranked.sparkSession
    cuts = sorted({int(c) for c in cuts if c > 0})
    if not cuts:
        return spark.createDataFrame([], "cut long, errors long")
    if len(cuts) <= MANY_CUTS:
        flag, rank = F.col(FLAG).cast("long"), F.col(RANK)
        structs = [F.struct(F.lit(c).cast("long").alias("cut"),
                            F.coalesce(F.sum(F.when(rank <= c, flag).otherwise(F.lit(0))), F.lit(0)).cast("long").alias("errors"))
                   for c in cuts]
        return ranked.agg(F.array(*structs).alias("a")).select(F.explode("a").alias("s")).select("s.cut", "s.errors")
    # the cuts join the rows as points of their own, so a cut between two ranks counts too
    points = spark.createDataFrame([(c, 0, 1) for c in cuts], "at long, flag long, wanted int")
    rows = ranked.select(F.col(RANK).cast("long").alias("at"), F.col(FLAG).cast("long").alias("flag"), F.lit(0).alias("wanted"))
    per_rank = rows.unionByName(points).groupBy("at").agg(F.sum("flag").alias("flag"), F.max("wanted").alias("wanted"))
    return (prefix_sum(per_rank, "flag", "at", "errors").filter(F.col("wanted") == 1)
            .select(F.col("at").alias("cut"), "errors"))


def _entries(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    schema = "ord long, first_item long, last_item long, msg string"
    return spark.createDataFrame(rows, schema)


def _count(ranked: DataFrame) -> int:
    return ranked.count()


def _empty(spark: SparkSession, message: str) -> DataFrame:
    return spark.createDataFrame([(1, None, None, None, None, None, None, message)], REPORT_SCHEMA)


def _prefix_report(ranked: DataFrame, n: int, labels: list[tuple[int, str | None, int | None]],
                   template: tuple[str, ...], total_suffix: bool) -> DataFrame:
    """Rows for prefix cuts. ``labels``: (ord, label or None when invalid, cut)."""
    spark = ranked.sparkSession
    # labels: (ord, label, cut) for a valid entry, (ord, None, message) for an invalid one
    entries = _entries(spark, [(o, 1, c, None) if lab is not None else (o, None, None, c) for o, lab, c in labels])
    errs = errors_at(ranked, [c for _, lab, c in labels if lab is not None] + [n])
    label_of = {o: lab for o, lab, _ in labels}
    lab_df = spark.createDataFrame([(o, label_of[o]) for o in label_of], "ord long, label string")
    body = (entries.join(lab_df, "ord").join(errs.withColumnRenamed("cut", "last_item"), "last_item", "left")
            .withColumn("size", F.col("last_item"))
            .withColumn("correct", F.col("size") - F.col("errors")))
    if len(template) == 4:          # "Coverage at {p}th ...: c% | Errors: e | Correct: k | Total: n"
        head = F.replace(F.lit(template[0]), F.lit("{p}"), F.col("label"))
        line = R.text(head, coverage_value("correct", "size"), template[1], F.col("errors"), template[2],
                      F.col("correct"), template[3], F.col("size"))
    else:                           # "Coverage at n items: ..."
        line = R.text(template[0], F.col("size"), template[1], coverage_value("correct", "size"), template[2],
                      F.col("errors"), template[3], F.col("correct"), template[4], F.col("size"))
    body = body.select(
        "ord", "first_item", "last_item",
        F.when(F.col("label").isNotNull(), F.col("errors")).alias("errors"),
        F.when(F.col("label").isNotNull(), F.col("correct")).alias("correct"),
        F.when(F.col("label").isNotNull(), F.col("size")).alias("size"),
        F.when(F.col("label").isNotNull(), coverage_value("correct", "size")).alias("coverage"),
        F.when(F.col("label").isNotNull(), line).otherwise(F.col("msg")).alias("line"))
    total = (errs.filter(F.col("cut") == n)
             .select(F.lit(len(labels) + 1).cast("long").alias("ord"), F.lit(1).cast("long").alias("first_item"),
                     F.lit(n).cast("long").alias("last_item"), F.col("errors"),
                     (F.lit(n) - F.col("errors")).alias("correct"), F.lit(n).cast("long").alias("size")))
    total = total.withColumn("coverage", coverage_value("correct", "size"))
    tline = R.text(R.TOTAL_LINE[0], F.col("coverage"), R.TOTAL_LINE[1], F.col("errors"))
    if total_suffix:
        tline = R.text(tline, R.TOTAL_ITEMS_SUFFIX, F.lit(n))
    return body.unionByName(total.withColumn("line", tline))


def _percentile_labels(n: int, percentiles: Sequence[float], invalid_msg: str):
    out = []
    for i, p in enumerate(percentiles, start=1):
        if p < 0 or p > 100:
            out.append((i, None, invalid_msg.format(p=R.py_number(p))))
        else:
            out.append((i, R.py_number(p), max(1, int((p / 100) * n))))
    return out


# --------------------------------------------------------------------------- reports

def coverage_percentiles(ranked: DataFrame, percentiles: Sequence[float] = (25, 50, 75, 100)) -> DataFrame:
    """Coverage of the first p % of result rows (analyze_results)."""
    n = _count(ranked)
    if n == 0:
        return _empty(ranked.sparkSession, R.NO_RESULTS)
    return _prefix_report(ranked, n, _percentile_labels(n, percentiles, R.INVALID_PERCENTILE),
                          R.PERCENTILE_LINE, total_suffix=False)


def coverage_popularity(merged: DataFrame, percentiles: Sequence[float] = (25, 50, 75, 100)) -> DataFrame:
    """Coverage of the p % most popular items (analyze_results_popularity);
    ``merged`` comes from :func:`popularity_merge`."""
    n = _count(merged)
    if n == 0:
        return _empty(merged.sparkSession, R.NO_ITEMS)
    return _prefix_report(merged, n, _percentile_labels(n, percentiles, R.INVALID_PERCENTILE),
                          R.POPULARITY_LINE, total_suffix=False)


def coverage_curve(merged: DataFrame, item_counts: Sequence[int] | None = None) -> DataFrame:
    """Coverage at every item count 1..N, or at the given counts
    (analyze_results_aggregate_popularity)."""
    spark = merged.sparkSession
    n = _count(merged)
    if n == 0:
        return _empty(spark, R.NO_ITEMS)
    if item_counts is not None:
        labels = []
        for i, c in enumerate(item_counts, start=1):
            if c < 1 or c > n:
                labels.append((i, None, R.INVALID_COUNT.format(c=R.py_number(c), n=n)))
            else:
                labels.append((i, "", int(c)))
        return _prefix_report(merged, n, labels, R.ITEMS_LINE, total_suffix=True)
    # every prefix: one row per item from the two-level running sum
    pref = prefix_sum(merged, FLAG, RANK, "errors")
    body = pref.select(F.col(RANK).alias("ord"), F.lit(1).cast("long").alias("first_item"),
                       F.col(RANK).alias("last_item"), F.col("errors"),
                       (F.col(RANK) - F.col("errors")).alias("correct"), F.col(RANK).alias("size"))
    body = body.withColumn("coverage", coverage_value("correct", "size"))
    body = body.withColumn("line", R.text(R.ITEMS_LINE[0], F.col("size"), R.ITEMS_LINE[1], F.col("coverage"),
                                          R.ITEMS_LINE[2], F.col("errors"), R.ITEMS_LINE[3], F.col("correct"),
                                          R.ITEMS_LINE[4], F.col("size")))
    total = (body.filter(F.col("last_item") == n)
             .withColumn("ord", F.lit(n + 1).cast("long")))
    total = total.withColumn("line", R.text(R.TOTAL_LINE[0], F.col("coverage"), R.TOTAL_LINE[1], F.col("errors"),
                                            R.TOTAL_ITEMS_SUFFIX, F.lit(n)))
    return body.unionByName(total)


def bucket_ends(n: int, item_counts: Sequence[int] | None, bucket_size: int,
                percentile_buckets: Sequence[float] | None) -> list[int] | None:
    """Bucket end indices; None means regular buckets of ``bucket_size``."""
    if percentile_buckets:
        for p in percentile_buckets:
            if p <= 0 or p > 1:
                raise ValueError(f"Percentile {p} is out of valid range (0,1].")
        ends = [min(max(int(math.ceil(n * p)), 1), n) for p in percentile_buckets]
        if ends[-1] != n:
            ends[-1] = n
        return ends
    if item_counts is not None:
        return [int(c) for c in item_counts]
    return None


def coverage_buckets(ranked: DataFrame, item_counts: Sequence[int] | None = None, bucket_size: int = 5,
                     percentile_buckets: Sequence[float] | None = None, empty_message: str | None = None) -> DataFrame:
    """Coverage per bucket of consecutive ranks (analyze_results_by_buckets /
    analyze_results_by_popularity_buckets)."""
    spark = ranked.sparkSession
    n = _count(ranked)
    if n == 0 and empty_message:
        return _empty(spark, empty_message)
    ends = bucket_ends(n, item_counts, bucket_size, percentile_buckets)
    if ends is None:
        body = _regular_buckets(ranked, n, bucket_size)
        n_rows = -(-n // bucket_size) if n else 0
    else:
        body = _explicit_buckets(ranked, n, ends)
        n_rows = len(ends)
    # an aggregate without groups: an empty table has its total line as well, with zeros
    tot = ranked.agg(F.coalesce(F.sum(F.col(FLAG).cast("long")), F.lit(0)).alias("errors")).select(
        F.lit(n_rows + 1).cast("long").alias("ord"), F.lit(1).cast("long").alias("first_item"),
        F.lit(n).cast("long").alias("last_item"), F.col("errors"),
        (F.lit(n) - F.col("errors")).alias("correct"), F.lit(n).cast("long").alias("size"))
    tot = tot.withColumn("coverage", coverage_value("correct", "size"))
    tot = tot.withColumn("line", R.text(R.BUCKET_TOTAL_LINE[0], F.lit(n), R.BUCKET_TOTAL_LINE[1], F.col("coverage"),
                                        R.BUCKET_TOTAL_LINE[2], F.col("errors")))
    return body.unionByName(tot)


def _bucket_line(first, last):
    return R.text(R.BUCKET_LINE[0], first, R.BUCKET_LINE[1], last, R.BUCKET_LINE[2], F.col("coverage"),
                  R.BUCKET_LINE[3], F.col("errors"), R.BUCKET_LINE[4], F.col("correct"), R.BUCKET_LINE[5], F.col("size"))


def _regular_buckets(ranked: DataFrame, n: int, size: int) -> DataFrame:
    """Buckets [1..s], [s+1..2s], ..., last one ends at N; grouped in Spark."""
    b = F.ceil(F.col(RANK) / F.lit(size)).cast("long")
    g = ranked.groupBy(b.alias("ord")).agg(F.sum(F.col(FLAG).cast("long")).alias("errors"),
                                           F.count(F.lit(1)).alias("size"))
    g = g.select("ord", ((F.col("ord") - 1) * size + 1).alias("first_item"),
                 F.least(F.col("ord") * size, F.lit(n)).cast("long").alias("last_item"),
                 "errors", (F.col("size") - F.col("errors")).alias("correct"), "size")
    g = g.withColumn("coverage", coverage_value("correct", "size"))
    return g.withColumn("line", _bucket_line(F.col("first_item"), F.col("last_item")))


def _explicit_buckets(ranked: DataFrame, n: int, ends: list[int]) -> DataFrame:
    """Buckets (previous valid end, end]; a non-ascending end gives an empty slice."""
    spark = ranked.sparkSession
    rows, last = [], 0
    for i, c in enumerate(ends, start=1):
        if c < 1 or c > n:
            rows.append((i, None, None, R.INVALID_COUNT.format(c=R.py_number(c), n=n)))
            continue
        rows.append((i, last, c, None))
        last = c
    entries = spark.createDataFrame(rows, "ord long, lo long, hi long, msg string")
    errs = errors_at(ranked, [r[1] for r in rows if r[1]] + [r[2] for r in rows if r[2]])
    e_lo = errs.select(F.col("cut").alias("lo"), F.col("errors").alias("e_lo"))
    e_hi = errs.select(F.col("cut").alias("hi"), F.col("errors").alias("e_hi"))
    j = entries.join(e_lo, "lo", "left").join(e_hi, "hi", "left").withColumn("valid", F.col("hi").isNotNull())
    valid = F.col("valid")
    size = F.greatest(F.col("hi") - F.col("lo"), F.lit(0))
    errors = F.when(F.col("hi") > F.col("lo"), F.coalesce(F.col("e_hi"), F.lit(0)) - F.coalesce(F.col("e_lo"), F.lit(0))).otherwise(F.lit(0))
    j = j.select("ord", "valid", F.when(valid, F.col("lo") + 1).alias("first_item"), F.col("hi").alias("last_item"),
                 F.when(valid, errors).cast("long").alias("errors"), F.when(valid, size).cast("long").alias("size"), "msg")
    j = j.withColumn("correct", F.col("size") - F.col("errors"))
    j = j.withColumn("coverage", F.when(valid, coverage_value("correct", "size")))
    line = F.when(valid, _bucket_line(F.col("first_item"), F.col("last_item"))).otherwise(F.col("msg"))
    return j.withColumn("line", line).select(*REPORT_SCHEMA.fieldNames())
