"""Reference-shaped tables derived from the driver's parquet inputs.

The reference reads items / interactions / users CSVs and model answers. The
driver ships TPC-H-like tables instead, so these functions derive the same
logical tables from them (the definitions are the views in FIXTURES.md). Row
order, which the reference takes from the file, is an explicit ``RowIndex``.

Derived tables are cached per session: ``interactions`` needs a written
global order, and every query that reads it can reuse the written partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemo.operators.positions import global_index

_CACHE: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def _cached(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    key = (id(spark), spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    if key not in _CACHE:
        _CACHE[key] = build()
    return _CACHE[key]


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(MovieID, Title) from ``part``."""
    p = table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand"])
    year = (F.lit(1950) + F.col("p_partkey") % 70).cast("string")
    return p.select(F.col("p_partkey").cast("long").alias("MovieID"),
                    F.concat(F.col("p_name"), F.lit(" "), F.col("p_brand"), F.lit(" ("), year, F.lit(")")).alias("Title"))


def items_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with their 0-based table position ``ItemPos`` (MovieID order)."""
    return _cached(spark, sf_dir, "items_ordered",
                   lambda: global_index(items(spark, sf_dir), ["MovieID"], "ItemPos"))


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(UserID, MovieID, RowIndex): one row per line item, in order-date order."""
    def build():
        o = table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
        li = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
        j = li.join(o, li.l_orderkey == o.o_orderkey)
        ranked = global_index(j, ["o_orderdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "RowIndex",
                              keep=["o_custkey", "l_partkey"])
        return ranked.select(F.col("o_custkey").cast("long").alias("UserID"),
                             F.col("l_partkey").cast("long").alias("MovieID"), "RowIndex")
    return _cached(spark, sf_dir, "interactions", build)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(UserID, Gender, Age, Occupation, Zip_code, RowIndex) from ``customer``."""
    def build():
        c = table(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment", "c_nationkey"])
        u = c.select(
            F.col("c_custkey").cast("long").alias("UserID"),
            F.substring("c_mktsegment", 1, 1).alias("Gender"),
            F.col("c_nationkey").cast("int").alias("Age"),
            (F.col("c_custkey") % 21).cast("int").alias("Occupation"),
            F.lpad(((F.col("c_custkey") * 37) % 100000).cast("string"), 5, "0").alias("Zip_code"))
        return global_index(u, ["UserID"], "RowIndex")
    return _cached(spark, sf_dir, "users", build)


def title_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic stand-in answers for the title probe: (MovieID, output)."""
    it = items(spark, sf_dir)
    m = F.col("MovieID") % 7
    t = F.col("Title")
    out = (F.when(m == 0, F.lit("Unknown"))
           .when(m == 1, t)
           .when(m == 2, F.concat(F.col("MovieID").cast("string"), F.lit("::"), t))
           .when(m == 3, F.upper(t))
           .when(m == 4, F.expr("substr(Title, 1, length(Title) - 2)"))
           .when(m == 5, F.expr("substr(Title, 1, length(Title) - 7)"))
           .otherwise(F.lit(None).cast("string")))
    return it.select("MovieID", out.alias("output"))


def interaction_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(RowIndex, output) for the next-interaction probes."""
    i = interactions(spark, sf_dir)
    m = F.col("RowIndex") % 4
    u, mv = F.col("UserID").cast("string"), F.col("MovieID")
    out = (F.when(m == 0, F.concat(u, F.lit("::"), mv.cast("string")))
           .when(m == 1, F.concat(u, F.lit("::"), (mv + 1).cast("string")))
           .when(m == 2, F.lit("Unknown"))
           .otherwise(F.lit("content_filter_high")))
    return i.select("RowIndex", out.alias("output"))


def user_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(RowIndex, output) for the user-attribute probe."""
    u = users(spark, sf_dir)
    m = F.col("RowIndex") % 3
    head = F.concat_ws("::", F.col("UserID").cast("string"), "Gender", F.col("Age").cast("string"),
                       F.col("Occupation").cast("string"))
    out = (F.when(m == 0, F.concat(head, F.lit("::"), F.col("Zip_code")))
           .when(m == 1, F.concat(head, F.lit("::00000")))
           .otherwise(F.lit("Unknown")))
    return u.select("RowIndex", out.alias("output"))


def rec_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(UserID, r, Title): the ranked titles a stand-in recommender returns.

    Users with ``UserID % 25 = 3`` get no answer (a failed call) and users with
    ``UserID % 10 = 0`` get a short list of 30. About 1 % of the titles are invented
    (``(UserID + r) % 97 = 0``, or an id missing from the catalogue): the absent-item check.
    """
    n_items = _cached(spark, sf_dir, "n_parts", lambda: table(spark, sf_dir, "part", ["p_partkey"]).count())
    us = (interactions(spark, sf_dir).select("UserID").distinct()
          .filter(F.col("UserID") % 25 != 3))
    upto = F.when(F.col("UserID") % 10 == 0, F.lit(30)).otherwise(F.lit(50))
    lines = us.select("UserID", F.explode(F.sequence(F.lit(1), upto)).alias("r"))
    lines = lines.withColumn("MovieID", (F.col("UserID") * 31 + F.col("r") * 17) % F.lit(n_items))
    invented = F.concat(F.lit("Lost Film "), F.col("r").cast("string"), F.lit(" ("),
                        (F.lit(1960) + F.col("UserID") % 50).cast("string"), F.lit(")"))
    title = (F.when(((F.col("UserID") + F.col("r")) % 97 == 0) | F.col("Title").isNull(), invented)
             .otherwise(F.col("Title")))
    return (lines.join(items(spark, sf_dir), "MovieID", "left")
            .select("UserID", F.col("r").cast("int").alias("r"), title.alias("Title")))


def rec_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(UserID, output): raw list text with a heading and a blank line first; null for a
    failed call. Every 40th list ends with lines whose rank is 0 or fits no integer, and a
    line that repeats a rank."""
    lines = rec_lines(spark, sf_dir)
    entry = F.struct(F.col("r"), F.concat(F.col("r").cast("string"), F.lit(". "), F.col("Title")).alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda s: s["line"]), "\n")
    odd = F.when(F.col("UserID") % 40 == 1, F.concat(
        F.lit("\n0. No such rank\n99999999999999999999. Beyond any rank\n7. "), F.min("Title"))).otherwise(F.lit(""))
    good = lines.groupBy("UserID").agg(F.concat(F.lit("Here is the list\n\n"), body, odd).alias("output"))
    failed = (interactions(spark, sf_dir).select("UserID").distinct().filter(F.col("UserID") % 25 == 3)
              .select("UserID", F.lit(None).cast("string").alias("output")))
    return good.unionByName(failed)


def raw_user_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``::``-delimited user records as raw text lines (value STRING).

    Every 13th user is cut to two fields (rejected when five are kept), every
    11th is padded with whitespace and every 9th quotes its segment letter.
    """
    u = users(spark, sf_dir)
    gender = F.when(F.col("UserID") % 9 == 0, F.concat(F.lit('"'), F.col("Gender"), F.lit('" x'))).otherwise(F.col("Gender"))
    full = F.concat_ws("::", F.col("UserID").cast("string"), gender, F.col("Age").cast("string"),
                       F.col("Occupation").cast("string"), F.col("Zip_code"))
    line = (F.when(F.col("UserID") % 13 == 0, F.concat_ws("::", F.col("UserID").cast("string"), gender))
            .when(F.col("UserID") % 11 == 0, F.concat(F.lit(" \t"), full, F.lit("  ")))
            .otherwise(full))
    return u.select("RowIndex", line.alias("value"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) with line breaks folded, the input of the charset decoder."""
    d = table(spark, sf_dir, "documents", ["doc_id", "text"])
    return d.select("doc_id", F.regexp_replace("text", r"[\r\n]+", " ").alias("text"))
