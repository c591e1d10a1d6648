"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemo.session import scratch_path

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*columns)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back: lineage is
    cut and a lost executor costs only the tasks that were running."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = "_" + name
    return name


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_unit(*parts: Column) -> Column:
    """A fixed pseudo-random integer in [0, 2**32) from the parts' text: the first
    eight hex digits of an MD5, so any SQL engine gets the same one."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def packed(df: DataFrame, used: list[str]) -> DataFrame:
    """``used`` and all other columns as one struct, ``_others``, so that whatever they are
    called they meet no name inside an operator. ``unpacked`` is the way back."""
    others = [c for c in df.columns if c not in used]
    return df.select(*used, F.struct(*[F.col(f"`{c}`") for c in others] or [F.lit(None).cast("string").alias("none")]).alias("_others"))


def unpacked(df: DataFrame, columns: list[str], used: list[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in used else F.col("_others").getField(c).alias(c) for c in columns])
