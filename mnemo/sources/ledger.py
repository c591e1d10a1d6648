"""The append-only result ledger (Parquet, partitioned by model) and resume scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemo.functions.names import output_name


def append(results: DataFrame, path: str, model: str) -> None:
    """Append one batch of scored rows under ``model=<output name>``."""
    (results.withColumn("model", F.lit(output_name(model)))
     .write.mode("append").partitionBy("model").parquet(path))


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    r = spark.read
    if schema:
        r = r.schema(schema)
    return r.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything was written at ``path``; a store that can't be asked raises."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def pending(rows: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the ledger yet (batch ids are computed before this)."""
    return rows.join(ledger.select(key).distinct(), key, "left_anti")


def of_model(ledger: DataFrame, model: str) -> DataFrame:
    """The rows that ``append`` has written for ``model``."""
    return ledger.filter(F.col("model") == output_name(model))


def processed_keys(ledger: DataFrame, key: str) -> DataFrame:
    return ledger.select(key).distinct()
