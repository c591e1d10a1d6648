"""Resumable scoring on Structured Streaming.

New response files are scored once and appended to the ledger. The set of
processed keys lives in the ledger table itself (each micro-batch anti-joins
against it), not in unbounded streaming state, and the checkpoint location
makes a rerun skip files already committed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemo.sources import ledger as L


def score_stream(spark: SparkSession, responses_dir: str, response_schema: str,
                 score: Callable[[DataFrame], DataFrame], ledger_path: str, checkpoint: str,
                 key: str, model: str) -> None:
    """Score every response file in ``responses_dir`` exactly once (availableNow)."""
    stream = spark.readStream.schema(response_schema).parquet(responses_dir)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        # one answer per key (the least by text, so reruns agree), and only keys that the
        # ledger lacks: both before scoring, which is the dear part
        rest = [c for c in batch.columns if c != key]
        fresh = batch.groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, "_r.*")
        if L.exists(spark, ledger_path):
            done = L.of_model(L.read(spark, ledger_path), model)
            fresh = L.pending(fresh, done, key)
        L.append(score(fresh), ledger_path, model)

    q = (stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def coverage_stream(spark: SparkSession, ledger_path: str, ledger_schema: str, out_path: str, checkpoint: str) -> None:
    """Running coverage per model over the ledger (complete mode, tiny result)."""
    agg = (spark.readStream.schema(ledger_schema).parquet(ledger_path)
           .groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("ErrorFlag").cast("long").alias("errors")))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out_path)

    q = (agg.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
