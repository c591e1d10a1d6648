"""Session helpers: building a session for tests/bench and locating shared storage.

Lineage is cut by writing Parquet files below the folder named by
``spark.checkpoint.dir``. On a cluster that setting points at shared storage and
is read from the session; only when it is unset on a local master (unit tests, ad-hoc
runs) do we create a local folder ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "mnemo",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Session for tests and the bench; on a cluster use the cluster's own session."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("MNEMO_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint root, creating a local one only when unset."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not root:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="mnemo-ckpt-")  # one machine: driver and tasks share it
        sc.setCheckpointDir(root)
    if not root:
        root = sc.getCheckpointDir()
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint root for files written by a job."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/mnemo-scratch/{uuid.uuid4().hex}/{name}"


def cpu_partitions(spark: SparkSession) -> int:
    """Partitions for stages whose work is far larger than their bytes: a set number, which
    keeps AQE from merging them into a few tasks."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder as Parquet and read it back: lineage is cut, a
    lost executor costs only the tasks that were running, and later scans are pruned."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame) -> DataFrame:
    """A shared intermediate table, written eagerly: later stages read its files, so a lost
    executor recomputes from them instead of replaying the whole lineage. Files of columns
    take a fraction of a checkpoint's rows, and what reads them reads the columns it needs."""
    return staged(df, "kept")
