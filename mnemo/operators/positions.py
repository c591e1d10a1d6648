"""Row order as data: global indexes, prefix sums and per-group positions.

The reference relies on pandas row order. Here every order is an explicit
column, and nothing uses an un-partitioned window over the whole input:

* ``global_index`` range-partitions on a total order and writes the sorted
  partitions as Parquet files; a row's index is the rows in the files before its own
  (one number a file, counted without reading a column) and its place in its file,
  which the scan knows. Range partitioning splits a hot leading key because the full
  key is unique, and what reads the index afterwards reads the columns that it needs.
* ``prefix_sum`` is two-level: rows are cut into buckets of ``bucket`` consecutive
  order values, bucket totals get a running offset (one row per bucket), and the
  running sum inside a bucket is a window bounded by the bucket size. Group
  columns are allowed: only groups of more than ``bucket`` rows (at most one for each
  ``bucket`` rows of the table) are cut, so a group holding a third of all rows is still
  split into bounded buckets, and the many small groups need one shuffle and no totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemo.session import staged

DEFAULT_BUCKET = 1 << 17


def _cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def global_index(df: DataFrame, order: Sequence, out_col: str, start: int = 0,
                 num_partitions: int | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """Add a dense index (``start``, ``start+1``, ...) following ``order``.

    ``order`` must be a total order (ties get an arbitrary but fixed order). With ``keep``
    only these columns are written and returned, so keys that nothing reads later cost no disk.
    """
    keys = _cols(order)
    own = [c for c in df.columns if c.lower() == "_metadata"]  # would hide what the scan knows of its files
    # without an explicit count AQE may merge adjacent range partitions (order is kept),
    # so small inputs get few tasks and large ones keep spark.sql.shuffle.partitions
    ranged = df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys)
    sorted_ = ranged.sortWithinPartitions(*keys)
    sorted_ = (sorted_.select(*keep) if keep else sorted_).withColumnsRenamed({c: "_mn_own" for c in own})
    rows = staged(sorted_, "ordered")  # a file a partition, named in their order
    tagged = rows.withColumns({"_mn_file": F.col("_metadata.file_name"), "_mn_at": F.col("_metadata.row_index")})
    counts = rows.groupBy(F.col("_metadata.file_name").alias("_mn_file")).agg(F.count(F.lit(1)).alias("_mn_n"))
    before = Window.orderBy("_mn_file").rowsBetween(Window.unboundedPreceding, -1)
    # one row per file: the size of the broadcast is bounded by the number of partitions
    offsets = counts.select("_mn_file", F.coalesce(F.sum("_mn_n").over(before), F.lit(0)).alias("_mn_off"))
    return (tagged.join(F.broadcast(offsets), "_mn_file")
            .withColumn(out_col, (F.col("_mn_off") + F.col("_mn_at") + F.lit(start)).cast("long"))
            .drop("_mn_file", "_mn_at", "_mn_off").withColumnsRenamed({"_mn_own": c for c in own}))


def prefix_sum(df: DataFrame, value, order_col: str, out_col: str,
               group_cols: Sequence[str] = (), inclusive: bool = True,
               bucket: int = DEFAULT_BUCKET, size_col: str | None = None) -> DataFrame:
    """Running sum of ``value`` in ``order_col`` order (within ``group_cols``).

    ``order_col`` is a non-negative long, unique within a group (a row index). Rows that
    have no order, or a null in a group column, are left out. ``size_col`` adds the number
    of rows of the group (with ``group_cols`` only).
    """
    g = list(group_cols)
    val = F.col(value) if isinstance(value, str) else value
    d = df.withColumn("_mn_v", val.cast("long"))
    place = F.floor(F.col(order_col) / F.lit(bucket)).cast("long")
    for c in (*g, order_col):
        d = d.filter(F.col(c).isNotNull())
    if g:
        large = (d.groupBy(*g).agg(F.count(F.lit(1)).alias("_mn_n"))
                 .filter(F.col("_mn_n") > bucket))  # at most one for each ``bucket`` rows
        d = d.join(F.broadcast(large), g, "left").withColumn("_mn_bk", F.when(F.col("_mn_n").isNotNull(), place).otherwise(F.lit(-1)))
        cut = d.filter(F.col("_mn_n").isNotNull())
    else:
        d = cut = d.withColumn("_mn_bk", place)
    totals = cut.groupBy(*g, "_mn_bk").agg(F.sum("_mn_v").alias("_mn_bt"))
    w_off = Window.partitionBy(*g).orderBy("_mn_bk").rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select(*g, "_mn_bk", F.coalesce(F.sum("_mn_bt").over(w_off), F.lit(0)).alias("_mn_off"))
    w = Window.partitionBy(*g, "_mn_bk")
    w_in = w.orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    d = d.withColumn("_mn_in", F.coalesce(F.sum("_mn_v").over(w_in), F.lit(0)))
    if size_col:
        d = d.withColumn(size_col, F.coalesce(F.col("_mn_n"), F.count(F.lit(1)).over(w)))
    return (d.join(offs, [*g, "_mn_bk"], "left")
            .withColumn(out_col, (F.col("_mn_in") + F.coalesce(F.col("_mn_off"), F.lit(0))).cast("long"))
            .drop("_mn_v", "_mn_n", "_mn_bk", "_mn_in", "_mn_off"))


def index_within_group(df: DataFrame, group_cols: Sequence[str], order_col: str, out_col: str,
                       start: int = 0, bucket: int = DEFAULT_BUCKET, size_col: str | None = None) -> DataFrame:
    """Dense position of each row inside its group, in ``order_col`` order; ``size_col`` as
    in :func:`prefix_sum`."""
    out = prefix_sum(df, F.lit(1), order_col, "_mn_cnt", group_cols, inclusive=False, bucket=bucket, size_col=size_col)
    return out.withColumn(out_col, (F.col("_mn_cnt") + F.lit(start)).cast("long")).drop("_mn_cnt")


def position_in_group(df: DataFrame, group_cols: Sequence[str], order_col: str, out_col: str) -> DataFrame:
    """Dense 0-based position of each row inside its group, for orders that are sparse
    within a group: positions of the order (group, order) less the group's first, so a
    group holding any share of the rows is cut by the range partitioning."""
    g = list(group_cols)
    ranked = global_index(df, [*g, order_col], "_mn_all")
    first = ranked.groupBy(*g).agg(F.min("_mn_all").alias("_mn_first"))
    return ranked.join(first, g).withColumn(out_col, F.col("_mn_all") - F.col("_mn_first")).drop("_mn_all", "_mn_first")


def batch_ids(df: DataFrame, pos_col: str, batch_size: int, out_col: str = "batch") -> DataFrame:
    """``floor(pos / batch_size)`` for a 0-based position."""
    return df.withColumn(out_col, F.floor(F.col(pos_col) / F.lit(batch_size)).cast("long"))
