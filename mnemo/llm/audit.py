"""Interaction audit of filters, as a stream with retractions.

Filters A to D look at a text alone; filter E fails a document whose text a smaller id
has too, so whether a row fails it may change with every file that arrives. The files of
the table are processed as available-now micro-batches: each batch reduces its rows to
counts by text, part and mask inside its tasks, and a state keyed by the text holds the
least id so far and the counts of the rows under it. When a smaller id arrives, those
rows are retracted from the counters under their earlier mask and counted again with E.
What the stream writes are differences of part counters; their sums are the counts of
documents by (part, mask of failed filters, labels), from which every order of the filters
follows by arithmetic, without going over the documents again.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import permutations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mnemo.llm.common import WORD, staged
from mnemo.session import ensure_checkpoint_dir, scratch_path

FILTERS = "ABCDE"
REPEATED = 1 << FILTERS.index("E")
GOOD, TOXIC = 32, 64
#: Rows of the table for each state value.
TEXTS = 1000

_COUNTS = "bucket int, high long, low long, id long, part string, mask int, n long, at_least long"
_STATE = "known binary"
_CHANGE = "part string, mask int, n long"
#: What is known of texts: (high, low) -> (least id, {(part, mask): rows under it}).
Known = dict[tuple[int, int], tuple[int, dict[tuple[str, int], int]]]


def with_failed(docs: DataFrame, text: str, out: str) -> DataFrame:
    """``docs`` with the bits of the filters A to D that a text fails, in place of the text.
    Words are compared with case."""
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    shouts, signs = 100 * capitals > 3 * F.length(text), F.col(text).rlike("[#$%&*|]")
    # the words are cut once and counted twice
    cut = docs.select("*", F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)).alias("_words"))
    counted = cut.select("*", F.size("_words").alias("_n"), F.size(F.array_distinct("_words")).alias("_distinct"))
    tests = [F.col("_n") < 200, 100 * F.col("_distinct") < 50 * F.col("_n"), shouts, signs]
    bits = sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0)).cast("int")
    return counted.withColumn(out, bits).drop("_words", "_n", "_distinct", text)


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by (text, part, mask): the least id, the rows, and the rows under the least id.
    A text that many rows of a batch share becomes one row for each part and mask."""
    for batch in batches:
        counts: dict[tuple, list[int]] = {}
        for *cell, i in zip(*[c.to_pylist() for c in batch.select(["bucket", "high", "low", "part", "mask", "id"]).columns]):
            have = counts.setdefault(tuple(cell), [i, 0, 0])
            if i < have[0]:
                have[0], have[2] = i, 0
            have[1] += 1
            have[2] += i == have[0]
        rows = [(b, h, w, i, p, m, n, k) for (b, h, w, p, m), (i, n, k) in counts.items()]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types],
                                         names=[c.split()[0] for c in _COUNTS.split(", ")])


def retract(known: Known, rows: Iterable[tuple]) -> dict[tuple[str, int], int]:
    """Take new counts (high, low, id, part, mask, n, at_least) into ``known``, and return the
    changes of the counters by (part, mask)."""
    change: dict[tuple[str, int], int] = {}

    def add(part: str, mask: int, n: int) -> None:
        change[part, mask] = change.get((part, mask), 0) + n

    for high, low, i, part, mask, n, at_least in rows:
        least, under = known.get((high, low), (None, {}))
        if least is None or i < least:
            for (p, m), k in under.items():  # they were first until now
                add(p, m, -k)
                add(p, m | REPEATED, k)
            least, under = known[high, low] = i, {}
        first = at_least if i == least else 0
        if first:
            under[part, mask] = under.get((part, mask), 0) + first
            add(part, mask, first)
        if n > first:
            add(part, mask | REPEATED, n - first)
    return {k: n for k, n in change.items() if n}


def _packed(known: Known) -> bytes:
    rows = [(h, w, i, p, m, n) for (h, w), (i, under) in known.items() for (p, m), n in under.items()]
    table = pa.table(dict(zip(("high", "low", "id", "part", "mask", "n"), map(list, zip(*rows)))))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> Known:
    known: Known = {}
    for h, w, i, p, m, n in zip(*[c.to_pylist() for c in pa.ipc.open_stream(data).read_all().columns]):
        known.setdefault((h, w), (i, {}))[1][p, m] = n
    return known


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    known = _unpacked(state.get[0]) if state.exists else {}
    change: dict[tuple[str, int], int] = {}
    for f in frames:
        rows = zip(*[f[c].tolist() for c in ("high", "low", "id", "part", "mask", "n", "at_least")])
        for k, n in retract(known, rows).items():
            change[k] = change.get(k, 0) + n
    state.update((_packed(known),))
    yield pd.DataFrame([(p, m, n) for (p, m), n in change.items() if n], columns=["part", "mask", "n"]).astype({"mask": "int32", "n": "int64"})


def label_bits(labels: DataFrame) -> DataFrame:
    """(doc_id, bits) with one row an id; of several labels of an id any 1 counts."""
    return labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        (F.when(F.max("quality") == 1, GOOD).otherwise(0) + F.when(F.max("toxic") == 1, TOXIC).otherwise(0)).cast("int").alias("bits"))


def count_masks(spark: SparkSession, path: str, schema: str, labels: DataFrame, batch_bytes: int = 1 << 36,
                texts: int = TEXTS) -> DataFrame:
    """(part, mask, n): documents by part and by failed filters (bits as in ``FILTERS``,
    then ``GOOD`` and ``TOXIC``), from the Parquet files at ``path`` with columns doc_id, text
    and lang, in micro-batches of about ``batch_bytes`` (at least one file each).

    A null text is empty, a null lang the part ''. A row under a null id repeats nothing
    and is repeated by nothing; rows under one id with one text don't repeat each other. The
    checkpoint and the counters lie in the shared folder: a stopped run's files are never
    read by another, as each call takes a folder of its own.
    """
    ensure_checkpoint_dir(spark)
    out, state = scratch_path(spark, "counters"), scratch_path(spark, "audit")
    buckets = 1 + spark.read.schema(schema).parquet(path).count() // texts  # from the files' footers
    path = path.rstrip("/")
    path = f"{path[:-1]}[{path[-1]}]"  # the stream reads a table of one file only if it is found by a pattern
    docs = (spark.readStream.schema(schema).option("maxBytesPerTrigger", str(batch_bytes)).parquet(path)
            .select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("part")))
    docs = with_failed(docs.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256)), "text", "own")
    half = lambda at: F.conv(F.substring("sha", at, 16), 16, -10).cast("long")  # noqa: E731 - 128 bits of the hash
    nobody = F.col("doc_id").isNull()
    rows = (docs.withColumn("high", F.when(nobody, F.lit(0)).otherwise(half(1))).withColumn("low", F.when(nobody, F.lit(0)).otherwise(half(17)))
            .join(staged(label_bits(labels), "labels"), "doc_id", "left")
            # rows without an id share one made-up text and id, so none of them repeats another
            .select(F.pmod("high", F.lit(buckets)).cast("int").alias("bucket"), "high", "low", F.coalesce("doc_id", F.lit(0)).alias("id"),
                    "part", (F.col("own") + F.coalesce("bits", F.lit(0))).cast("int").alias("mask")))
    changes = (rows.mapInArrow(_combine, _COUNTS).groupBy("bucket")
               .applyInPandasWithState(_update, _CHANGE, _STATE, "append", GroupStateTimeout.NoTimeout))
    query = (changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return (spark.read.schema(_CHANGE).parquet(out).groupBy("part", "mask").agg(F.sum("n").cast("long").alias("n"))
            .where("n <> 0"))


def audit(counts: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley) from ``count_masks``; no counts give no rows.

    A part has at most 128 counts, so they travel as one array beside each step. A filter
    comes before the other k - 1 that a document fails in 120 / k of the orders.
    """
    bits = (1 << len(FILTERS)) - 1
    orders = F.split(F.lit(" ".join("".join(p) for p in permutations(FILTERS))), " ")
    bit_of = lambda step: F.expr(f"shiftleft(1, ascii(substring(filter_order, {step}, 1)) - ascii('{FILTERS[0]}'))")
    at = (counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n")).alias("_counts"))
          .withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
          .withColumn("bit", bit_of("step"))
          .withColumn("earlier", sum((F.when(F.col("step") > i, bit_of(i)).otherwise(0) for i in range(1, len(FILTERS))), F.lit(0))))
    bit, earlier = F.col("bit"), F.col("earlier")

    def total(test, weight=lambda m: F.lit(1)):
        return F.aggregate("_counts", F.lit(0).cast("long"), lambda s, c: s + F.when(
            test(c["mask"]), c["n"] * weight(c["mask"])).otherwise(0).cast("long"))

    fails = lambda m: m.bitwiseAND(bit) != 0
    gone = lambda m: m.bitwiseAND(earlier) != 0
    here = lambda m: fails(m) & ~gone(m)
    share = lambda m: F.lit(math.factorial(len(FILTERS))).cast("long") / F.bit_count(m.bitwiseAND(F.lit(bits)))
    return at.select(
        "part", "filter_order", "step",
        total(lambda m: ~fails(m) & ~gone(m)).alias("kept"), total(here).alias("removed"),
        total(lambda m: fails(m) & gone(m)).alias("redundant"),
        total(lambda m: m.bitwiseAND(F.lit(bits)) == bit).alias("unique_fails"),
        total(lambda m: here(m) & (m.bitwiseAND(F.lit(GOOD)) != 0)).alias("good_lost"),
        total(lambda m: here(m) & (m.bitwiseAND(F.lit(TOXIC)) != 0)).alias("toxic_lost"),
        total(fails, share).alias("shapley"))


ORACLE_SQL = r"""
WITH words AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
tests AS (
    SELECT doc_id, part,
           len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
           100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c,
           regexp_matches(t, '[#$%&*|]') AS d,
           coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e
    FROM words),
marks AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad
    FROM labels GROUP BY doc_id),
fails AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, map(['A', 'B', 'C', 'D', 'E'], [a, b, c, d, e]) AS f,
           a::INT + b::INT + c::INT + d::INT + e::INT AS k
    FROM tests LEFT JOIN marks USING (doc_id)),
classes AS (SELECT part, good, bad, f, k, count(*) AS n FROM fails GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
    SELECT v.x || w.x || p.x || q.x || r.x AS filter_order
    FROM letters v JOIN letters w ON w.x <> v.x JOIN letters p ON p.x NOT IN (v.x, w.x)
    JOIN letters q ON q.x NOT IN (v.x, w.x, p.x) JOIN letters r ON r.x NOT IN (v.x, w.x, p.x, q.x)),
steps AS (SELECT filter_order, s::INT AS step, filter_order[s] AS own, filter_order[1:s - 1] AS earlier FROM orders, range(1, 6) t(s)),
seen AS (
    SELECT part, filter_order, step, good, bad, k, n, f[own] AS fail,
           len(list_filter(string_split(earlier, ''), lambda x: x <> '' AND f[x])) > 0 AS gone
    FROM classes, steps)
SELECT part, filter_order, step,
       sum(CASE WHEN NOT fail AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept,
       sum(CASE WHEN fail AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
       sum(CASE WHEN fail AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
       sum(CASE WHEN fail AND k = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
       sum(CASE WHEN fail AND NOT gone THEN n * good ELSE 0 END)::BIGINT AS good_lost,
       sum(CASE WHEN fail AND NOT gone THEN n * bad ELSE 0 END)::BIGINT AS toxic_lost,
       sum(CASE WHEN fail THEN n * 120 // k ELSE 0 END)::BIGINT AS shapley
FROM seen GROUP BY ALL
"""
