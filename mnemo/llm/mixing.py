"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target size over
source size. The documents of a source are put in order (by size, then id), the
expected copies are prefix-summed along that order, one random offset per source is
added, and a document is emitted once for each integer that its step crosses. So a
document gets floor(e) or ceil(e) copies, and because neighbours in the order have
like sizes, the words taken come near the target.

The prefix sum needs no window: within a source it is (position in source) * e, and
positions come from one range partitioning over all documents, which cuts a source
holding any share of the rows into as many partitions as its rows need. Copies are
counted in fixed point (2**-32), so every rerun and every engine agrees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemo.llm.common import fresh, hash_unit, word_count
from mnemo.operators.positions import global_index
from mnemo.session import materialize

SCALE = 1 << 32


def cyclic_weights(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Add ``weight``: the given weights in turn, along the sources by code point, null last."""
    ranked = global_index(sources, [F.col("source").isNull(), F.col("source")], "_rank")
    cycle = F.array(*[F.lit(w) for w in weights])
    return ranked.withColumn("weight", F.get(cycle, (F.col("_rank") % len(weights)).cast("int")).cast("long")).drop("_rank")


def share_targets(sources: DataFrame, share: float, max_repeat: int) -> DataFrame:
    """Add ``target`` to (source, source_size, weight): ``share`` of all sizes dealt by
    weight; a target stops at ``max_repeat`` times its source's size and the excess goes
    to the others by weight, until none is above. Each round is one small aggregate; a
    round closes at least one more source or is the last. An empty table and sources
    without words have target 0.
    """
    cap = (F.col("source_size") * max_repeat).cast("double")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0  # target per unit of weight among the open sources
    closed = -1
    while True:
        capped = F.col("weight") * F.lit(level) >= cap
        got = sources.agg(F.sum(F.when(capped, F.col("source_size")).otherwise(0)).alias("held"),
                          F.sum(F.when(capped, 0).otherwise(F.col("weight"))).alias("open"),
                          F.count(F.when(capped, 1)).alias("closed")).first()
        if got["closed"] == closed or not got["open"]:
            break
        closed = got["closed"]
        level = (total * share - got["held"] * max_repeat) / got["open"]
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5,
                max_repeat: int = 2, seed: int = 17, size: Column | None = None) -> DataFrame:
    """The mixing plan: every row of ``docs`` with ``size``, ``source_size``, ``target``
    and ``copies`` (how often the mix takes it, 0 to ``max_repeat``).

    ``docs`` has doc_id, text, source; other columns are kept, but for any that have the
    names of the columns added here. A null text has size 0, a
    null source is a source of its own (last in order). Repeated rows are sampled one by
    one. Documents of size 0 are sampled like others and add no words. An empty table
    gives an empty plan.
    """
    made = ["size", "source_size", "target", "copies", "_mix_pos", "_mix_start", "_mix_step", "_mix_off"]
    key, none, own = (fresh(docs, x) for x in ("_mix_key", "_mix_null", "_mix_size"))
    sized = (docs.withColumn(own, size if size is not None else word_count(F.col("text")))
             .drop(*[c for c in docs.columns if c.lower() in made]).withColumnRenamed(own, "size")
             .withColumn(none, F.col("source").isNull()).withColumn(key, F.coalesce("source", F.lit(""))))
    # position over all documents: sources one after another, large documents first
    ranked = global_index(sized, [F.col(none), F.col(key), F.col("size").desc(), F.col("doc_id")], "_mix_pos")
    by_source = ranked.groupBy(none, key).agg(
        F.sum("size").alias("source_size"), F.min("_mix_pos").alias("_mix_start"))
    named = by_source.withColumn("source", F.when(~F.col(none), F.col(key)))
    # one row per source, read by every round of the sharing
    targets = materialize(share_targets(materialize(cyclic_weights(named, weights)), share, max_repeat))
    step = F.when(F.col("source_size") > 0,
                  F.floor(F.col("target") / F.col("source_size") * F.lit(float(SCALE)))).otherwise(0).cast("long")
    offset = hash_unit(F.lit(str(seed)), F.when(F.col(none), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(key))))
    small = targets.select(none, key, "source_size", "target", "_mix_start",
                           step.alias("_mix_step"), offset.alias("_mix_off"))
    at = F.col("_mix_pos") - F.col("_mix_start")

    def crossed(i: Column) -> Column:
        # floor((i * step + offset) / 2**32) without leaving 64 bits: the whole copies of
        # the step are split off, and positions are cut into a high and a low half
        whole, part = F.shiftright("_mix_step", 32), F.col("_mix_step").bitwiseAND(F.lit(SCALE - 1))
        low = i.bitwiseAND(F.lit((1 << 16) - 1)) * part
        high = F.shiftright(i, 16) * part
        rest = high.bitwiseAND(F.lit((1 << 16) - 1)) * F.lit(1 << 16) + low + F.col("_mix_off")
        return i * whole + F.shiftright(high, 16) + F.shiftright(rest, 32)

    return (ranked.join(small, [none, key])
            .withColumn("copies", (crossed(at + 1) - crossed(at)).cast("int"))
            .drop(none, key, "_mix_pos", "_mix_start", "_mix_step", "_mix_off"))


def emit_mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: each row of ``docs`` once per copy that the plan gives it.

    The plan is made from ids, sources and sizes alone; texts are moved once, to meet their
    number of copies, and come out in no order of size. Rows that share doc_id, text and
    source share their copies evenly.
    """
    ident, mark, n, nth, rows = (fresh(docs, x) for x in ("_mix_id", "_mix_mark", "_mix_copies", "_mix_nth", "_mix_rows"))
    keyed = docs.select("*", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias(ident), F.xxhash64("text", "source").alias(mark))
    lean = keyed.select("doc_id", "source", word_count(F.col("text")).alias("size"), ident, mark)
    shares = (mix_sources(lean, size=F.col("size"), **how).groupBy(ident, mark)
              .agg(F.sum("copies").alias(n), F.count(F.lit(1)).alias(rows)).where(F.col(n) > 0))
    order = Window.partitionBy(ident, mark).orderBy("doc_id")
    row = F.row_number().over(order) - 1
    own = F.floor(F.col(n) / F.col(rows)) + (F.col(nth) < F.col(n) % F.col(rows)).cast("int")
    return (keyed.join(shares, [ident, mark]).withColumn(nth, row).withColumn(n, own).where(F.col(n) > 0)
            .select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))).alias(nth)).drop(nth))


# the same plan for DuckDB: closed-form sharing (sources close in the order of cap / weight)
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST) AS k FROM w),
p AS (SELECT *, coalesce(sum(source_size) OVER before, 0)::BIGINT AS held,
             (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::BIGINT AS open
      FROM o WINDOW before AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT (t * 1.5::DOUBLE - held * 2) / open AS level
      FROM p, (SELECT sum(source_size)::DOUBLE AS t FROM s)
      WHERE weight * ((t * 1.5::DOUBLE - held * 2) / open) < source_size * 2 ORDER BY k LIMIT 1),
g AS (SELECT source, source_size, least((source_size * 2)::DOUBLE, weight * coalesce((SELECT level FROM l), 0::DOUBLE)) AS target FROM w),
r AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size DESC, doc_id) - 1 AS i FROM d),
e AS (SELECT r.doc_id, r.size, g.source_size, g.target, r.i,
             CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size * 4294967296.0::DOUBLE) ELSE 0 END::HUGEINT AS step,
             ('0x' || substr(md5('17:' || CASE WHEN r.source IS NULL THEN 'null' ELSE '=' || r.source END), 1, 8))::HUGEINT AS off
      FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (size * ((((i + 1) * step + off) >> 32) - ((i * step + off) >> 32)))::BIGINT AS taken
FROM e
"""
