"""Embedding near-duplicates by a forest of random projection trees.

Each tree splits its vectors by their projections on random directions, level by level;
vectors near the cut go to both sides (spill), so that a close pair is rarely parted, and
several trees make up for each other. The cut is put where the children are smallest: in
a sparse place, beside a dense group rather than through it. A node that no direction
splits well is left whole, and a leaf of any size is compared exactly, block by block.

One pass over all levels moves narrow rows (vector id, node, projections). The vectors
themselves are dealt once, to the blocks of their leaves. Of a pair that meets in several
leaves only the meeting in the least leaf counts, so no list of pairs is ever made:
a block gives a count for each vector and edges that span its linked groups.

Equal vectors are one class with a count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemo.llm.common import staged
from mnemo.llm.graph import components


@dataclass(frozen=True)
class Settings:
    """``spill``: half width of the overlap, in units of 1 / sqrt(dimensions). A pair at
    cosine 0.95 differs by 0.32 such units along a direction (one standard deviation)."""
    cosine: float = 0.95
    trees: int = 6
    spill: float = 0.15
    leaf: int = 256
    block: int = 512
    levels: int = 24
    patience: int = 3
    seed: int = 8


def is_usable() -> Column:
    """True for rows with an id and a vector of finite numbers, not all zero."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col("vec_id").isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _units(column: pa.Array) -> list[np.ndarray]:
    out = []
    for v in column:
        x = np.frombuffer(v.as_buffer(), np.float64)
        x = x / np.abs(x).max()  # no overflow in the norm
        out.append(x / np.sqrt(x @ x))
    return out


def _directions(tree: int, first: int, s: Settings, dims: int) -> np.ndarray:
    rng = np.random.default_rng([s.seed, tree, first, dims])
    d = rng.normal(size=(s.levels, dims))
    return d / np.linalg.norm(d, axis=1, keepdims=True)


def _projections(vectors: DataFrame, first: int, s: Settings) -> DataFrame:
    """(vec_id, tree, dims, at): each vector's projections on a tree's directions of the
    levels from ``first``, in units of 1 / sqrt(dimensions)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            units = _units(batch.column(1))
            dims = np.array([len(u) for u in units], np.int64)
            for d in np.unique(dims).tolist():
                own = np.flatnonzero(dims == d)
                if d not in made:
                    made[d] = [_directions(t, first, s, d) for t in range(s.trees)]
                ids = batch.column(0).take(pa.array(own))
                x = np.stack([units[i] for i in own]) * np.sqrt(d)
                for t, directions in enumerate(made[d]):
                    at = (x @ directions.T).astype(np.float32)
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(np.full(len(own), t, np.int32)), pa.array(np.full(len(own), d, np.int32)),
                         pa.ListArray.from_arrays(pa.array(np.arange(0, at.size + 1, s.levels), pa.int32()), pa.array(at.reshape(-1)))],
                        names=["vec_id", "tree", "dims", "at"])

    return vectors.mapInArrow(run, "vec_id long, tree int, dims int, at array<float>")


QUANTILES = [i / 40 for i in range(41)]


def _cuts(nodes: DataFrame, s: Settings) -> DataFrame:
    """Where to cut each node: (tree, dims, node, cut), null if no cut pays. Comparing costs
    the square of a node's size, so the best cut has the least sum of squares."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        probs = np.array(QUANTILES)
        for f in frames:
            cuts = []
            for n, q in zip(f["n"], f["q"]):
                best = None
                if n > s.leaf:
                    q = np.maximum.accumulate(np.asarray(q, np.float64))
                    at = (q[1:] + q[:-1]) / 2
                    left = np.interp(at + s.spill, q, probs)
                    right = 1 - np.interp(at - s.spill, q, probs)
                    cost = left ** 2 + right ** 2
                    i = int(np.argmin(cost))
                    best = float(at[i]) if cost[i] <= 0.85 else None
                cuts.append(best)
            yield f.assign(cut=pd.Series(cuts, dtype="float64", index=f.index))[["tree", "dims", "node", "n", "cut"]]

    return nodes.mapInPandas(run, "tree int, dims int, node long, n long, cut double")


def grow(vectors: DataFrame, s: Settings) -> DataFrame:
    """(vec_id, leaf): the leaves that each vector falls into, over all trees."""
    live = staged(_projections(vectors, 0, s).select("*", F.lit(1).cast("long").alias("node"), F.lit(0).alias("missed")), "nodes")
    leaves: list[DataFrame] = []
    level = 0
    key = ["tree", "dims", "node"]
    while not live.isEmpty():
        if level and level % s.levels == 0:  # further directions
            live = live.drop("at").join(_projections(vectors, level, s), ["vec_id", "tree", "dims"])
        now = live.withColumn("p", F.get("at", F.lit(level % s.levels)))
        nodes = now.groupBy(*key).agg(F.count(F.lit(1)).alias("n"),
                                      F.percentile_approx("p", QUANTILES, 400).alias("q"))
        cuts = staged(_cuts(nodes, s), "cuts")
        told = now.join(cuts, key)
        ended = (F.col("n") <= s.leaf) | (F.col("cut").isNull() & (F.col("missed") + 1 >= s.patience))
        told = told.withColumn("sides", F.when(F.col("cut").isNull(), F.array(F.col("node"))).otherwise(F.array_compact(F.array(
            F.when(F.col("p") <= F.col("cut") + s.spill, F.col("node") * 2),
            F.when(F.col("p") > F.col("cut") - s.spill, F.col("node") * 2 + 1)))))
        done = told.where(ended).select("vec_id", F.xxhash64(*key).alias("leaf"))
        leaves.append(staged(done, "leaves"))
        live = staged(told.where(~ended).select(
            "vec_id", "tree", "dims", "at", F.explode("sides").alias("node"),
            F.when(F.col("cut").isNull(), F.col("missed") + 1).otherwise(0).alias("missed")), "nodes")
        level += 1
    out = leaves[0] if leaves else live.select("vec_id", F.col("node").alias("leaf"))
    for x in leaves[1:]:
        out = out.union(x)
    return out


def _linked(units_a, units_b, s: Settings) -> np.ndarray:
    return units_a @ units_b.T >= s.cosine


def _spanning(ok: np.ndarray) -> np.ndarray:
    """The least member of each row's group under the symmetric links ``ok``."""
    n = len(ok)
    label = np.arange(n)
    while True:
        near = np.where(ok, label[None, :], n).min(axis=1)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(s: Settings):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        leaf, i, j = (table.column(c)[0].as_py() for c in ("leaf", "i", "j"))
        ids = np.array(table.column("vec_id"), np.int64)
        part = np.array(table.column("part"), np.int64)
        weight = np.array(table.column("n"), np.int64)
        units = np.stack(_units(table.column("vector")))
        earlier = [[x for x in row if x < leaf] for row in table.column("leaves").to_pylist()]
        ok = _linked(units, units, s)
        ok &= part[:, None] != part[None, :] if i != j else True
        np.fill_diagonal(ok, False)
        linked = ok.copy()
        names = {x: k for k, x in enumerate(sorted({x for row in earlier for x in row}))}
        if names and ok.any():
            member = np.zeros((len(ids), len(names)), np.float32)
            for r, row in enumerate(earlier):
                member[r, [names[x] for x in row]] = 1
            ok &= member @ member.T == 0  # pairs that met in an earlier leaf are counted there
        links = ok @ weight
        group = _spanning(linked)
        root = ids[group]
        use = (links > 0) | (root != ids)
        return pa.table({"vec_id": ids[use], "links": links[use].astype(np.int64), "root": root[use]})
    return run


def links(vectors: DataFrame, leaves: DataFrame, s: Settings) -> DataFrame:
    """(vec_id, links, root) from each block: how many vectors (with their copies) a
    vector is linked with by pairs counted there, and a linked member of the block."""
    own = leaves.groupBy("vec_id").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))
    sizes = leaves.distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    wide = vectors.join(own, "vec_id")
    rows = (wide.select("vec_id", "vector", "n", "leaves", F.explode("leaves").alias("leaf")).join(sizes, "leaf")
            .withColumn("blocks", F.ceil(F.col("size") / s.block).cast("int"))
            .withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
            .select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
            .select("leaf", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
                    "part", "vec_id", "vector", "n", "leaves"))
    return rows.groupBy("leaf", "i", "j").applyInArrow(_compare(s), "vec_id long, links long, root long")


def near_duplicates(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding).

    Vectors that are null, zero or hold null or non-finite components link with nothing;
    vectors of different dimensions aren't compared. Repeated rows are copies of each
    other and are all returned. A row without an id has n_links 0, no component and is
    kept. An empty table gives none.
    """
    s = settings
    # a negative zero becomes zero, so that equal vectors have equal bytes
    numbers = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    good = staged(vectors.where(is_usable()).select(F.col("vec_id").cast("long").alias("vec_id"), numbers.alias("vector"))
                  .mapInArrow(_packed, "vec_id long, vector binary"), "vectors")
    classes = staged(good.groupBy("vector").agg(F.min("vec_id").alias("class"), F.count(F.lit(1)).alias("n")), "vector_classes")
    reps = classes.select(F.col("class").alias("vec_id"), "vector", "n")
    found = staged(links(reps, grow(reps.select("vec_id", "vector"), s), s), "vector_links")
    groups = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    named = (classes.join(counts.withColumnRenamed("vec_id", "class"), "class", "left")
             .join(groups.withColumnRenamed("node", "class"), "class", "left")
             .select("vector", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                     F.coalesce("component", "class").alias("component_id")))
    linked = good.join(named, "vector").select("vec_id", "n_links", "component_id")
    alone = vectors.where(~is_usable()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"),
        F.col("vec_id").cast("long").alias("component_id"))
    return linked.unionByName(alone).select(
        "vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([np.array(x, np.float64).tobytes() for x in batch.column(1).to_pylist()], pa.binary())],
            names=["vec_id", "vector"])


ORACLE_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM g x JOIN g y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(c.c, v.vec_id)) AS component_id,
       v.vec_id <= coalesce(c.c, v.vec_id) AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = v.vec_id
LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) c ON c.a = v.vec_id
"""
