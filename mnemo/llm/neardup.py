"""MinHash near-duplicates with sequential Bayesian verification.

Words are lower-cased (A-Z) and taken in runs of ``width``; a document is its set of
distinct shingles. Documents with equal sets are one class from the start, so copies
cost one row each. Representatives are banded by their signatures; what shares a bucket
is a candidate pair.

Candidates are compared a batch of signature values at a time. After n values with m
matches the posterior chance that the similarity reaches the threshold, under a uniform
prior, is P(Binomial(n + 1, threshold) <= m); a pair is given up as soon as that falls
under ``miss``. Survivors are confirmed on their full sets.

Only links that can still join two components are looked at: first each class with the
least member of most of its buckets, then once more in the buckets that still hold several
components, and last the pairs between different components of a bucket. Those are compared
and confirmed inside tasks, a block of members against a block, and a block tells no more
than a spanning forest of its links. So a group of thousands of near copies, linked or
not, never becomes rows for its pairs, and no candidate is capped or dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm import wordhash
from mnemo.llm.common import fresh, staged
from mnemo.llm.graph import components


@dataclass(frozen=True)
class Settings:
    """``percent``: least similarity. A pair just at 80 % shares none of 36 bands of 5
    values with a chance of 6e-7; ``miss`` is the chance at which verification gives up."""
    width: int = 5
    percent: int = 80
    bands: int = 36
    rows: int = 5
    batch: int = 36
    miss: float = 1e-7
    block: int = 512

    @property
    def values(self) -> int:
        return self.bands * self.rows


def least_matches(n: int, percent: int, miss: float) -> int:
    """Fewest matches among n values at which P(similarity >= percent | matches) >= miss."""
    t, total = percent / 100, 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, distinct shingle hashes row by row in rising order,
    first shingle of each row and their number)."""
    for lo, hi, words, first in wordhash.word_hashes(texts):
        counts = np.diff(first)
        row = np.repeat(np.arange(hi - lo), counts)
        place = np.arange(len(words)) - np.repeat(first[:-1], counts)
        left = np.repeat(counts, counts) - place  # words from here to the row's end
        hashes = words.copy()
        for k in range(1, width):
            more = np.flatnonzero(left > k)
            hashes[more] = wordhash.pair(hashes[more], words[more + k])
        # a shingle begins where ``width`` words are left; a short row has one, of all
        begins = (left >= width) | (place == 0)
        hashes, row = hashes[begins], row[begins]
        order = np.lexsort((hashes, row))
        hashes, row = hashes[order], row[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
        hashes, row = hashes[new], row[new]
        yield lo, hi, hashes, np.searchsorted(row, np.arange(hi - lo + 1))


def signatures(hashes: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """(rows, n) minima of n random functions; a row without shingles has the greatest value."""
    rng = np.random.default_rng(4)
    factor = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    full = np.flatnonzero(np.diff(first))
    out = np.full((n, len(first) - 1), np.uint32(0xFFFFFFFF))
    step = 1 << 15  # shingles at a time, to stay in cache
    cut = 0
    starts = first[:-1][full]
    while cut < len(full):
        end = max(cut + 1, int(np.searchsorted(starts, starts[cut] + step)))
        stop = first[full[end - 1] + 1]
        part, at = hashes[starts[cut]:stop], starts[cut:end] - starts[cut]
        buf = np.empty_like(part)
        for k in range(n):
            np.multiply(part, factor[k], out=buf)
            np.add(buf, add[k], out=buf)
            out[k, full[cut:end]] = np.minimum.reduceat(buf, at) >> np.uint64(32)
        cut = end
    return out.T


def sketch(docs: DataFrame, s: Settings, text: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_shingles, set_a, set_b, bands, marks): two hashes of the whole
    set, a hash for each band and a byte for each signature value."""
    schema = "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, bands array<long>, marks binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, hashes, first in shingle_sets(wordhash.text_column(batch, "text"), s.width):
                both = _set_hashes(hashes, first)
                sig = signatures(hashes, first, s.values)
                band = np.zeros((hi - lo, s.bands), np.uint64)
                for k in range(s.rows):
                    band = wordhash.pair(band, sig[:, k::s.rows].astype(np.uint64))
                flat = pa.array(band.view(np.int64).reshape(-1))
                marks = np.ascontiguousarray(sig.astype(np.uint8))
                yield pa.RecordBatch.from_arrays([
                    ids.slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(first)), pa.array(both[0]), pa.array(both[1]),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, s.bands * (hi - lo) + 1, s.bands), pa.int32()), flat),
                    pa.array([m.tobytes() for m in marks], pa.binary())],
                    names=["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "bands", "marks"])

    return _lean(docs, text).mapInArrow(run, schema)


def _lean(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))


def _set_hashes(hashes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each row's set of shingles: sums of two scramblings of them."""
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
            for x in (wordhash.mix(hashes), wordhash.mix(hashes ^ np.uint64(0x5BD1E995)))]
    return [(x[first[1:]] - x[first[:-1]]).view(np.int64) for x in sums]


def _surviving(pairs: DataFrame, sketches: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b) that sequential verification doesn't give up, with their matches."""
    need = [(n, least_matches(n, s.percent, s.miss)) for n in range(s.batch, s.values + 1, s.batch)]
    width = s.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 20_000):
                part = batch.slice(lo, 20_000)
                a, b = (np.frombuffer(b"".join(part.column(i).to_pylist()), np.uint8).reshape(-1, width) for i in (2, 3))
                alive, matches, seen = np.arange(len(a)), np.zeros(len(a), np.int32), 0
                for n, least in need:
                    matches[alive] += np.count_nonzero(a[alive, seen:n] == b[alive, seen:n], axis=1).astype(np.int32)
                    alive, seen = alive[matches[alive] >= least], n
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(alive)), part.column(1).take(pa.array(alive)), pa.array(matches[alive])],
                    names=["a", "b", "matches"])

    marked = (pairs.join(sketches.select(F.col("node").alias("a"), F.col("marks").alias("x")), "a")
              .join(sketches.select(F.col("node").alias("b"), F.col("marks").alias("y")), "b")
              .select("a", "b", "x", "y"))
    return marked.mapInArrow(run, "a long, b long, matches int")


def _compare_bucket(ids, sizes, groups, parts, marks, cross, need, s: Settings) -> np.ndarray:
    """Places (i, j) of a bucket's members that sequential verification doesn't give up, among
    those of like size and different components (and parts, if ``cross``)."""
    small, large = np.minimum.outer(sizes, sizes), np.maximum.outer(sizes, sizes)
    open_ = (100 * small >= s.percent * large) & (groups[:, None] != groups[None, :]) & (ids[:, None] < ids[None, :])
    if cross:
        open_ &= parts[:, None] != parts[None, :]
    i, j = np.nonzero(open_)
    matches, seen = np.zeros(len(i), np.int32), 0
    for n, least in need:
        for lo in range(0, len(i), 100_000):  # bounds memory
            at = slice(lo, lo + 100_000)
            matches[at] += np.count_nonzero(marks[i[at], seen:n] == marks[j[at], seen:n], axis=1).astype(np.int32)
        keep = matches >= least
        i, j, matches, seen = i[keep], j[keep], matches[keep], n
    return np.stack([i, j])


def _blocks(rows: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on the rows of each block (bucket, i, j) as a table. Whole blocks are handed
    on as they come, so a task holds one block and an Arrow batch."""
    def told(rows_: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows_)
        key = np.stack([t.column(c).to_numpy() for c in ("bucket", "i", "j")])
        cuts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0), [True]])).tolist()
        for lo, hi in zip(cuts, cuts[1:]):
            if hi - lo > 1 and (out := work(t.slice(lo, hi - lo))) is not None:
                yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # whole blocks, and the beginning of one at the end
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in range(3)])
            change = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            if held and (key[:, 0] != [held[-1].column(c)[-1].as_py() for c in range(3)]).any():
                change = np.append(0, change)
            if not len(change):
                held.append(batch)
                continue
            last = int(change[-1])
            if held or last:
                yield from told([*held, batch.slice(0, last)] if last else held)
            held = [batch.slice(last)]
        if held:
            yield from told(held)

    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, schema)


def _open_pairs(t: pa.Table, need, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of a block's members of different components that verification doesn't
    give up; each pair of a table in the block of the first band that the two have in common."""
    nodes, sizes, groups, parts = (t.column(c).to_numpy() for c in ("node", "n_shingles", "component", "part"))
    if (groups == groups[0]).all():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    marks = np.frombuffer(b"".join(t.column("marks").to_pylist()), np.uint8).reshape(len(nodes), -1)
    bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(len(nodes), -1)
    cross = t.column("i")[0].as_py() != t.column("j")[0].as_py()
    i, j = _compare_bucket(nodes, sizes, groups, parts, marks, cross, need, s)
    first = np.argmax(bands[i] == bands[j], axis=1) == t.column("band")[0].as_py()
    return i[first], j[first]


def _forest(t: pa.Table, i: np.ndarray, j: np.ndarray, s: Settings) -> list[tuple[int, int]]:
    """Links of a block that span its components: pairs (i, j) whose full sets are similar
    enough, without those that earlier ones have joined already."""
    nodes, groups = t.column("node").to_numpy(), t.column("component").to_numpy()
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("hashes").combine_chunks()]
    root = np.unique(groups, return_inverse=True)[1]  # the component of each member, merged as links are found
    out = []
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    for a, lo, hi in zip(*_runs(i)):
        left = [b for b in j[lo:hi].tolist() if root[b] != root[a]]
        for at in range(0, len(left), 64):
            some = [b for b in left[at:at + 64] if root[b] != root[a]]
            if not some:
                continue
            sizes = np.array([len(sets[b]) for b in some])
            flat = np.concatenate([sets[b] for b in some])
            place = np.minimum(np.searchsorted(sets[a], flat), len(sets[a]) - 1)
            both = np.add.reduceat((sets[a][place] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
            for b, n in zip(some, (100 * both >= s.percent * (len(sets[a]) + sizes - both)).tolist()):
                if n and root[b] != root[a]:
                    root[root == root[b]] = root[a]
                    out.append((int(nodes[a]), int(nodes[b])))
    return out


def _runs(x: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """(value, first, end) of the runs of equal values of a sorted array."""
    cuts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])) if len(x) else np.zeros(1, np.int64)
    return x[cuts[:-1]].tolist(), cuts[:-1].tolist(), cuts[1:].tolist()


def _links_in_buckets(members: DataFrame, sketches: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Links (a, b) that join the different components of each bucket as far as its members'
    full sets do. Buckets are compared in blocks of ``s.block`` members. First signatures
    only, to learn which members have a candidate at all; then those come with their sets,
    are confirmed in place, and each block tells at most one link a member."""
    need = [(n, least_matches(n, s.percent, s.miss)) for n in range(s.batch, s.values + 1, s.batch)]
    kept = ["bucket", "i", "j", "band", "node", "n_shingles", "component", "part", "marks", "bands"]
    form = "bucket long, i int, j int, band int, node long, n_shingles long, component long, part int, marks binary, bands array<long>"

    def candidates(t: pa.Table) -> pa.RecordBatch | None:
        i, j = _open_pairs(t, need, s)
        if not len(i):
            return None
        return t.take(pa.array(np.union1d(i, j))).combine_chunks().to_batches()[0]

    def confirmed(t: pa.Table) -> pa.RecordBatch | None:
        i, j = _open_pairs(t, need, s)
        found = _forest(t, i, j, s) if len(i) else []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"]) if found else None

    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    rows = (members.join(sizes, "bucket").join(sketches.select("node", "marks", "bands"), "node")
            .withColumn("blocks", F.ceil(F.col("size") / s.block).cast("int"))
            .withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
            .select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
            .withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).select(*kept))
    open_ = staged(_blocks(rows, candidates, form), "candidates")
    return _blocks(open_.join(sets, "node").select(*kept, "hashes"), confirmed, "a long, b long")


def _full_sets(docs: DataFrame, wanted: DataFrame, s: Settings, text: str) -> DataFrame:
    """(node, hashes): the sorted distinct shingle hashes of the wanted classes (node,
    doc_id, text_hash), each from the row that stands for it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, hashes, first in shingle_sets(wordhash.text_column(batch, "text"), s.width):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo),
                     pa.array([hashes[x:y].tobytes() for x, y in zip(first, first[1:])], pa.binary())],
                    names=["node", "hashes"])

    own = _lean(docs, text).join(wanted, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])  # rows may repeat
    return own.select("node", "text").mapInArrow(run, "node long, hashes binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough: 100 * both >= percent * either."""
    percent = s.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            at = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    filled = (pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
              .join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
              .select("a", "b", "x", "y"))
    return filled.mapInArrow(run, "a long, b long")


def grouped(docs: DataFrame, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_shingles, component, component_id) of every row of ``docs``:
    component names the group of its text, component_id is the group's smallest doc_id. A
    class of equal sets is what is linked, whatever ids its rows have, so several texts under
    one id are each linked with their own kind. Rows without shingles or without an id are alone
    (component null)."""
    s = settings
    rows = staged(sketch(docs, s, text), "sketches")
    node = F.xxhash64("n_shingles", "set_a", "set_b").alias("node")
    full = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").select("*", node)
    # one sketch a class: equal sets have equal sketches
    classes = staged(full.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).select("node", "first.*"), "classes")
    reps = staged(full.join(classes, ["node", "doc_id", "text_hash"], "left_semi")
                  .dropDuplicates(["node"]).select("node", "n_shingles", "bands", "marks"), "representatives")

    members = reps.select("node", "n_shingles", F.posexplode("bands").alias("band", "value")).select(
        F.xxhash64("band", "value").alias("bucket"), "band", "node", "n_shingles")
    shared = staged(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("pivot"))
                    .where("n > 1").select("bucket", "pivot"), "buckets")
    crowd = staged(members.join(shared, "bucket"), "members")  # only buckets with company
    # sets of whatever may need confirming: every member of a shared bucket
    sets = staged(_full_sets(docs, classes.join(crowd.select("node").distinct(), "node", "left_semi"), s, text), "sets")
    sizes = reps.select(F.col("node").alias("pivot"), F.col("n_shingles").alias("pivot_n"))

    def likeliest(members: DataFrame) -> DataFrame:
        """(a, b): for each member the pivot, of like size, with which it shares most
        buckets; ties go to the least."""
        shared = members.groupBy("pivot", "node", "n_shingles").agg(F.count(F.lit(1)).alias("shared"))
        near = shared.join(sizes, "pivot").where(f"100 * least(n_shingles, pivot_n) >= {s.percent} * greatest(n_shingles, pivot_n)")
        return staged(near.groupBy("node").agg(F.max_by("pivot", F.struct("shared", "pivot")).alias("a"))
                      .select("a", F.col("node").alias("b")), "likeliest")

    def mixed(members: DataFrame, groups: DataFrame) -> DataFrame:
        """Members of buckets that hold several components, with the least member's."""
        placed = (members.select("bucket", "band", "node", "n_shingles")
                  .join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")))
        heads = (placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                              F.min(F.struct("node", "component")).alias("head"))
                 .where("lo <> hi").select("bucket", F.col("head.node").alias("pivot"), F.col("head.component").alias("head")))
        return staged(placed.join(heads, "bucket"), "mixed")

    def verified(pairs: DataFrame) -> DataFrame:
        return _confirmed(_surviving(pairs, reps, s).select("a", "b"), sets, s)

    links = staged(verified(likeliest(crowd.where("node <> pivot"))), "links")
    placed = mixed(crowd, staged(components(links), "groups"))
    links = staged(links.union(verified(likeliest(placed.where("component <> head")))), "links")
    placed = mixed(placed, staged(components(links), "groups"))
    links = staged(links.union(_links_in_buckets(placed, reps, sets, s)), "links")

    named = classes.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = staged(named.join(least, "component").select("node", "component", "component_id"), "named")
    linked = full.select("doc_id", "text_hash", "n_shingles", "node").join(named, "node").drop("node")
    alone = rows.where("n_shingles = 0 OR doc_id IS NULL").select(
        "doc_id", "text_hash", "n_shingles", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return linked.select(*alone.columns).unionByName(alone)


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable by links, kept is doc_id = component_id.
    A text with fewer words than ``width`` has one shingle, all of it; a null text or one
    without words has none and is linked with nothing, and so is a row without a doc_id
    (component_id null, kept). Repeated rows are copies: all are returned with the same
    component. Several texts under one doc_id are each in the group of their own text, and
    do not link those groups. An empty table gives no rows.
    """
    return grouped(docs, settings, text).select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` without near-duplicates: of each group one row stays, of its least doc_id (of
    several texts there the one of most shingles). Texts that are linked with nothing stay, also several
    under one id; of rows that repeat id and text one stays. Rows without a doc_id all stay."""
    t = fresh(docs, "_text_hash")
    own = docs.withColumn(t, F.xxhash64("text"))
    found = grouped(docs.select("doc_id", "text"), settings).where("doc_id IS NOT NULL")
    first = (found.where("component IS NOT NULL").groupBy("component")
             .agg(F.min(F.struct("doc_id", -F.col("n_shingles"), "text_hash")).alias("first")).select("first.doc_id", "first.text_hash"))
    ids = first.union(found.where("component IS NULL").select("doc_id", "text_hash")).distinct().withColumnRenamed("text_hash", t)
    kept = own.join(ids, ["doc_id", t], "left_semi")
    # of rows that repeat both, any: the copies differ in other columns at most
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    kept = kept.groupBy("doc_id", t).agg(F.min_by(F.struct("text", *others), F.xxhash64(*others or ["text"])).alias("_row"))
    kept = kept.select(*[F.col(c) if c == "doc_id" else F.col(f"_row.{c}").alias(c) for c in docs.columns])
    return kept.unionByName(docs.where("doc_id IS NULL"))


# links by full sets, then components by repeated spreading of the least id
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS s
  FROM w WHERE len(ws) > 1 UNION ALL SELECT doc_id, ws[1] FROM w WHERE len(ws) = 1)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id
  JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  WHERE 100 * least(nx.n, ny.n) >= 80 * greatest(nx.n, ny.n)
  GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 80 * (nx.n + ny.n - count(*))),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(c.c, w.doc_id)) AS component_id,
       w.doc_id <= coalesce(c.c, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) c USING (doc_id)
"""
