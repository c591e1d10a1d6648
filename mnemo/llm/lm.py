"""Interpolated modified Kneser-Ney scoring.

A bigram model over the corpus's own words: the probability of a word after its
predecessor is the discounted count of the pair plus, by the discounted mass, the word's
continuation probability (in how many different pairs it comes second), which in turn is
interpolated with the uniform distribution over the vocabulary and one unknown word.
There is one discount each for counts of 1, 2 and 3 or more, from the counts of counts.

Everything is counted in Spark and never gathered. Map tasks sum their own words (or
pairs) and send packed arrays to shards; each shard is merged by one task and written to
the shared folder as plain sorted arrays, which the workers of later steps map into
memory, so a lookup touches only the pages that it needs. The driver sees one small row
per shard.

  vocabulary   word hashes, sorted; a word's place there is its id, and counts lie beside
  pairs        (id, id) keys, sorted, those counted once apart from the others
  contexts     how many pairs counted 1, 2, 3+ times begin with a word
  continuation how many different pairs end with a word, by id

Shards of words are ranges of the hash. Pairs are dealt by their first word; the pairs of
a first word so frequent that it would fill half a shard are dealt by both words, and
their context counts are summed over the shards.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemo.llm import wordhash
from mnemo.llm.common import fresh
from mnemo.session import scratch_path

#: Stands for the end of a text among the word hashes.
END = np.uint64(0x5851F42D4C957F2D)
#: Distinct entries that a map task holds before it sends them on.
HELD = 3_000_000
_WORD_BITS = np.uint64(32)
_LOW = np.uint64((1 << 32) - 1)


# -------------------------------------------------------------------- arrays in the shared folder

def _store(root: str, name: str, array: np.ndarray) -> None:
    """Write an array whole or not at all: a repeated task only replaces it."""
    system, base = pafs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pafs.LocalFileSystem(), root)
    path = f"{base}/{name}"
    system.create_dir(os.path.dirname(path), recursive=True)
    half = f"{path}.{os.getpid()}-{os.urandom(4).hex()}"
    with system.open_output_stream(half) as out:
        out.write(np.ascontiguousarray(array).data.cast("B") if array.size else b"")
    system.move(half, path)


def _mapped(root: str, name: str, dtype) -> np.ndarray:
    """Map an array of the shared folder into memory. From a store without local paths
    it is first copied into a nameless temporary file."""
    system, base = pafs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pafs.LocalFileSystem(), root)
    path = f"{base}/{name}"
    if isinstance(system, pafs.LocalFileSystem):
        if os.path.getsize(path) == 0:
            return np.zeros(0, dtype)
        return np.memmap(path, dtype, "r")
    with tempfile.TemporaryFile() as local, system.open_input_stream(path) as src:
        while chunk := src.read(1 << 22):
            local.write(chunk)
        local.flush()
        return np.memmap(local, dtype, "r") if local.tell() else np.zeros(0, dtype)


def _sum_by_key(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


# packed arrays between tasks: byte planes of key differences, which compress well
def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    steps = np.diff(keys, prepend=np.uint64(0))
    planes = steps.astype("<u8").view(np.uint8).reshape(-1, 8).T
    small = np.minimum(counts, 255).astype(np.uint8)
    large = counts[counts >= 255].astype("<i8")
    return b"".join([np.int64(len(keys)).tobytes(), planes.tobytes(), small.tobytes(), large.tobytes()])


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, "<i8", 1)[0])
    planes = np.frombuffer(blob, np.uint8, 8 * n, 8).reshape(8, n)
    keys = np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view("<u8"), dtype=np.uint64)
    counts = np.frombuffer(blob, np.uint8, n, 8 + 8 * n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(blob, "<i8", -1, 8 + 9 * n)
    return keys, counts


def _packed(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row (shard, packed) for each shard that has keys; keys are sorted."""
    if not len(keys):
        return
    order = np.argsort(shard, kind="stable")  # keeps the keys of a shard sorted
    keys, counts, shard = keys[order], counts[order], shard[order]
    cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
    blobs = [_pack(keys[a:b], counts[a:b]) for a, b in zip(cuts, cuts[1:])]
    yield pa.RecordBatch.from_arrays([pa.array(shard[cuts[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())],
                                     names=["shard", "packed"])


class _Summer:
    """Sums keys within a task and lets go of them when many are held."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, keys: np.ndarray) -> bool:
        self.parts.append(np.unique(keys, return_counts=True))
        self.n += len(self.parts[-1][0])
        if self.n > HELD:
            self.parts = [self.take()]
            self.n = len(self.parts[0][0])
        return self.n > HELD * 2 // 3

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        parts, self.parts, self.n = self.parts, [], 0
        if not parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return _sum_by_key(np.concatenate([p[0] for p in parts]).astype(np.uint64),
                           np.concatenate([p[1] for p in parts]).astype(np.int64))


# -------------------------------------------------------------------- the model

@dataclass
class Model:
    """What the tasks need to find and use the arrays; small (a row per shard)."""
    root: str
    shards: int
    words: list[int] = field(default_factory=list)  # ids before each vocabulary shard, and all
    tokens: int = 0
    texts: int = 0
    hot: dict[int, tuple[int, int, int]] = field(default_factory=dict)  # contexts dealt by pair
    pair_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    word_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    continuations: int = 0
    continuation_ranks: tuple[int, int, int] = (0, 0, 0)

    @property
    def n_words(self) -> int:
        return self.words[-1] if self.words else 0


class Reader:
    """The mapped arrays, opened as they are needed."""

    def __init__(self, model: Model):
        self.model = model
        self.open: dict[str, np.ndarray] = {}

    def array(self, name: str, dtype) -> np.ndarray:
        if name not in self.open:
            self.open[name] = _mapped(self.model.root, name, dtype)
        return self.open[name]

    def by_shard(self, shard: np.ndarray):
        """(shard, places) for each shard that occurs."""
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
        for a, b in zip(cuts, cuts[1:]):
            yield int(shard[order[a]]), order[a:b]

    def word_ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id and count of sorted distinct hashes; unknown words have id -1 and count 0."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        shard = word_shard(hashes, self.model.shards)
        cuts = np.searchsorted(shard, np.arange(self.model.shards + 1))
        for s, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if a < b and self.model.words[s + 1] > self.model.words[s]:
                known = self.array(f"vocabulary/{s}.hash", np.uint64)
                at = np.minimum(np.searchsorted(known, hashes[a:b]), len(known) - 1)
                hit = known[at] == hashes[a:b]
                ids[a:b][hit] = at[hit] + self.model.words[s]
                counts[a:b][hit] = self.array(f"vocabulary/{s}.count", np.int64)[at[hit]]
        return ids, counts

    def continuation(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        for s, at in self.by_shard(np.searchsorted(self.model.words, ids, "right") - 1):
            out[at] = self.array(f"continuation/{s}", np.uint32)[ids[at] - self.model.words[s]]
        return out

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct pair keys."""
        out = np.zeros(len(keys), np.int64)
        for s, at in self.by_shard(pair_shard(keys, self.model)):
            want = keys[at]
            once, more = self.array(f"pairs/{s}.once", np.uint64), self.array(f"pairs/{s}.more", np.uint64)
            for known, count in ((once, None), (more, f"pairs/{s}.count")):
                if len(known):
                    i = np.minimum(np.searchsorted(known, want), len(known) - 1)
                    hit = known[i] == want
                    out[at[hit]] = 1 if count is None else self.array(count, np.int64)[i[hit]]
        return out

    def context_counts(self, ids: np.ndarray) -> np.ndarray:
        """(n, 3): pairs counted 1, 2 and 3+ times that begin with the sorted distinct ids."""
        out = np.zeros((len(ids), 3), np.int64)
        for s, at in self.by_shard(context_shard(ids, self.model.shards)):
            known = self.array(f"contexts/{s}.id", np.int64)
            if len(known):
                i = np.minimum(np.searchsorted(known, ids[at]), len(known) - 1)
                hit = known[i] == ids[at]
                out[at[hit]] = self.array(f"contexts/{s}.n", np.int64).reshape(-1, 3)[i[hit]]
        for j in np.flatnonzero(np.isin(ids, list(self.model.hot))) if self.model.hot else ():
            out[j] = self.model.hot[int(ids[j])]
        return out


def word_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the hash, so ids rise with the hash over all shards."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def context_shard(ids: np.ndarray, shards: int) -> np.ndarray:
    return (wordhash.mix(ids.astype(np.uint64) + np.uint64(1)) % np.uint64(shards)).astype(np.int64)


def pair_shard(keys: np.ndarray, model: Model) -> np.ndarray:
    first = (keys >> _WORD_BITS).astype(np.int64)
    shard = context_shard(first, model.shards)
    if model.hot:
        at = np.isin(first, list(model.hot))
        shard[at] = (wordhash.mix(keys[at]) % np.uint64(model.shards)).astype(np.int64)
    return shard


def _texts(batches: Iterator[pa.RecordBatch], text: str):
    """(batch, first row, row after the last, tokens with ends, first token of each row)."""
    for batch in batches:
        for lo, hi, words, first in wordhash.word_hashes(wordhash.text_column(batch, text)):
            rows = np.arange(hi - lo)
            starts = first[:-1] + rows  # one end after each row's words
            tokens = np.empty(len(words) + hi - lo, np.uint64)
            ends = first[1:] + rows
            inner = np.ones(len(tokens), bool)
            inner[ends] = False
            tokens[inner], tokens[ends] = words, END
            yield batch, lo, hi, tokens, starts, ends


def _pairs(reader: Reader, tokens: np.ndarray, starts: np.ndarray):
    """Ids and counts of the tokens and of what stands before them. The start of a text
    is the id after all words."""
    words, inverse = np.unique(tokens, return_inverse=True)
    ids, counts = reader.word_ids(words)
    ids, counts = ids[inverse], counts[inverse]
    before, before_counts = np.roll(ids, 1), np.roll(counts, 1)
    before[starts], before_counts[starts] = reader.model.n_words, reader.model.texts
    return ids, counts, before, before_counts


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from how many counts are 1, 2, 3 and 4. Where a
    count of counts is 0 (tiny corpora), the absolute discount of 0.5 steps in."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.5)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))


def _of_counts(counts: np.ndarray) -> list[int]:
    return [int(np.count_nonzero(counts == k)) for k in (1, 2, 3, 4)]


def train(docs: DataFrame, text: str = "text", shards: int | None = None) -> Model:
    """Count a model over all texts of ``docs`` and store it in the shared folder.

    ``shards`` follows the number of input partitions unless given, so what one task
    merges stays as large as it is. A null text is an empty one, a single end. An empty
    table gives a model without words, under which every word is unknown.
    """
    spark = docs.sparkSession
    lean = docs.select(F.col(text).alias("text"))
    shards = shards or max(8, 4 * lean.rdd.getNumPartitions())
    root = scratch_path(spark, "language_model")
    model = Model(root, shards)

    def count_words(batches):
        held = _Summer()
        for _, _, _, tokens, _, _ in _texts(batches, "text"):
            if held.add(tokens):
                keys, counts = held.take()
                yield from _packed(keys, counts, word_shard(keys, shards))
        keys, counts = held.take()
        yield from _packed(keys, counts, word_shard(keys, shards))

    def merged(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
        parts = [_unpack(b.as_py()) for b in table.column("packed")]
        return (table.column("shard")[0].as_py(),
                *_sum_by_key(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])))

    def store_words(table: pa.Table) -> pa.Table:
        s, keys, counts = merged(table)
        _store(root, f"vocabulary/{s}.hash", keys)
        _store(root, f"vocabulary/{s}.count", counts)
        ends = int(counts[np.searchsorted(keys, END)]) if END in keys else 0
        return pa.table({"shard": [s], "n": [len(keys)], "total": [int(counts.sum())], "ends": [ends]})

    sent = lean.mapInArrow(count_words, "shard int, packed binary")
    rows = (sent.repartition(shards, "shard").groupBy("shard")
            .applyInArrow(store_words, "shard long, n long, total long, ends long").collect())
    sizes = {r.shard: r.n for r in rows}
    model.words = [0, *np.cumsum([sizes.get(s, 0) for s in range(shards)]).tolist()]
    model.tokens, model.texts = sum(r.total for r in rows), sum(r.ends for r in rows)
    if model.n_words >= 1 << 32:
        raise ValueError("pair keys hold 32 bits a word; this corpus has more distinct words")

    # first words that alone would fill half a shard; fewer than 2 * shards of them
    limit = model.tokens / (2 * shards)

    def frequent(batches):
        reader = Reader(model)
        for batch in batches:
            for s in batch.column(0).to_pylist():
                counts = reader.array(f"vocabulary/{s}.count", np.int64)
                at = np.flatnonzero(counts > limit)
                yield pa.RecordBatch.from_arrays([pa.array(at + model.words[s])], names=["id"])

    stored = spark.createDataFrame([(r.shard,) for r in rows], "shard int") if rows else None
    if stored is not None:
        model.hot = {r.id: (0, 0, 0) for r in
                     stored.repartition(min(shards, 64)).mapInArrow(frequent, "id long").collect()}
    if model.texts > limit:
        model.hot[model.n_words] = (0, 0, 0)  # the start of a text

    def count_pairs(batches):
        reader, held = Reader(model), _Summer()
        for _, _, _, tokens, starts, _ in _texts(batches, "text"):
            ids, _, before, _ = _pairs(reader, tokens, starts)
            if held.add((before.astype(np.uint64) << _WORD_BITS) | ids.astype(np.uint64)):
                keys, counts = held.take()
                yield from _packed(keys, counts, pair_shard(keys, model))
        keys, counts = held.take()
        yield from _packed(keys, counts, pair_shard(keys, model))

    out_schema = "kind string, shard int, id long, n1 long, n2 long, n3 long, n4 long, packed binary"

    def store_pairs(table: pa.Table) -> pa.Table:
        s, keys, counts = merged(table)
        _store(root, f"pairs/{s}.once", keys[counts == 1])
        _store(root, f"pairs/{s}.more", keys[counts > 1])
        _store(root, f"pairs/{s}.count", counts[counts > 1])
        first = (keys >> _WORD_BITS).astype(np.int64)
        at = np.flatnonzero(np.diff(first, prepend=-1))
        by = np.stack([np.add.reduceat((counts == 1).astype(np.int64), at), np.add.reduceat((counts == 2).astype(np.int64), at),
                       np.add.reduceat((counts > 2).astype(np.int64), at)], 1)
        ids = first[at]
        hot = np.isin(ids, list(model.hot)) if model.hot else np.zeros(len(ids), bool)
        _store(root, f"contexts/{s}.id", ids[~hot])
        _store(root, f"contexts/{s}.n", by[~hot])
        rows = [("hot", s, int(i), *map(int, n), 0, None) for i, n in zip(ids[hot], by[hot])]
        rows.append(("rank", s, 0, *_of_counts(counts), None))
        second, n = np.unique(keys & _LOW, return_counts=True)
        to = np.searchsorted(model.words, second.astype(np.int64), "right") - 1
        for b in _packed(second, n, to):
            rows += [("word", t, 0, 0, 0, 0, 0, p) for t, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        names = ["kind", "shard", "id", "n1", "n2", "n3", "n4", "packed"]
        kinds_of = [pa.string(), pa.int32(), *[pa.int64()] * 5, pa.binary()]
        return pa.table({k: pa.array(c, t) for k, c, t in zip(names, zip(*rows), kinds_of)})

    from mnemo.llm.common import staged
    pairs = staged(lean.mapInArrow(count_pairs, "shard int, packed binary").repartition(shards, "shard")
                   .groupBy("shard").applyInArrow(store_pairs, out_schema), "pair_counts")
    small = pairs.where("kind <> 'word'").groupBy("kind", "id").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in (1, 2, 3, 4)])
    for r in small.collect():  # one row, and one for each frequent first word
        if r.kind == "hot":
            model.hot[r.id] = (r.n1, r.n2, r.n3)
        else:
            model.pair_discounts = _discounts([r.n1, r.n2, r.n3, r.n4])

    def store_continuations(table: pa.Table) -> pa.Table:
        s, keys, counts = merged(table)
        dense = np.zeros(model.words[s + 1] - model.words[s], np.uint32)
        dense[keys.astype(np.int64) - model.words[s]] = counts
        _store(root, f"continuation/{s}", dense)
        n = [*_of_counts(counts), int(counts.sum()), len(counts)]
        return pa.table({f"n{i}": [x] for i, x in enumerate(n)})

    got = (pairs.where("kind = 'word'").select("shard", "packed").repartition(shards, "shard").groupBy("shard")
           .applyInArrow(store_continuations, ", ".join(f"n{i} long" for i in range(6)))
           .agg(*[F.sum(f"n{i}") for i in range(6)]).first())
    n1, n2, n3, n4, model.continuations, n = (x or 0 for x in got)
    model.word_discounts = _discounts([n1, n2, n3, n4])
    model.continuation_ranks = n1, n2, n - n1 - n2
    return model


def _discounted(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return counts - np.array([0.0, *d])[np.minimum(counts, 3)]


def log_probabilities(reader: Reader, ids, before, before_counts) -> np.ndarray:
    """log10 p(word | word before); an id of -1 is an unknown word."""
    m = reader.model
    uniform = 1.0 / (m.n_words + 1)
    words, inverse = np.unique(ids, return_inverse=True)
    low = np.full(len(words), uniform)
    if m.continuations:
        spare = float(np.dot(m.word_discounts, m.continuation_ranks)) / m.continuations
        low *= spare
        known = words >= 0
        low[known] += _discounted(reader.continuation(words[known]), m.word_discounts) / m.continuations
    p = low[inverse]
    both = (before >= 0) & (before_counts > 0)
    if both.any():
        firsts, back = np.unique(before[both], return_inverse=True)
        spare = (reader.context_counts(firsts) @ np.array(m.pair_discounts))[back] / before_counts[both]
        p[both] *= spare
        seen = both & (ids >= 0)
        keys, back = np.unique((before[seen].astype(np.uint64) << _WORD_BITS) | ids[seen].astype(np.uint64),
                               return_inverse=True)
        p[seen] += _discounted(reader.pair_counts(keys), m.pair_discounts)[back] / before_counts[seen]
    return np.log10(p)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add n_tokens, n_known, train_tokens, base_score (add-0.1 unigrams) and score (the
    model's log10 probability) to ``docs``; null texts count as empty. Perplexity is
    10 ** (-score / n_tokens)."""
    out = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    key = fresh(docs, "_text")
    src = docs.withColumn(key, F.col(text)).drop(*[c for c in docs.columns if c.lower() in out])
    keep = [c for c in src.columns if c != key]
    schema = src.select(*keep).schema
    for n in out:
        schema = schema.add(n, "double" if n.endswith("score") else "long")

    def run(batches):
        reader = Reader(model)
        for batch, lo, hi, tokens, starts, _ in _texts(batches, key):
            ids, counts, before, before_counts = _pairs(reader, tokens, starts)
            n = np.diff(np.append(starts, len(tokens)))
            base = np.log10((counts + 0.1) / (model.tokens + 0.1 * (model.n_words + 1)))
            got = log_probabilities(reader, ids, before, before_counts)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(c)).slice(lo, hi - lo) for c in keep],
                 pa.array(n), pa.array(np.add.reduceat((ids >= 0).astype(np.int64), starts)),
                 pa.array(np.full(hi - lo, model.tokens)), pa.array(np.add.reduceat(base, starts)),
                 pa.array(np.add.reduceat(got, starts))], names=[*keep, *out])

    return src.mapInArrow(run, schema)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n
