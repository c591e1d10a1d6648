"""Cross-tokenizer alignment by an associative monoid of fragments.

Two tokenizers A and B cut the same bytes (a space and the text). Bytes where a token
of A and a token of B both end cut the tokens into groups. A *fragment* says what is known
of a range of bytes: the tokens that end in it, and the cuts between them. What stands
before its first cut is an open prefix, what stands after its last an open suffix, and
the groups between are closed. Two neighbouring fragments compose: the suffix of one and
the prefix of the other become one group, so composition is associative, and a document
may be folded in any grouping of its ranges.

A text is tokenised in segments: where a space stands between two other characters, of
which the second is no white space, tokens of both kinds begin, so what is before
and what is after are tokenised alike by themselves. The fragment of a segment is closed
on both sides; workers remember the segments they have seen. Documents longer than
``chunk`` bytes are cut into ranges of that many bytes, wherever that falls; a range's
task tokenises from the last segment border before it to the first after it and keeps the
tokens that end inside. A tree of reductions over the key (document, range) composes them,
``FAN`` neighbours at a time.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemo.llm.common import packed, staged

#: Bytes of a range; longer documents are aligned by several tasks.
CHUNK = 1 << 16
#: Neighbouring fragments that one reduction composes.
FAN = 8
#: Segments that a worker remembers. It bounds memory only; results don't depend on it.
CACHED = 300_000
#: Characters of a segment up to which A is run by its ranks; longer ones take the library's own merging.
BY_RANKS = 1_000
# fixed value: how a byte-level vocabulary cuts a text before it merges
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Id pairs that are broadcast at a time (16 bytes each); more are looked up in further passes.
PAIRS_AT_ONCE = 1_000_000

# a segment border: the space between a character that is no space and one that is no white space
_BORDER = re.compile(r"(?<=[^ ]) (?=\S)")
# the same in UTF-8, told by the first byte after the space; borders before scripts that
# share a first byte with some white space are left out, which makes a region longer only
_BORDER_BYTES = re.compile(rb"(?<=[^ ]) (?=[\x21-\x7e\xc3-\xe0\xe4-\xf4])")


def byte_alphabet() -> dict[str, int]:
    """The byte of each character of byte-level vocabularies: printable Latin-1 characters
    stand for themselves, the other bytes for the characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Ragged:
    """Rows of numbers of different lengths, kept end to end."""

    def __init__(self):
        self.flat = np.zeros(1 << 10, np.int64)
        self.stops = np.zeros(1 << 10, np.int64)  # the end of row i is at i + 1
        self.rows = 0

    def add(self, values: np.ndarray, counts: np.ndarray) -> None:
        end = int(self.stops[self.rows])
        while end + len(values) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.rows + len(counts) + 1 > len(self.stops):
            self.stops = np.concatenate([self.stops, np.zeros_like(self.stops)])
        self.flat[end:end + len(values)] = values
        self.stops[self.rows + 1:self.rows + 1 + len(counts)] = end + np.cumsum(counts)
        self.rows += len(counts)

    def counts(self) -> np.ndarray:
        return np.diff(self.stops[:self.rows + 1])

    def used(self) -> np.ndarray:
        return self.flat[:self.stops[self.rows]]

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows ``at`` end to end and their lengths."""
        first = self.stops[at]
        n = self.stops[at + 1] - first
        return self.flat[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``counts`` values."""
    total = np.concatenate([[0], np.cumsum(values)])
    stop = np.cumsum(counts)
    return total[stop] - total[stop - counts]


def links(a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A id << 32 | B id, end of their common bytes) of all tokens that share bytes: between
    two neighbouring ends, of whichever kind, there is one token of each."""
    ends = np.union1d(a_ends, b_ends)
    return a[np.searchsorted(a_ends, ends)] << 32 | b[np.searchsorted(b_ends, ends)], ends


def told(a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray) -> list[str]:
    """Tokens in the order of their groups as ids with the mark that follows each: ``|``
    after the A part of a group, ``;`` after its B part, ``,`` between ids."""
    a_group, b_group = np.repeat(np.arange(len(a_sizes)), a_sizes), np.repeat(np.arange(len(b_sizes)), b_sizes)
    a_before, b_before = np.cumsum(a_sizes), np.cumsum(b_sizes)
    place = np.concatenate([np.arange(len(a)) + (b_before - b_sizes)[a_group], np.arange(len(b)) + a_before[b_group]])
    mark = np.full(len(place), ",")
    mark[a_before - 1] = "|"
    mark[len(a) + b_before - 1] = ";"
    out = np.empty(len(place), object)
    out[place] = [f"{i}{m}" for i, m in zip(chain(a.tolist(), b.tolist()), mark.tolist())]
    return out.tolist()


class Tokenizers:
    """Both tokenizers, what their ids mean in bytes, and the segments seen so far. Only the
    files' contents travel to the workers."""

    def __init__(self, a_file: str, b_file: str):
        with open(a_file, encoding="utf-8") as f:
            self.a_text = f.read()
        with open(b_file, "rb") as f:
            self.b_blob = f.read()
        self._start()

    def __getstate__(self):
        return {"a_text": self.a_text, "b_blob": self.b_blob}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._start()

    def _start(self) -> None:
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer
        self.a, self.b = Tokenizer.from_str(self.a_text), sentencepiece.SentencePieceProcessor(model_proto=self.b_blob)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        byte = byte_alphabet()
        file = json.loads(self.a_text)
        special = {t["id"]: t["content"].encode() for t in file.get("added_tokens", [])}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for entry, i in self.a.get_vocab().items():
            self.a_bytes[i] = special[i] if i in special else bytes(byte[c] for c in entry)
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) else
                        p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.b.vocab_size())))]
        # where ids follow the order of the merges, they are ranks, and merging by ranks is the same but faster
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in file["model"]["merges"]]
        order = [file["model"]["vocab"][m] for m in merges]
        self.ranks = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={
            self.a_bytes[i]: i for i in file["model"]["vocab"].values()}, special_tokens={}) if order == sorted(order) else None
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.bad: list[int] = []  # rows of segments that are not given back byte by byte
        self.texts: list[str] = []
        self.a_ids, self.b_ids, self.a_groups, self.b_groups, self.links = (Ragged() for _ in range(5))

    def __len__(self) -> int:
        return self.a_ids.rows

    def tokens(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each segment (without the space before it) by A and by B."""
        slow = lambda s: self.a.encode(s, add_special_tokens=False).ids
        fast = self.ranks.encode_ordinary if self.ranks else slow
        return [fast(" " + s) if len(s) <= BY_RANKS else slow(" " + s) for s in segments], self.b.encode(segments, num_threads=1)

    def _learn(self, keys: list[str], segments: list[str]) -> None:
        a, b = self.tokens(segments)
        base = len(self)
        data = [b" " + s.encode() for s in segments]
        same = lambda ids, table, want: b"".join(map(table.__getitem__, ids)) == want
        if not (same(chain.from_iterable(a), self.a_bytes, whole := b"".join(data)) and same(chain.from_iterable(b), self.b_bytes, whole)):
            for i, d in enumerate(data):
                if not (same(a[i], self.a_bytes, d) and same(b[i], self.b_bytes, d)):
                    self.bad.append(base + i)
                    a[i] = b[i] = []
        a_n, b_n = (np.fromiter(map(len, t), np.int64, len(t)) for t in (a, b))
        a_flat, b_flat = (np.fromiter(chain.from_iterable(t), np.int64, int(n.sum())) for t, n in ((a, a_n), (b, b_n)))
        a_ends, b_ends = np.cumsum(self.a_sizes[a_flat]), np.cumsum(self.b_sizes[b_flat])
        stops = np.append(0, np.cumsum(sums(self.a_sizes[a_flat], a_n)))  # the bytes where segments end
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_groups, b_groups = (np.diff(np.searchsorted(e, cuts, "right"), prepend=0) for e in (a_ends, b_ends))
        n_groups = np.diff(np.searchsorted(cuts, stops, "right"))
        pairs, at = links(a_flat, b_flat, a_ends, b_ends)
        self.index.update(zip(keys, range(base, base + len(keys))))
        self.a_ids.add(a_flat, a_n)
        self.b_ids.add(b_flat, b_n)
        self.a_groups.add(a_groups, n_groups)
        self.b_groups.add(b_groups, n_groups)
        self.links.add(pairs, np.diff(np.searchsorted(at, stops, "right")))

    def strings(self) -> list[str]:
        """The groups of each segment as text; made for those that are asked for."""
        first = len(self.texts)
        if first < len(self):
            tables = self.a_ids, self.b_ids, self.a_groups, self.b_groups
            words = told(*[t.used()[t.stops[first]:] for t in tables])
            at = 0
            for to in np.cumsum(self.a_ids.counts()[first:] + self.b_ids.counts()[first:]).tolist():
                self.texts.append("".join(words[at:to])[:-1])
                at = to
        return self.texts

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the segments of all texts end to end, and how many each text has;
        texts that are empty or hold a segment that is not given back have none."""
        found = self.segments(texts)
        n = np.array([len(r) for r in found], np.int64)
        at = np.fromiter(chain.from_iterable(found), np.int64, int(n.sum()))
        use = np.array([bool(t) for t in texts], bool)
        if self.bad:
            use &= sums(np.isin(at, self.bad), n) == 0
        return at[np.repeat(use, n)], np.where(use, n, 0)

    def segments(self, texts: list[str]) -> list[list[int]]:
        """The rows of the segments of each text. A text of words with single spaces between
        them is cut by a plain split; a word that shows it is none of these is known as -1."""
        index = self.index
        cut = [t.split(" ") for t in texts]
        rows = [list(map(index.get, c)) for c in cut]
        lacking = [i for i, r in enumerate(rows) if None in r]
        if lacking:
            new = set(chain.from_iterable([w for w, i in zip(cut[k], rows[k]) if i is None] for k in lacking))
            odd = [w for w in new if not w or w[0].isspace()]
            index.update(dict.fromkeys(odd, -1))
            if plain := list(new.difference(odd)):
                self._learn(plain, plain)
            for i in lacking:
                rows[i] = list(map(index.__getitem__, cut[i]))
        slow = [i for i, r in enumerate(rows) if -1 in r]
        if slow:
            # a key that begins with a space is no word of a split
            named = {i: [(s if s and not s[0].isspace() else " " + s, s) for s in _BORDER.split(texts[i])] for i in slow}
            new_ = {k: s for pairs in named.values() for k, s in pairs if k not in index}
            if new_:
                self._learn(list(new_), list(new_.values()))
            for i in slow:
                rows[i] = [index[k] for k, _ in named[i]]
        return rows


# ------------------------------------------------------------------ fragments

Fragment = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # A ids, B ids, A sizes, B sizes


def fragment(a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, start: int, stop: int) -> Fragment:
    """The fragment of the bytes (start, stop]: the ids of the tokens that end there, and how
    many tokens of A and of B stand in its open prefix, in each closed group and in its
    open suffix. Without a cut there is one open part, and one size."""
    i, j = (slice(*np.searchsorted(e, [start, stop], "right")) for e in (a_ends, b_ends))
    cuts = np.intersect1d(a_ends[i], b_ends[j], assume_unique=True)
    sizes = [np.diff(np.searchsorted(e, cuts, "right"), prepend=0, append=len(e)) for e in (a_ends[i], b_ends[j])]
    return a[i], b[j], *sizes


def compose(parts: list[Fragment]) -> Fragment:
    """Neighbouring fragments as one: where two meet, suffix and prefix are one group."""
    def joined(sizes: list[np.ndarray]) -> np.ndarray:
        out = [sizes[0]]
        for s in sizes[1:]:
            meet = out[-1][-1:] + s[:1]
            out[-1] = out[-1][:-1]
            out += [np.concatenate([meet, s[1:]])]
        return np.concatenate(out)

    a, b, a_sizes, b_sizes = zip(*parts)
    return np.concatenate(a), np.concatenate(b), joined(list(a_sizes)), joined(list(b_sizes))


def groups(whole: Fragment) -> Fragment:
    """The closed groups of a whole document: its first byte begins a group and its last
    ends one, so the open prefix is the first group and the open suffix is empty."""
    a, b, a_sizes, b_sizes = whole
    return a, b, a_sizes[:-1], b_sizes[:-1]


def ranges(data: bytes, chunk: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, stop, from, to): ranges of about ``chunk`` bytes and the bytes that must be
    tokenised to know their tokens. A range holds at least one segment border, so no byte
    is tokenised by more than three tasks."""
    n = len(data)
    start = low = 0
    while start < n:
        stop, border = start, -1
        while border <= start and stop < n:
            stop = min(stop + chunk, n)
            border = data.rfind(b" ", start + 1, stop + 1)
            while border > start and not _BORDER_BYTES.match(data, border):
                border = data.rfind(b" ", start + 1, border)
        found = _BORDER_BYTES.search(data, stop) if stop < n else None
        yield start, stop, low, found.start() if found else n
        start, low = stop, border


FRAGMENT = T.StructType([T.StructField("key", T.StringType()), T.StructField("k", T.LongType()), T.StructField("good", T.BooleanType()),
                         *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("a_ids", "b_ids", "a_sizes", "b_sizes")]])
PARTS = ("a_ids", "b_ids", "a_sizes", "b_sizes")


def _ints(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([np.asarray(r, np.int32) for r in rows], pa.list_(pa.int32()))


def _slices(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, list]]:
    """(first row, texts) of a batch, about 2 MB of text at a time."""
    texts = batch.column(batch.schema.get_field_index(name))
    step = max(1, min(len(texts), 1 + int(2e6 * len(texts) / max(1, texts.nbytes))))
    for lo in range(0, len(texts), step):
        yield lo, [t or "" for t in texts.slice(lo, step).to_pylist()]


def long_fragments(long: DataFrame, shared, chunk: int) -> DataFrame:
    """The whole fragment of each distinct text of ``long`` (key, text): (key, good, ids and
    sizes). Ranges of equal texts are one; those of one text are spread over all tasks."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = b" " + text.as_py().encode()
                rows = [(key, k, start, stop, low, data[low:high].decode()) for k, (start, stop, low, high) in enumerate(ranges(data, chunk))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["key", "k", "start", "stop", "low", "region"])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Tokenizers = shared.value
        for batch in batches:
            for r in batch.to_pylist():
                if len(own) > CACHED:
                    own.forget()
                at = np.array(own.segments([r["region"][1:]])[0], np.int64)
                good = not np.isin(at, own.bad).any()
                at = at if good else at[:0]
                a, b = own.a_ids.gather(at)[0], own.b_ids.gather(at)[0]
                ends = r["low"] + np.cumsum(own.a_sizes[a]), r["low"] + np.cumsum(own.b_sizes[b])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["key"]]), pa.array([r["k"]], pa.int64()), pa.array([good]),
                     *[_ints([x]) for x in fragment(a, b, *ends, r["start"], r["stop"])]], names=FRAGMENT.names)

    def fold(table: pa.Table) -> pa.Table:
        rows = table.sort_by("at").to_pylist()
        whole = compose([tuple(np.array(r[c], np.int64) for c in PARTS) for r in rows])
        return pa.table([pa.array([rows[0]["key"]]), pa.array([rows[0]["k"]], pa.int64()), pa.array([all(r["good"] for r in rows)], pa.bool_()),
                         *[_ints([x]) for x in whole]], names=FRAGMENT.names)

    pieces = (long.mapInArrow(cut, "key string, k long, start long, stop long, low long, region string")
              .dropDuplicates(["key", "k"]))
    level = staged(pieces.mapInArrow(align, FRAGMENT), "fragments")
    width = (level.agg(F.max("k")).first()[0] or 0) + 1  # ranges of the longest text
    while width > 1:
        level = (level.withColumnRenamed("k", "at").withColumn("k", F.expr(f"`at` DIV {FAN}"))
                 .groupBy("key", "k").applyInArrow(fold, FRAGMENT))
        width = -(-width // FAN)
    return staged(level.drop("k"), "composed")


# ------------------------------------------------------------------ operators

def load(a_file: str, b_file: str) -> Tokenizers:
    """Tokenizer A (a byte-level BPE of the tokenizers library) and B (a SentencePiece BPE)."""
    return Tokenizers(a_file, b_file)


def _is_long(text: Column, chunk: int) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)) >= chunk


def _key(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


class Alignment:
    """The alignment of the texts of ``docs`` (any columns): short texts are aligned where
    they are read, as often as they are used; long ones are composed once and kept."""

    def __init__(self, docs: DataFrame, tokenizers: Tokenizers, text: str = "text", chunk: int = CHUNK):
        self.columns, self.text = docs.columns, text
        self.spark = docs.sparkSession
        self.shared = self.spark.sparkContext.broadcast(tokenizers)  # two vocabulary files
        own = packed(docs, [text])
        self.short = own.where(~_is_long(F.col(text), chunk))
        long = own.where(_is_long(F.col(text), chunk)).withColumn("_key", _key(F.col(text)))
        self.composed = long_fragments(long.select("_key", text), self.shared, chunk)
        self.long = long

    # -------------------------------------------------------------- groups

    def aligned(self) -> DataFrame:
        """``docs`` with ``a_ids``, ``b_ids`` and the groups' ``a_sizes`` and ``b_sizes`` (in
        tokens); empty arrays where a text has no tokens."""
        shared, text = self.shared, self.text
        kept = self.short.schema
        schema = T.StructType([*kept.fields, *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in PARTS]])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own: Tokenizers = shared.value
            for batch in batches:
                for lo, texts in _slices(batch, text):
                    if len(own) > CACHED:
                        own.forget()
                    at, n = own.rows(texts)
                    cols = []
                    for table in (own.a_ids, own.b_ids, own.a_groups, own.b_groups):
                        flat, lengths = table.gather(at)
                        cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sums(lengths, n))), pa.int32()),
                                                             pa.array(flat, pa.int32())))
                    yield pa.RecordBatch.from_arrays([*[c.slice(lo, len(texts)) for c in batch.columns], *cols], names=schema.names)

        def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = batch.to_pylist()
                done = [groups(tuple(np.array(r[c], np.int64) for c in PARTS)) if r["good"] else [()] * len(PARTS) for r in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(_ints, zip(*done))], names=["_key", *PARTS])

        short = self.short.mapInArrow(run, schema)
        whole = self.composed.withColumnRenamed("key", "_key").mapInArrow(
            close, T.StructType([T.StructField("_key", T.StringType()), *schema.fields[-4:]]))
        both = short.union(self.long.join(whole, "_key").select(*schema.names))
        return both.select(*[F.col(text) if c == text else F.col("_others").getField(c).alias(c)
                             for c in self.columns if c.lower() not in PARTS], *PARTS)

    # -------------------------------------------------------------- counts

    def pair_counts(self) -> DataFrame:
        """(a_id, b_id, pair, n, best): links of each id pair over all documents, and
        whether no pair of its B id has more. Workers add up what they have seen first."""
        shared, text = self.shared, self.text
        schema = "pair long, n long"

        def out(pairs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            order = np.argsort(pairs, kind="stable")
            pairs, n = pairs[order], n[order]
            first = np.flatnonzero(np.diff(pairs, prepend=-1))
            total = np.add.reduceat(n, first) if len(n) else n
            return pa.RecordBatch.from_arrays([pa.array(pairs[first]), pa.array(total)], names=["pair", "n"])

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own: Tokenizers = shared.value  # with the segments of the worker's tasks before
            seen = np.zeros(len(own), np.int64)

            def total():
                n = np.repeat(seen, own.links.counts())
                return out(own.links.used()[n > 0], n[n > 0])

            for batch in batches:
                for _, texts in _slices(batch, text):
                    if len(own) > CACHED:
                        yield total()
                        own.forget()
                        seen = np.zeros(0, np.int64)
                    at, _ = own.rows(texts)
                    more = np.bincount(at, minlength=len(own))
                    more[:len(seen)] += seen
                    seen = more
            yield total()

        def count_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own: Tokenizers = shared.value
            for batch in batches:
                for a, b, copies in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist()):
                    a, b = (np.asarray(x.values, np.int64) for x in (a, b))
                    pairs, _ = links(a, b, np.cumsum(own.a_sizes[a]), np.cumsum(own.b_sizes[b]))
                    yield out(pairs, np.full(len(pairs), copies))

        copies = self.long.groupBy(F.col("_key").alias("key")).agg(F.count(F.lit(1)).alias("copies"))
        whole = self.composed.where("good").join(copies, "key").select("a_ids", "b_ids", "copies")
        counted = (self.short.select(text).mapInArrow(count, schema).union(whole.mapInArrow(count_long, schema))
                   .groupBy("pair").agg(F.sum("n").alias("n")))
        counted = staged(counted.select(F.shiftright("pair", 32).cast("int").alias("a_id"), F.expr("CAST(pair & 4294967295L AS INT)").alias("b_id"),
                                        "pair", "n"), "pairs")
        most = counted.groupBy("b_id").agg(F.max("n").alias("_most"))  # at most the vocabulary of B
        return staged(counted.join(F.broadcast(most), "b_id").select(
            "a_id", "b_id", "pair", "n", (F.col("n") == F.col("_most")).alias("best")), "counted")

    # -------------------------------------------------------------- digests

    def digests(self, counts: DataFrame, at_once: int = PAIRS_AT_ONCE) -> DataFrame:
        """``docs`` without the text, with n_a, n_b, n_groups, n_links, n_best, count_sum
        and groups_sha256. The counts of ``pair_counts`` go to the workers ``at_once`` pairs
        at a time; what further passes find is added by text."""
        shared, text = self.shared, self.text
        parts = max(1, math.ceil(counts.count() / at_once))
        numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
        cols = [*[T.StructField(c, T.LongType()) for c in numbers], T.StructField("groups_sha256", T.StringType())]
        none = [0] * len(numbers) + [""]

        def table(i: int):
            rows = counts.where(F.pmod(F.xxhash64("pair"), F.lit(parts)) == i).select("pair", "n", "best").toArrow()
            order = np.argsort(rows["pair"].to_numpy())
            return self.spark.sparkContext.broadcast(tuple(rows[c].to_numpy()[order].astype(np.int64) for c in ("pair", "n", "best")))

        def look(known, pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(links of a best pair, sum of counts) of consecutive runs of ``n`` links."""
            keys, count, best = known
            if not len(keys):
                return np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            i = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
            hit = keys[i] == pairs
            return sums(np.where(hit, best[i], 0), n), sums(np.where(hit, count[i], 0), n)

        def short_rows(known) -> DataFrame:
            src = self.short.withColumn("_key", _key(F.col(text)) if parts > 1 else F.lit(None).cast("string"))
            schema = T.StructType([src.schema["_others"], src.schema["_key"], *cols])

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                own: Tokenizers = shared.value
                stats = np.zeros((0, 5), np.int64)
                for batch in batches:
                    for lo, texts in _slices(batch, text):
                        if len(own) > CACHED:
                            own.forget()
                            stats = stats[:0]
                        at, n = own.rows(texts)
                        if len(stats) < len(own):  # new segments
                            new = slice(len(stats), len(own))
                            best, total = look(known.value, own.links.used()[own.links.stops[len(stats)]:], own.links.counts()[new])
                            stats = np.concatenate([stats, np.stack([own.a_ids.counts()[new], own.b_ids.counts()[new],
                                                                     own.a_groups.counts()[new], best, total], 1)])
                        got = np.stack([sums(stats[at, c], n) for c in range(5)], 1).tolist()
                        strings = own.strings().__getitem__
                        rows, first, made = at.tolist(), 0, []
                        for stop, (n_a, n_b, n_g, best, total) in zip(np.cumsum(n).tolist(), got):
                            text_ = ";".join(map(strings, rows[first:stop]))
                            made.append([n_a, n_b, n_g, n_a + n_b - n_g, best, total,
                                         hashlib.sha256(text_.encode()).hexdigest()] if stop > first else none)
                            first = stop
                        yield pa.RecordBatch.from_arrays(
                            [*[batch.column(batch.schema.get_field_index(c)).slice(lo, len(texts)) for c in ("_others", "_key")],
                             *[pa.array(c, f) for c, f in zip(zip(*made), [pa.int64()] * len(numbers) + [pa.string()])]], names=schema.names)

            return src.mapInArrow(run, schema)

        def long_rows(known) -> DataFrame:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                own: Tokenizers = shared.value
                for batch in batches:
                    for r in batch.to_pylist():
                        made = none
                        if r["good"]:
                            a, b, a_sizes, b_sizes = groups(tuple(np.array(r[c], np.int64) for c in PARTS))
                            pairs, _ = links(a, b, np.cumsum(own.a_sizes[a]), np.cumsum(own.b_sizes[b]))
                            best, total = look(known.value, pairs, np.array([len(pairs)]))
                            made = [len(a), len(b), len(a_sizes), len(pairs), int(best[0]), int(total[0]),
                                    hashlib.sha256("".join(told(a, b, a_sizes, b_sizes))[:-1].encode()).hexdigest()]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([r["key"]]), *[pa.array([x], f) for x, f in zip(made, [pa.int64()] * len(numbers) + [pa.string()])]],
                            names=["_key", *numbers, "groups_sha256"])

            whole = self.composed.mapInArrow(run, T.StructType([T.StructField("_key", T.StringType()), *cols]))
            return self.long.select("_others", "_key").join(whole, "_key").select("_others", "_key", *numbers, "groups_sha256")

        tables = [table(i) for i in range(parts)]
        found = [short_rows(t).union(long_rows(t)) for t in tables]
        out = found[0]
        if parts > 1:
            # n_best and count_sum are the text's, so each part's are taken once a text
            more = None
            for i, f in enumerate(found[1:]):
                f = f.select("_key", F.lit(i).alias("_part"), F.col("n_best").alias("_best"), F.col("count_sum").alias("_sum"))
                more = f if more is None else more.union(f)
            more = (more.groupBy("_key", "_part").agg(F.max("_best").alias("_best"), F.max("_sum").alias("_sum"))
                    .groupBy("_key").agg(F.sum("_best").alias("_best"), F.sum("_sum").alias("_sum")))
            out = (out.join(more, "_key", "left").withColumn("n_best", F.col("n_best") + F.coalesce("_best", F.lit(0)))
                   .withColumn("count_sum", F.col("count_sum") + F.coalesce("_sum", F.lit(0))))
        made = [*numbers, "groups_sha256"]
        others = [c for c in self.columns if c != text and c.lower() not in made]
        return out.select(*[F.col("_others").getField(c).alias(c) for c in others], *made)


def align(docs: DataFrame, tokenizers: Tokenizers, text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Add ``a_ids``, ``b_ids``, ``a_sizes`` and ``b_sizes`` to ``docs``: the tokens of both
    tokenizers and how many of each stand in every group.

    Texts that are null or empty, or whose tokens don't give a space and the text back byte
    by byte, have empty arrays. Columns that are called like an output are replaced;
    repeated rows are kept.
    """
    return Alignment(docs, tokenizers, text, chunk).aligned()
