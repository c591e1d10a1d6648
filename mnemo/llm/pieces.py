"""SentencePiece BPE encoding and decoding with byte offsets.

The model file is read as data (its protobuf fields, nothing else of the library is
used). A text is normalised by longest-prefix matches through the compiled character
map, where every normalised character keeps the original bytes it came from; each piece
is then projected to the span of original bytes that it covers.

No piece of a white-space-splitting vocabulary holds a space mark after another
character, so merges never cross such a border. The text is therefore cut there, every
distinct word is merged once and kept by the worker, and a document's ids are the segments' ids in
a row. Vocabularies without that property are merged over the whole text.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemo.llm.common import fresh

MARK = "▁"
# fixed values of the model format: kinds of pieces
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words that a worker remembers. It bounds memory only; results don't depend on it.
CACHED = 400_000
NEVER = float("inf")


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        c = b[i]
        i += 1
        value |= (c & 127) << shift
        if c < 128:
            return value, i
        shift += 7


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) pairs of one protobuf message."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(b, i)
        else:
            n, i = (8, i) if kind == 1 else (4, i) if kind == 5 else _varint(b, i)
            value = b[i:i + n]
            i += n
        yield tag >> 3, value


class CharacterMap:
    """The compiled normalisation rules: a double-array trie over UTF-8 prefixes, each
    leaf pointing at its zero-ended replacement. ``longest`` is the longest rule that a
    byte string starts with at ``i``."""

    def __init__(self, blob: bytes):
        self.units: np.ndarray | list[int] = []
        self.texts = b""
        if blob:
            (n,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, "<u4", n // 4, 4).tolist()
            self.texts = blob[4 + n:]

    def __bool__(self) -> bool:
        return bool(self.units)

    def longest(self, data: bytes, i: int) -> tuple[int, bytes] | None:
        units, found = self.units, None
        at, unit = 0, units[0]
        for j in range(i, len(data)):
            at ^= (unit >> 10) << ((unit & 512) >> 6)  # the unit's offset field
            at ^= data[j]
            unit = units[at]
            if unit & 0x800000FF != data[j]:  # the label does not match: no such edge
                break
            if unit & 256:  # a rule ends here; its value sits at the offset
                leaf = units[at ^ ((unit >> 10) << ((unit & 512) >> 6))] & 0x7FFFFFFF
                found = (j + 1 - i, self.texts[leaf:self.texts.index(b"\0", leaf)])
            # the next round adds the offset of this unit
        return found


class PieceModel:
    """A BPE SentencePiece model as plain data."""

    def __init__(self, blob: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        norm: dict = {}
        trainer: dict = {}
        for k, v in _fields(blob):
            if k == 1:
                d = dict(_fields(v))
                self.pieces.append(d[1].decode())
                self.scores.append(struct.unpack("<f", d[2])[0] if 2 in d else 0.0)
                self.kinds.append(d.get(3, NORMAL))
            elif k == 2:
                trainer = dict(_fields(v))
            elif k == 3:
                norm = dict(_fields(v))
        if trainer.get(3, 1) != 2:
            raise ValueError("only BPE models are supported")
        self.unknown = self.kinds.index(UNKNOWN)
        self.unknown_text = trainer.get(44, " ⁇ ".encode()).decode()
        self.fallback = bool(trainer.get(35, 0))
        self.map = CharacterMap(norm.get(2, b""))
        self.prefix = bool(norm.get(3, 1))
        self.squeeze = bool(norm.get(4, 1))
        self.escape = bool(norm.get(5, 1))
        self.eos = next((i for i, k in enumerate(self.kinds) if k == CONTROL and self.pieces[i] == "</s>"), None)
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] in (NORMAL, USER, UNUSED)}
        self.rank = {p: (-self.scores[i], i) for p, i in self.ids.items() if self.kinds[i] != UNUSED}
        # unused pieces may join further pieces but are split again at the end
        self.unused = {p for p, i in self.ids.items() if self.kinds[i] == UNUSED}
        self.rank |= {p: (-self.scores[self.ids[p]], self.ids[p]) for p in self.unused}
        self.cost = {p: r for p, (r, _) in self.rank.items()}.get
        self.user = sorted((p for p, i in self.ids.items() if self.kinds[i] == USER), key=len, reverse=True)
        self.byte_ids = [0] * 256
        for i, p in enumerate(self.pieces):
            if self.kinds[i] == BYTE:
                self.byte_ids[int(p[3:-1], 16)] = i
        self.separable = not self.user and not any(MARK in p.lstrip(MARK) for p in self.rank)
        self.segment = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        # what an id adds to a text by itself; None: that depends on its neighbours
        self.surface = [p.replace(MARK, " ") if k in (NORMAL, USER, UNUSED) else
                        chr(int(p[3:-1], 16)) if k == BYTE and int(p[3:-1], 16) < 128 else None
                        for p, k in zip(self.pieces, self.kinds)]
        # characters that an id covers; of the bytes of a character the first covers it
        self.covers = np.array([int(not 0x80 <= int(p[3:-1], 16) < 0xC0) if k == BYTE else len(p)
                                for p, k in zip(self.pieces, self.kinds)], np.int32)
        self.simple = self.separable and self.fallback and self.prefix and self.escape and not self.map and not self.squeeze
        self.words: dict[str, tuple[int, ...]] = {}
        self.now: dict[str, tuple[int, ...]] = {}  # words of the batch at hand
        self.joins: tuple[np.ndarray, np.ndarray] | None = None

    # ---------------------------------------------------------------- normalising

    def normalise(self, text: str) -> tuple[str, list[int] | None]:
        """The normalised text and, for each of its characters and its end, the original
        byte offset where it begins. None instead of offsets: with no character map and
        no squeezing, they follow from the characters alone."""
        if not self.map and not self.squeeze:
            body = text.replace(" ", MARK) if self.escape else text
            return ((MARK if self.escape else " ") + body if self.prefix and text else body), None
        data = text.encode("utf-8")
        chars: list[str] = []
        starts: list[int] = []
        i = 0
        while i < len(data):
            hit = self.map.longest(data, i) if self.map else None
            if hit:
                n, new = hit[0], hit[1].decode()
            else:
                n = 1 if data[i] < 0x80 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
                new = data[i:i + n].decode()
            for c in new:
                if not (self.squeeze and c == " " and (not chars or chars[-1] == " ")):
                    chars.append(c)
                    starts.append(i)
            i += n
        end = len(data)
        while self.squeeze and chars and chars[-1] == " ":
            chars.pop()
            end = starts.pop()
        if self.prefix and chars:
            chars.insert(0, " ")
            starts.insert(0, starts[0])
        out = "".join(chars)
        return (out.replace(" ", MARK) if self.escape else out), [*starts, end]

    # ---------------------------------------------------------------- merging

    def merge(self, s: str) -> list[str]:
        """The pieces of ``s``: again and again the adjacent pair whose join has the best
        score (leftmost first) is joined."""
        parts: list[str] = list(s)
        if self.separable and not self.unused and len(parts) <= 48:
            # a short list is scanned faster than a heap is kept
            cost = self.cost
            costs = [cost(s[i:i + 2], NEVER) for i in range(len(s) - 1)]
            while costs and (best := min(costs)) is not NEVER:
                i = costs.index(best)
                new = parts[i] + parts.pop(i + 1)
                parts[i] = new
                if i:
                    costs[i - 1] = cost(parts[i - 1] + new, NEVER)
                del costs[i]
                if i < len(costs):
                    costs[i] = cost(new + parts[i + 1], NEVER)
            return parts
        if self.user:
            parts = [p for p in re.split("(" + "|".join(map(re.escape, self.user)) + ")|(.)", s, flags=re.S) if p]
        fixed = set(self.user)
        n = len(parts)
        rank = self.rank
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        joined: dict[str, tuple[str, str]] = {}

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < n and parts[a] not in fixed and parts[b] not in fixed:
                new = parts[a] + parts[b]
                if new in rank:
                    heapq.heappush(heap, (rank[new][0], a, b, new))
                    if new in self.unused:
                        joined[new] = (parts[a], parts[b])

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, new = heapq.heappop(heap)
            if not parts[a] or after[a] != b or parts[a] + parts[b] != new:
                continue  # one side has been joined otherwise meanwhile
            parts[a], parts[b] = new, ""
            after[a] = after[b]
            if after[a] < n:
                before[after[a]] = a
            offer(before[a], a)
            offer(a, after[a])
        out = [p for p in parts if p]
        while any(p in joined for p in out):
            out = [q for p in out for q in joined.get(p, (p,))]
        return out

    def encode_segment(self, s: str) -> tuple[int, ...]:
        """Ids of a segment. A piece outside the vocabulary becomes the ids of its bytes
        or, in a model without those, the unknown id."""
        found: list[int] = []
        for p in self.merge(s):
            i = self.ids.get(p)
            if i is not None:
                found.append(i)
            elif self.fallback:
                found.extend(self.byte_ids[c] for c in p.encode("utf-8"))
            elif not found or found[-1] != self.unknown:  # unknown pieces in a row are one
                found.append(self.unknown)
        return tuple(found)

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of a word and the mark before it."""
        return self.encode_segment(MARK + word)

    def _joins(self) -> tuple[np.ndarray, np.ndarray]:
        """(left id << 32 | right id, joined id) of every pair of pieces that joins."""
        if self.joins is None:
            got = sorted((self.ids[p[:k]] << 32 | self.ids[p[k:]], i) for p, i in self.ids.items()
                         for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids)
            self.joins = tuple(np.array(x, np.int64) for x in zip(*got)) if got else (np.array([-1]), np.array([0]))
        return self.joins

    def learn(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """``encode_word`` of many words at once. Words of one length are the rows of a
        matrix; each round joins the best pair of every row, so rows stay equally long,
        and a row without a pair left is done."""
        found: dict[str, tuple[int, ...]] = {}
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w) + 1, []).append(w)
        keys, joined = self._joins()
        scores = np.array(self.scores)
        for n, group in by_length.items():
            if n > 48:  # rare; a heap takes fewer rounds
                found.update((w, self.encode_word(w)) for w in group)
                continue
            points = np.frombuffer("".join(MARK + w for w in group).encode("utf-32-le"), np.uint32).reshape(-1, n)
            chars, at = np.unique(points, return_inverse=True)
            # a character that is no piece joins nothing: a negative number stands for it
            row = np.array([self.ids.get(chr(c), -1 - int(c)) for c in chars], np.int64)[at].reshape(points.shape)
            live = np.arange(len(group))

            def look(left, right):
                want = left << 32 | right
                i = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                hit = keys[i] == want
                new = np.where(hit, joined[i], 0)
                return np.where(hit, -scores[new], np.inf), new

            cost, new = look(row[:, :-1], row[:, 1:])
            while len(live):
                best = np.argmin(cost, axis=1) if cost.shape[1] else np.zeros(len(live), int)
                rows = np.arange(len(live))
                done = ~np.isfinite(cost[rows, best]) if cost.shape[1] else np.ones(len(live), bool)
                strange = (row[done] < 0).any(axis=1).tolist()
                for i, ids, odd in zip(live[done].tolist(), row[done].tolist(), strange):
                    found[group[i]] = tuple(chain.from_iterable(
                        (x,) if x >= 0 else [self.byte_ids[c] for c in chr(-1 - x).encode("utf-8")] for x in ids
                    )) if odd else tuple(ids)
                on = ~done
                live, row, cost, new, best = live[on], row[on], cost[on], new[on], best[on]
                if not len(live):
                    break
                rows = np.arange(len(live))
                row[rows, best] = new[rows, best]
                keep = np.arange(row.shape[1] - 1)
                row = np.take_along_axis(row, keep + (keep > best[:, None]), 1)
                keep = np.arange(cost.shape[1] - 1)
                shift = keep + (keep >= best[:, None])
                cost, new = np.take_along_axis(cost, shift, 1), np.take_along_axis(new, shift, 1)
                for side in (best - 1, best):  # the pairs on both sides of the joined piece
                    r = np.flatnonzero((side >= 0) & (side < cost.shape[1]))
                    if len(r):
                        c = side[r]
                        cost[r, c], new[r, c] = look(row[r, c], row[r, c + 1])
        return found

    def encode_batch(self, texts: list[str]) -> list[tuple[list[int], np.ndarray]]:
        """``encode`` of each text; their new words are merged together."""
        if self.simple and not self.unused:
            fresh_words = set(chain.from_iterable(t.split(" ") for t in texts)).difference(self.words)
            got = self.learn([w for w in fresh_words if w and MARK not in w])
            self.now = got
            if len(self.words) + len(got) <= CACHED:
                self.words.update(got)
        out = [self.encode(t) for t in texts]
        self.now = {}
        return out

    def _unknown_ends(self, cuts: list[str]) -> tuple[list[int], np.ndarray]:
        """Ids and ends by character where unknown ids, which may cover anything, occur."""
        ids: list[int] = []
        ends: list[int] = []
        at = 0
        for p in chain.from_iterable(map(self.merge, cuts)):
            at += len(p)
            i = self.ids.get(p, self.unknown)
            if i == self.unknown and ids and ids[-1] == i:
                ends[-1] = at
            else:
                ids.append(i)
                ends.append(at)
        return ids, np.array(ends, np.int32)

    def encode(self, text: str) -> tuple[list[int], np.ndarray]:
        """Ids (no end id) and the original UTF-8 byte offset where each id's span ends;
        its span begins where the one before ends."""
        starts = None
        if self.simple and text and "  " not in text and text[0] != " " != text[-1] and MARK not in text:
            # single spaces: the segments are the words, each with the mark before it
            cuts = text.split(" ")
            found = list(map(self.words.get, cuts))
            if None in found:
                found = [f or self.now.get(c) or self.encode_word(c) for f, c in zip(found, cuts)]
        else:
            s, starts = self.normalise(text)
            cuts = self.segment.findall(s) if self.separable else [s] if s else []
            found = [self.encode_segment(c) for c in cuts]
        ids = list(chain.from_iterable(found))
        if self.fallback or self.unknown not in ids:
            ends = np.cumsum(self.covers[ids] if ids else np.zeros(0, np.int32), dtype=np.int32)
        else:
            ids, ends = self._unknown_ends(cuts)
        if starts is not None:
            return ids, np.array(starts, np.int32)[ends]
        # only the mark put before the text has no byte of its own; a space has one
        ends -= int(self.prefix and bool(text))
        if text.isascii():
            return ids, ends
        wide = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        byte_at = np.zeros(len(wide) + 1, np.int32)
        np.cumsum(1 + (wide > 0x7F) + (wide > 0x7FF) + (wide > 0xFFFF), out=byte_at[1:])
        return ids, byte_at[ends]

    # ---------------------------------------------------------------- decoding

    def decode(self, ids: list[int]) -> str:
        """The text of ids. Control ids have no text, byte ids in a row are UTF-8 with
        U+FFFD for each byte that fits nowhere; the mark put before the text goes."""
        body = ids[:-1] if ids and ids[-1] == self.eos else ids
        plain = list(map(self.surface.__getitem__, body))
        if None not in plain:  # no part of a multi-byte character: every id stands for itself
            if plain and (self.prefix or self.squeeze) and self.kinds[body[0]] != BYTE and plain[0][:1] == " ":
                plain[0] = plain[0].lstrip(" ") if self.squeeze else plain[0][1:]
                if self.squeeze and not plain[0]:
                    return self._decode_slowly(ids)
            return "".join(plain)
        return self._decode_slowly(ids)

    def _decode_slowly(self, ids: list[int]) -> str:
        out: list[str] = []
        raw = bytearray()
        kinds, pieces, first = self.kinds, self.pieces, self.prefix or self.squeeze
        for i in ids:
            kind = kinds[i]
            if kind == BYTE:
                raw.append(int(pieces[i][3:-1], 16))
                continue
            if raw:
                out.append(self._bytes(raw))
                raw.clear()
                first = False
            if kind == CONTROL:
                continue
            if kind == UNKNOWN:
                out.append(self.unknown_text)
            else:
                p = pieces[i]
                if first and p[0] == MARK:
                    p = p[1:] if not self.squeeze else p.lstrip(MARK)
                out.append(p.replace(MARK, " "))
            first = False
        if raw:
            out.append(self._bytes(raw))
        return "".join(out)

    @staticmethod
    def _bytes(raw: bytearray) -> str:
        good = bytes(raw)
        try:
            return good.decode("utf-8")
        except UnicodeDecodeError:
            out, i = [], 0
            while i < len(good):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(good[i:i + n].decode("utf-8"))
                        i += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    i += 1
            return "".join(out)


def load_model(path: str) -> PieceModel:
    with open(path, "rb") as f:
        return PieceModel(f.read())


OUTPUTS = {"ids": T.ArrayType(T.IntegerType()), "ends": T.ArrayType(T.IntegerType()), "decoded": T.StringType()}


def encode_pieces(docs: DataFrame, model_file: str, text: str = "text", end_id: bool = True,
                  outputs: tuple[str, ...] = tuple(OUTPUTS)) -> DataFrame:
    """Add ``ids`` (array<int>), ``ends`` (array<int>: the UTF-8 byte of the text where
    each id's span ends; spans follow one another without gaps) and ``decoded`` to
    ``docs``, or those of them in ``outputs``; its other columns are kept.

    A null text counts as empty: only the end id, whose span is empty. White space,
    NULs and characters outside the vocabulary are encoded as the model says. The model
    file (under 1 MB) is read on the driver and broadcast, so a worker keeps the words
    that it has merged from one task to the next.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_model(model_file))
    out = list(outputs)
    clash = [c for c in docs.columns if c.lower() in out]
    key = fresh(docs, "_text")
    src = docs.withColumn(key, F.coalesce(F.col(text), F.lit(""))).drop(*clash)
    schema = T.StructType([*src.drop(key).schema.fields, *[T.StructField(n, OUTPUTS[n]) for n in out]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        stop = [model.eos] if end_id and model.eos is not None else []
        for batch in batches:
            keep = [n for n in batch.schema.names if n != key]
            texts = batch.column(batch.schema.get_field_index(key))
            step = max(1, min(len(texts), 1 + int(2e6 * len(texts) / max(1, texts.nbytes))))
            for lo in range(0, len(texts), step):  # a few MB of text at a time
                pairs = [(i + stop, e) for i, e in model.encode_batch(texts.slice(lo, step).to_pylist())]
                made = {"ids": lambda: pa.array([np.array(i, np.int32) for i, _ in pairs], pa.list_(pa.int32())),
                        "ends": lambda: pa.array([np.append(e, [e[-1] if len(e) else 0] * len(stop)).astype(np.int32)
                                                  for _, e in pairs], pa.list_(pa.int32())),
                        "decoded": lambda: pa.array([model.decode(i) for i, _ in pairs], pa.string())}  # noqa: B023
                cols = [batch.column(batch.schema.get_field_index(n)).slice(lo, step) for n in keep]
                yield pa.RecordBatch.from_arrays([*cols, *[made[n]() for n in out]], names=[*keep, *out])

    return src.mapInArrow(run, schema)


def digest(encoded: DataFrame) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 beside the id of each document."""
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
