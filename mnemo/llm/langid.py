"""Language identification by a bidirectional gated recurrent network over bytes.

Two GRUs read the UTF-8 bytes of a text forwards and backwards; every position gets the
probabilities of the languages from both states, and a document's are the means over its
positions. The network is trained in numpy by backpropagation through time on windows of
a bounded sample of labelled documents, every position bearing its document's language.

Texts of any length are labelled whole: they are cut into segments, each read with a
run-in of the bytes beside it, and thousands of segments of an Arrow batch go through the
network side by side, so that a step is one small matrix product for all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemo.llm.common import fresh

UNDETERMINED = "und"
HAS_LETTERS = r"\p{L}"


@dataclass(frozen=True)
class Settings:
    """``per_language`` bounds the training sample: so many distinct texts of each
    language, ``windows`` pieces of ``chars`` code points of each. ``languages`` bounds how
    many there may be; more are an error."""
    hidden: int = 8
    per_language: int = 300
    windows: int = 4
    chars: int = 96
    languages: int = 200
    steps: int = 400
    rate: float = 0.02
    batch: int = 192
    segment: int = 192
    run_in: int = 16
    seed: int = 5


@dataclass
class Network:
    """Weights of both directions (0 forwards, 1 backwards): ``byte`` (3H, 256) holds what
    a byte adds to the update, reset and candidate sums, ``state`` (3H, H) what the state
    adds, ``bias`` (3H, 1) goes with the latter; ``out`` (K, 2H) and ``base`` (K, 1) make the
    labels."""
    languages: list[str]
    byte: list[np.ndarray]
    state: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    base: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [*self.byte, *self.state, *self.bias, self.out, self.base]


def new_network(languages: list[str], s: Settings) -> Network:
    rng = np.random.default_rng(s.seed)
    h, k = s.hidden, len(languages)

    def of(*shape, scale):
        return rng.normal(0, scale, shape).astype(np.float32)

    return Network(languages, [of(3 * h, 256, scale=0.3) for _ in "fb"], [of(3 * h, h, scale=h ** -0.5) for _ in "fb"],
                   [np.concatenate([np.ones((h, 1)), np.zeros((2 * h, 1))]).astype(np.float32) for _ in "fb"],
                   of(k, 2 * h, scale=0.3), np.zeros((k, 1), np.float32))


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _softmax(x):
    e = np.exp(x - x.max(axis=-2, keepdims=True))
    return e / e.sum(axis=-2, keepdims=True)


def gradients(net: Network, data: np.ndarray, valid: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over the valid positions of ``data`` (steps, rows) and its
    gradients, by backpropagation through time in both directions."""
    steps, rows = data.shape
    h = net.state[0].shape[1]
    kept, states = [], []
    for d in (0, 1):
        now, trace, seen = np.zeros((h, rows), np.float32), [], np.zeros((steps, h, rows), np.float32)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            a = net.byte[d][:, data[t]]
            u = net.state[d] @ now + net.bias[d]
            z, r = _sigmoid(a[:h] + u[:h]), _sigmoid(a[h:2 * h] + u[h:2 * h])
            n = np.tanh(a[2 * h:] + r * u[2 * h:])
            on = valid[t]
            trace.append((t, now, z, r, n, u[2 * h:], on))
            now = np.where(on, (1 - z) * n + z * now, now)
            seen[t] = now
        kept.append(trace)
        states.append(seen)
    both = np.concatenate(states, axis=1)
    p = _softmax(net.out @ both + net.base)
    total = valid.sum()
    at = np.arange(rows)
    loss = -float((np.log(p[:, label, at] + 1e-12) * valid).sum() / total)
    d_logit = p
    d_logit[:, label, at] -= 1
    d_logit *= valid[:, None, :] / total
    g_out = np.einsum("tkn,thn->kh", d_logit, both)
    g_base = d_logit.sum(axis=(0, 2))[:, None]
    d_both = np.einsum("kh,tkn->thn", net.out, d_logit)
    g = [[], [], []]
    for d in (0, 1):
        g_byte = np.zeros((256, 3 * h), np.float32)
        g_state, g_bias = np.zeros_like(net.state[d]), np.zeros_like(net.bias[d])
        back = np.zeros((h, rows), np.float32)
        for t, before, z, r, n, un, on in reversed(kept[d]):
            d_now = d_both[t, d * h:(d + 1) * h] + back
            d_n = d_now * (1 - z) * (1 - n * n) * on
            d_z = d_now * (before - n) * z * (1 - z) * on
            d_r = d_n * un * r * (1 - r)
            d_u = np.concatenate([d_z, d_r, d_n * r])
            back = np.where(on, d_now * z, d_now) + net.state[d].T @ d_u
            g_state += d_u @ before.T
            g_bias += d_u.sum(axis=1, keepdims=True)
            np.add.at(g_byte, data[t], np.concatenate([d_z, d_r, d_n]).T)
        for x, y in zip(g, (g_byte.T, g_state, g_bias)):
            x.append(y)
    return loss, [*g[0], *g[1], *g[2], g_out, g_base]


def train(samples: list[tuple[str, str]], s: Settings = Settings()) -> Network:
    """Fit a network to (text window, language) pairs with Adam; each language counts alike
    whatever its share of the pairs. The same pairs give the same network."""
    languages = sorted({lang for _, lang in samples})
    net = new_network(languages, s)
    if not samples:
        return net
    of = {lang: [w.encode("utf-8")[:2 * s.chars] for w, x in sorted(samples) if x == lang and w] for lang in languages}
    rng = np.random.default_rng(s.seed + 1)
    first = [np.zeros_like(w) for w in net.weights()]
    second = [np.zeros_like(w) for w in net.weights()]
    for step in range(1, s.steps + 1):
        label = rng.integers(0, len(languages), s.batch)
        chosen = [of[languages[i]][rng.integers(len(of[languages[i]]))] for i in label]
        size = 64
        data, valid = np.zeros((size, s.batch), np.int64), np.zeros((size, s.batch), bool)
        for j, w in enumerate(chosen):
            lo = int(rng.integers(0, max(1, len(w) - size + 1)))
            # short pieces as well, so that short texts are met in training
            n = min(len(w) - lo, size if step % 3 else int(rng.integers(3, size)))
            data[:n, j], valid[:n, j] = np.frombuffer(w, np.uint8, n, lo), True
        _, grads = gradients(net, data, valid, label)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = s.rate * min(1.0, 1.5 - 1.5 * step / (s.steps + 1) + 0.02)
        for w, g, m, v in zip(net.weights(), grads, first, second):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
    return net


class Labeller:
    """The network laid out for labelling many segments at once."""

    def __init__(self, net: Network, s: Settings):
        self.s, self.h, self.k = s, s.hidden, len(net.languages)
        # half the gate sums, as sigmoid(x) = (1 + tanh(x / 2)) / 2
        half = np.ones((3 * s.hidden, 1), np.float32)
        half[:2 * s.hidden] = 0.5
        self.byte = [np.ascontiguousarray(w * half) for w in net.byte]
        # the candidate's bias stays inside the product with the reset gate
        self.state = [np.ascontiguousarray(np.hstack([w, b]) * half) for w, b in zip(net.state, net.bias)]
        self.out = [np.ascontiguousarray(net.out[:, d * s.hidden:(d + 1) * s.hidden]) for d in (0, 1)]
        self.base = net.base

    def _step(self, d: int, symbols: np.ndarray, now: np.ndarray, a: np.ndarray, u: np.ndarray) -> None:
        """One step of direction ``d``: ``now`` (H + 1, rows; the last row is 1) changes in place."""
        h = self.h
        np.take(self.byte[d], symbols, axis=1, out=a, mode="clip")
        np.matmul(self.state[d], now, out=u)
        gates = a[:2 * h]
        gates += u[:2 * h]
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        n = a[2 * h:]
        u[2 * h:] *= gates[h:]
        n += u[2 * h:]
        np.tanh(n, out=n)
        state = now[:h]
        state -= n
        state *= gates[:h]
        state += n

    def pooled(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
        """(texts, K) mean probabilities over the bytes of each text, which lies at
        data[begin:end]; texts without bytes have zeros. ``labels`` takes every byte's class."""
        s, h = self.s, self.h
        cuts = -(-(end - begin) // s.segment)
        text = np.repeat(np.arange(len(begin)), cuts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        start = begin[text] + nth * s.segment
        size = np.minimum(end[text] - start, s.segment)
        total = np.zeros((len(begin), self.k))
        order = np.argsort(size, kind="stable")
        for lo in range(0, len(order), 2048):
            at = order[lo:lo + 2048]
            longest, rows = int(size[at].max()), len(at)
            place = start[at] + np.arange(-s.run_in, longest + s.run_in)[:, None]
            inside = (place >= begin[text[at]]) & (place < end[text[at]])
            symbols = data[np.clip(place, 0, len(data) - 1)].astype(np.intp)
            whole = inside.all(axis=1)
            a, u = np.empty((3 * h, rows), np.float32), np.empty((3 * h, rows), np.float32)
            seen = np.empty((longest, self.k, rows), np.float32)
            now = np.zeros((h + 1, rows), np.float32)
            now[h] = 1
            for t in range(longest + s.run_in):
                self._step(0, symbols[t], now, a, u)
                if not whole[t]:
                    now[:h] *= inside[t]  # outside the text there is no state
                if t >= s.run_in:
                    np.matmul(self.out[0], now[:h], out=seen[t - s.run_in])
            now[:h] = 0
            logit = np.empty((self.k, rows), np.float32)
            sums = np.zeros((self.k, rows))
            for t in range(longest + 2 * s.run_in - 1, s.run_in - 1, -1):
                self._step(1, symbols[t], now, a, u)
                if not whole[t]:
                    now[:h] *= inside[t]
                if t < longest + s.run_in:
                    np.matmul(self.out[1], now[:h], out=logit)
                    logit += seen[t - s.run_in]
                    logit += self.base
                    if labels is not None:
                        mine = t - s.run_in < size[at]
                        labels[place[t][mine]] = np.argmax(logit, axis=0)[mine]
                    np.exp(logit, out=logit)  # sums of bounded states: no overflow
                    logit /= logit.sum(axis=0)
                    if not whole[t] or longest > int(size[at].min()):
                        logit *= t - s.run_in < size[at]
                    sums += logit
            np.add.at(total, text[at], sums.T)
        return total / np.maximum(end - begin, 1)[:, None]


def training_sample(docs: DataFrame, s: Settings = Settings(), text: str = "text", lang: str = "lang") -> list[tuple[str, str]]:
    """At most ``per_language * windows`` (window, language) pairs a language, from rows with
    a language and letters: of each language's distinct texts those of the least hashes.
    Copies of a text count once, so no language is without a sample and none has more. Of
    more than ``languages`` languages those of the most distinct texts are learnt (ties by name)."""
    usable = (docs.select(F.col(text).alias("t"), F.col(lang).alias("l")).where(F.col("l").isNotNull() & F.col("t").rlike(HAS_LETTERS))
              .withColumn("h", F.xxhash64("t")))
    counts = {r.l: r.n for r in usable.select("l", "h").distinct().groupBy("l").agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.col("n").desc(), "l").limit(s.languages).collect()}
    usable = usable.where(F.col("l").isin(sorted(counts))) if counts else usable
    draw = F.shiftrightunsigned("h", 11).cast("double") / F.lit(float(1 << 53))
    spots = F.transform(F.sequence(F.lit(0), F.lit(s.windows - 1)), lambda i: F.substring(
        F.col("t"), (1 + F.pmod(F.xxhash64("t", i), F.greatest(F.length("t") - s.chars, F.lit(1)))).cast("int"), F.lit(s.chars)))
    out: list[tuple[str, str]] = []
    # so many are asked for that fewer than per_language come about never; then more are
    ask = s.per_language + 6 * math.sqrt(s.per_language) + 20
    while counts:
        share = F.create_map(*[F.lit(x) for lang_, n in sorted(counts.items()) for x in (lang_, min(1.0, ask / n))])
        rows = usable.where(draw < share[F.col("l")]).select("l", "h", spots.alias("w")).dropDuplicates(["l", "h"]).collect()
        found: dict[str, list] = {}
        for r in sorted(rows, key=lambda r: r.h % (1 << 64)):
            found.setdefault(r.l, []).append(r)
        for lang_, n in sorted(counts.items()):
            mine = found.get(lang_, [])
            if len(mine) >= min(n, s.per_language) or ask >= n:
                out += [(w, lang_) for r in mine[:s.per_language] for w in r.w if w]
                del counts[lang_]
        ask *= 4
    return out


def identify(docs: DataFrame, net: Network, s: Settings = Settings(), text: str = "text", positions: bool = False) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (the mean probability of that language) to ``docs``;
    with ``positions`` also ``byte_langs``, the place in ``net.languages`` of each byte's
    language, a byte each.

    A null text, a text without letters, and every text if nothing could be learnt is
    ``und`` with score 0. Ties go to the first language by code point. Other columns are kept.
    """
    out = ["lang_pred", "score", *["byte_langs"] * positions]
    key, flag = fresh(docs, "_text"), fresh(docs, "_letters")
    src = docs.drop(*[c for c in docs.columns if c.lower() in out])
    keep = src.columns
    src = src.withColumn(key, F.col(text)).withColumn(flag, F.coalesce(F.col(key).rlike(HAS_LETTERS), F.lit(False)))
    schema = T.StructType([*src.select(*keep).schema.fields, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()),
                           *[T.StructField("byte_langs", T.BinaryType())] * positions])
    names = np.array([*net.languages, UNDETERMINED], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(all="ignore"):
            yield from label(batches)

    def label(batches):
        labeller = Labeller(net, s)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(key)).cast(pa.large_binary())
            letters = np.array(batch.column(batch.schema.get_field_index(flag)).to_pylist(), bool)
            step = max(1, min(len(texts), 1 + int(2e6 * len(texts) / max(1, texts.nbytes))))
            for lo in range(0, len(texts), step):
                parts = [x.as_py() or b"" for x in texts.slice(lo, step)]
                ends = np.cumsum([len(x) for x in parts])
                data = np.frombuffer(b"".join(parts) or b"\0", np.uint8)
                marks = np.zeros(len(data), np.uint8) if positions else None
                mean = labeller.pooled(data, ends - [len(x) for x in parts], ends, marks) if net.languages \
                    else np.zeros((len(parts), 1))
                known = letters[lo:lo + step] & bool(net.languages)
                best = np.where(known, np.argmax(mean, axis=1), len(net.languages))
                score = np.where(known, np.clip(mean.max(axis=1), 0, 1), 0.0)
                cols = [batch.column(batch.schema.get_field_index(c)).slice(lo, step) for c in keep]
                cols += [pa.array(names[best].tolist(), pa.string()), pa.array(score)]
                if positions:
                    cols.append(pa.array([marks[b - len(x):b].tobytes() for b, x in zip(ends, parts)], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, *out])

    return src.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Documents that are never learnt from: crc32 of the id's text modulo 4 is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn(docs: DataFrame, s: Settings = Settings()) -> Network:
    """A network for the languages of ``docs`` (doc_id, text, lang), from rows not held out."""
    return train(training_sample(docs.where(~held_out(F.col("doc_id"))), s), s)
