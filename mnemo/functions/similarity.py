"""Normalised indel similarity (0-100) between two strings.

similarity = (1 - (len a + len b - 2*LCS) / (len a + len b)) * 100, 100 for two
empty strings and 0 when either side is null. LCS uses the bit-parallel
recurrence of Allison & Dix / Hyyrö (v = (v + u) | (v - u) with u = v & match
mask), one Python big-int word per string, inside an Arrow-batched pandas UDF.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from mnemo.functions.text import rint2


def lcs_length(a: str, b: str) -> int:
    if not a or not b:
        return 0
    if len(a) > len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        m = masks.get(ch)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def indel_ratio_py(a: str | None, b: str | None) -> float:
    if a is None or b is None:
        return 0.0
    total = len(a) + len(b)
    if total == 0:
        return 100.0
    dist = total - 2 * lcs_length(a, b)
    return (1.0 - dist / total) * 100.0


_WORD = 64
_MOST_WORDS = 4  # beyond, Python integers are faster: 1.1 s against 1.5 s for 3,000 pairs of 400 characters
_CHUNK = 4096
_MEAN_WIDTH = 128  # that a full chunk may have


def _codes(strings: list[str], lens: np.ndarray, width: int, pad: int) -> np.ndarray:
    """Code points of each string in a row of a (n, width) matrix, padded with ``pad``."""
    out = np.full((len(strings), width), pad, dtype=np.int32)
    flat = np.frombuffer("".join(strings).encode("utf-32-le"), dtype="<u4").astype(np.int32)
    if flat.size:
        rows = np.repeat(np.arange(len(strings)), lens)
        cols = np.arange(flat.size) - np.repeat(np.cumsum(lens) - lens, lens)
        out[rows, cols] = flat
    return out


def _lcs_words(a: list[str], b: list[str]) -> np.ndarray:
    """LCS lengths of pairs whose shorter strings take a few words each."""
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b)]
    plen, tlen = (np.array([len(p[k]) for p in pairs], np.int64) for k in (0, 1))
    out = np.zeros(len(pairs), np.int64)
    order = np.lexsort((tlen, plen))
    start = 0
    while start < order.size:
        words = -(-int(plen[order[start]]) // _WORD)
        stop = int(np.searchsorted(plen[order], words * _WORD, "right"))  # pairs of as many words
        stop = min(stop, start + max(1, _CHUNK * _MEAN_WIDTH // (words * int(tlen[order[start:stop]].max()))))
        sel = order[start:stop]
        start = stop
        pc = _codes([pairs[k][0] for k in sel], plen[sel], int(plen[sel].max()), -1)
        tc = _codes([pairs[k][1] for k in sel], tlen[sel], int(tlen[sel].max()), -1)
        # each row's masks by the number of a character: of those in the patterns, or none
        known = np.unique(pc)
        code = lambda c: np.where(known[(i := np.minimum(np.searchsorted(known, c), known.size - 1))] == c, i, known.size)
        pk, tk = code(pc), code(tc)
        rows = np.arange(sel.size)
        masks = np.zeros((words, sel.size, known.size + 1), np.uint64)
        for i in range(pc.shape[1]):
            masks[i // _WORD, rows, pk[:, i]] |= np.where(pc[:, i] >= 0, np.uint64(1) << np.uint64(i % _WORD), np.uint64(0))
        masks[:, :, np.append(known == -1, True)] = 0  # what pads a row is no character
        full = [np.where(plen[sel] >= (w + 1) * _WORD, ~np.uint64(0),
                         (np.uint64(1) << np.maximum(plen[sel] - w * _WORD, 0).astype(np.uint64) % np.uint64(_WORD)) - np.uint64(1))
                for w in range(words)]
        v = [f.copy() for f in full]
        for j in range(tc.shape[1]):
            carry = np.zeros(sel.size, np.uint64)
            at = tk[:, j]
            for w in range(words):
                u = v[w] & masks[w, rows, at]
                total = v[w] + u
                over = total < u
                total += carry
                carry = (over | (total < carry)).astype(np.uint64)
                v[w] = (total | (v[w] ^ u)) & full[w]
        out[sel] = plen[sel] - sum(np.bitwise_count(x).astype(np.int64) for x in v)
    return out


def lcs_batch(a: list[str], b: list[str], la: np.ndarray | None = None, lb: np.ndarray | None = None) -> np.ndarray:
    """LCS lengths for many pairs at once.

    Pairs whose shorter string fits one 64-bit word run the bit-parallel
    recurrence on numpy uint64 vectors, one lane per pair (rows sorted by length
    so padding stays small). Up to ``_MOST_WORDS`` words a lane has several, with carries
    between them. Beyond that one Python integer a pair is faster than many words in lanes.
    """
    n = len(a)
    out = np.zeros(n, dtype=np.int64)
    la = np.fromiter(map(len, a), dtype=np.int64, count=n) if la is None else la
    lb = np.fromiter(map(len, b), dtype=np.int64, count=n) if lb is None else lb
    short = np.minimum(la, lb)
    for i in np.nonzero(short > _WORD * _MOST_WORDS)[0]:
        out[i] = lcs_length(a[i], b[i])
    middle = np.nonzero((short > _WORD) & (short <= _WORD * _MOST_WORDS))[0]
    if middle.size:
        out[middle] = _lcs_words([a[i] for i in middle], [b[i] for i in middle])
    idx = np.nonzero((short > 0) & (short <= _WORD))[0]
    if idx.size == 0:
        return out
    swap = la[idx] > lb[idx]
    pat = [b[i] if s else a[i] for i, s in zip(idx.tolist(), swap.tolist())]
    txt = [a[i] if s else b[i] for i, s in zip(idx.tolist(), swap.tolist())]
    plen = np.minimum(la[idx], lb[idx])
    tlen = np.maximum(la[idx], lb[idx])
    order = np.lexsort((tlen, plen))
    one = np.uint64(1)
    # a chunk is bounded by rows x width, so one long text doesn't widen thousands of short pairs
    cuts, begin = [], 0
    while begin < order.size:
        rows = min(_CHUNK, order.size - begin)
        while rows > 1 and rows * int(tlen[order[begin:begin + rows]].max()) > _CHUNK * _MEAN_WIDTH:
            rows //= 2
        cuts.append((begin, begin + rows))
        begin += rows
    for start, stop in cuts:
        sel = order[start:stop]
        pw, tw = int(plen[sel].max()), int(tlen[sel].max())
        sl = sel.tolist()
        pc = _codes([pat[k] for k in sl], plen[sel], pw, -1)
        tc = _codes([txt[k] for k in sl], tlen[sel], tw, -2)
        match = np.zeros((sel.size, tw), dtype=np.uint64)
        for i in range(pw):
            match |= (pc[:, i:i + 1] == tc).astype(np.uint64) << np.uint64(i)
        m = plen[sel].astype(np.uint64)
        mask = np.where(m == _WORD, np.uint64(0xFFFFFFFFFFFFFFFF), (one << np.minimum(m, 63)) - one)
        v = mask.copy()
        for j in range(tw):
            u = v & match[:, j]
            v = ((v + u) | (v - u)) & mask
        out[idx[sel]] = plen[sel] - np.bitwise_count(v).astype(np.int64)
    return out


def indel_ratio_array(a: pd.Series, b: pd.Series) -> np.ndarray:
    """indel similarity for two aligned series; NaN where either side is null."""
    out = np.full(len(a), np.nan)
    idx = np.nonzero((a.notna() & b.notna()).to_numpy())[0]
    if idx.size == 0:
        return out
    aa = a.to_numpy(dtype=object)[idx].tolist()
    bb = b.to_numpy(dtype=object)[idx].tolist()
    la = np.fromiter(map(len, aa), dtype=np.int64, count=len(aa))
    lb = np.fromiter(map(len, bb), dtype=np.int64, count=len(bb))
    lcs = lcs_batch(aa, bb, la, lb)
    total = la + lb
    with np.errstate(divide="ignore", invalid="ignore"):
        out[idx] = np.where(total == 0, 100.0, (1.0 - (total - 2 * lcs) / total) * 100.0)
    return out


def indel_ratio_batch(a: list, b: list) -> list:
    """indel_ratio_py over lists; None where either side is None."""
    r = indel_ratio_array(pd.Series(a, dtype=object), pd.Series(b, dtype=object))
    return [None if np.isnan(x) else float(x) for x in r]


@F.pandas_udf(DoubleType())
def _indel_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(indel_ratio_array(a, b))  # NaN becomes null on the way back to Spark


@F.pandas_udf(DoubleType())
def _indel_ratio_here_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(indel_ratio_array(a, b))


# "not deterministic" is for the planner alone: it moves no filter on the ratio, and with it the
# kernel, below a repartition or a distinct that stands there so that the kernel runs after it
_indel_ratio_here_udf = _indel_ratio_here_udf.asNondeterministic()


def register_functions(spark) -> None:
    """Make ``indel_ratio(a, b)`` (0 to 100, null if a side is null) known to SQL."""
    spark.udf.register("indel_ratio", _indel_ratio_udf)


def indel_ratio(a, b) -> Column:
    """Unrounded similarity; null when either input is null (callers that need
    the library's null-as-0 rule wrap it in coalesce)."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return _indel_ratio_udf(a, b)


def indel_ratio_here(a: str, b: str) -> Column:
    """:func:`indel_ratio` that stays where it is written: it runs on the rows and in the
    partitions that it is given, not on those before a repartition or a distinct."""
    return _indel_ratio_here_udf(F.col(a), F.col(b))


def similarity(a, b) -> Column:
    """Similarity rounded to two decimals; equal strings short-cut to 100."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    raw = F.coalesce(indel_ratio(a, b), F.lit(0.0))
    return F.when(a == b, F.lit(100.0)).otherwise(rint2(raw))


def length_bound(a, b) -> Column:
    """Upper bound of the similarity from the lengths alone (LCS <= shorter length)."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return length_bound_of(F.length(a), F.length(b))


def length_bound_of(la: Column, lb: Column) -> Column:
    """:func:`length_bound` for strings of these lengths."""
    return F.when(la + lb == 0, F.lit(100.0)).otherwise(
        F.least(la, lb).cast("double") * 200.0 / (la + lb))


#: 64-bit words of a bag signature.
BAG_WORDS = 4


def bag_signature(col) -> Column:
    """An array of ``BAG_WORDS`` longs: a set bit for each (character, how often it has
    occurred so far) of a string, at a place told by a hash. An inserted or deleted
    character adds or takes away one such pair, so two strings' signatures differ in no more
    bits than their indel distance."""
    c = F.col(col) if isinstance(col, str) else col
    chars = F.array_sort(F.filter(F.split(c, ""), lambda x: x != ""))
    place = F.transform(chars, lambda x, i: F.pmod(F.xxhash64(x, i - F.array_position(chars, x)), F.lit(64 * BAG_WORDS)).cast("int"))
    return F.array(*[F.aggregate(F.filter(place, lambda p: F.floor(p / 64) == w), F.lit(0).cast("long"),  # noqa: B023 - evaluated at once
                                 lambda bits, p: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (p % 64).cast("int"))))
                     for w in range(BAG_WORDS)])


def bag_bound_ok(sig_a, sig_b, len_a, len_b, threshold: float) -> Column:
    """False only when strings with these signatures and lengths cannot reach ``threshold``:
    a few machine instructions a pair, so it can stand in a join's condition."""
    differ = sum((F.bit_count(F.get(sig_a, F.lit(w)).bitwiseXOR(F.get(sig_b, F.lit(w)))) for w in range(BAG_WORDS)), F.lit(0))
    return differ <= (len_a + len_b).cast("double") * F.lit((100.0 - float(threshold)) / 100.0) + F.lit(1e-6)


def edit_bound_ok(a, b, threshold: float) -> Column:
    """False only when the pair cannot reach ``threshold``.

    Levenshtein distance L never exceeds the indel distance, so similarity <=
    100 * (T - L) / T with T = len a + len b. ``levenshtein`` with a per-row
    threshold stops early (returns -1) once L exceeds T * (100 - threshold) / 100,
    all in the JVM, so most hopeless pairs never reach the Python kernel.
    """
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    total = F.length(a) + F.length(b)
    max_lev = F.floor(total.cast("double") * F.lit((100.0 - float(threshold)) / 100.0) + F.lit(1e-6)).cast("int")
    return F.call_function("levenshtein", a, b, max_lev) >= 0


def passes(sim: Column, threshold: float, strict: bool) -> Column:
    return sim > F.lit(float(threshold)) if strict else sim >= F.lit(float(threshold))


def similarity_flag(a, b, threshold: float, strict: bool, rounded: bool = True) -> Column:
    """0 when the (rounded) similarity passes the threshold, else 1.

    Equal strings pass without a kernel call and pairs whose length bound is
    clearly below the threshold fail without one: the UDF receives nulls for
    them and returns at once.
    """
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    need = ((a != b) & (length_bound(a, b) >= F.lit(float(threshold) - 0.5))
            & edit_bound_ok(a, b, float(threshold) - 0.5))
    raw = indel_ratio(F.when(need, a), F.when(need, b))
    sim = rint2(raw) if rounded else raw
    return (F.when(a == b, F.lit(0))
            .when(~need | a.isNull() | b.isNull(), F.lit(1))
            .when(passes(sim, threshold, strict), F.lit(0))
            .otherwise(F.lit(1)))
