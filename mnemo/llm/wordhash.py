"""Word hashes of many texts at once, in numpy.

The texts of an Arrow batch are laid out as bytes. A word's hash is a polynomial over a
random table of its bytes, taken as a difference of running sums, so no Python loop
touches single words. Words are maximal runs of anything but ASCII white space; A-Z are
lower-cased first. 64-bit hashes of different words differ but for odds of n**2 / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE[65:91] = _TABLE[97:123]  # A-Z hash as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text that are worked on at a time; a longer single text is one piece.
PIECE = 1 << 19

def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse. They are made for each batch and go with it:
    code that Spark ships refers to itself in circles, so what it held would stay."""
    up, down = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)])) for b in (_BASE, _INVERSE))
    return up, down


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of ordered pairs of hashes."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + (b ^ np.uint64(0xA0761D6478BD642F)))


def _hashes(data: np.ndarray, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of the words of a byte array, given the powers for its length."""
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), starts


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())


def word_hashes(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, hashes of the rows' words in order, first word of
    each row and the number of words) for runs of rows of about ``PIECE`` bytes. Nulls
    have no words."""
    lengths = np.array([0 if n is None else n for n in _lengths(texts)], np.int64)
    lo = 0
    total = np.concatenate([[0], np.cumsum(lengths + 1)])
    up, down = _power_tables(min(int(total[-1]), PIECE) + 2)
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + PIECE, "right")) - 1)
        part = texts.slice(lo, hi - lo)
        data = np.frombuffer(b" ".join(x.as_py() or b"" for x in part) + b" ", np.uint8)
        if len(data) + 1 > len(up):
            up, down = _power_tables(len(data) + 1)  # a long single text
        hashes, starts = _hashes(data, up, down)
        first = np.searchsorted(starts, np.append(total[lo:hi] - total[lo], len(data)))
        yield lo, hi, hashes, first
        lo = hi


def _lengths(texts: pa.Array) -> list[int | None]:
    import pyarrow.compute as pc
    return pc.binary_length(texts).to_pylist()
