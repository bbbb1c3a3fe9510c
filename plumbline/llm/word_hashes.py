"""64-bit hashes of words, for a whole Arrow column at a time and without a table of words.

A word is a run of bytes other than space and U+0009..U+000D.  Its hash is a polynomial over a
random number for each byte, modulo 2**64, taken from prefix sums over the column's bytes, and
mixed; memory is some fifty times the bytes of the column, so callers pass slices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
_BASE = 0xD6E8FEB86659FD93  # 3 modulo 8
_BACK = pow(_BASE, -1, 2**64)
_known: list[np.ndarray] = [np.ones(1, np.uint64)] * 2


def _powers(n: int) -> list[np.ndarray]:
    """Powers 0 to n of the base and of its inverse; those for slices of the usual size are kept."""
    global _known
    if len(_known[0]) > n:
        return _known
    found = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, x, np.uint64))]) for x in (_BASE, _BACK)]
    if n <= 1 << 20:
        _known = found
    return found


def words(col: pa.Array, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a string column: where each row's words begin in the arrays that follow (rows + 1 numbers), starts and ends
    of all words in the bytes, their hashes, and the bytes.  ``fold``: A-Z count as a-z.  Null is empty."""
    col = pc.fill_null(col.cast(pa.string()), "")
    _, offsets, data = col.buffers()
    o = np.frombuffer(offsets, np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
    o = o - o[0]
    n = len(raw)
    inside = ~_SPACE[raw]
    edge = np.ones(n + 1, bool)  # a word can't run over the place before byte i
    edge[1:n] = False
    edge[o] = True
    edge[1:n] |= ~inside[:-1]
    starts = np.flatnonzero(inside & edge[:-1])
    edge[1:n] = False
    edge[o] = True
    edge[1:n] |= ~inside[1:]
    ends = np.flatnonzero(inside & edge[1:]) + 1
    power, back = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _BYTES)[raw] * power[:n], out=total[1:])
    h = mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64) * U(0xA0761D6478BD642F))
    return np.searchsorted(starts, o), starts, ends, h, raw
