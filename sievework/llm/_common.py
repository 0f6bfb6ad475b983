"""What the operators of this subpackage share: session set-up and hashed words."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components, cut, discard
from ..session import ready

__all__ = ["components", "cut", "discard", "ready", "small", "word_hashes", "shingles", "mix", "power_tables", "as_bytes", "SPACES", "NON_WORD", "BROADCAST_BYTES"]

#: What is broadcast has at most so many bytes. Beyond that rows are shuffled to it.
BROADCAST_BYTES = 16 << 20


def small(df: DataFrame) -> DataFrame:
    """A frame that is cut off already, marked for broadcast if its rows, all of fixed width, have few enough bytes; else Spark shuffles."""
    width = 8 * (1 + len(df.columns))
    fixed = all(kind in ("bigint", "int", "double", "boolean") for _, kind in df.dtypes)
    return F.broadcast(df) if fixed and df.count() * width <= BROADCAST_BYTES else df


# -- hashed words -----------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PIECE = 1 << 20

#: Bytes between words: white space only, or all that is no letter, digit or byte of a longer code point.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NON_WORD = np.array([not (chr(b).isalnum() and b < 128) and b < 128 for b in range(256)])

_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_powers: list[np.ndarray] = []


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of an odd base, and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        tables = []
        for b in (_BASE, _INVERSE):
            t = np.full(size, b, dtype=np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers[:] = tables
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _hash_piece(raw: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(raw)
    outside = np.ones(n + 2, dtype=bool)
    np.take(gaps, raw, out=outside[1:-1])
    edges = np.flatnonzero(outside[1:] != outside[:-1])
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return np.empty(0, np.uint64), start, end
    power, inverse = power_tables(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    sums = total[1:]
    np.take(_BYTE, raw, out=sums)
    sums *= power[:n]
    np.cumsum(sums, out=sums)
    h = total[end]
    h -= total[start]
    h *= inverse[start]
    h += (end - start).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(h), start, end


def word_hashes(data: bytes, gaps: np.ndarray = SPACES, spans: bool = False):
    """A 64-bit hash of each word of UTF-8 ``data``, A-Z lower-cased, in order.

    Words are the runs of bytes outside ``gaps``. The text is worked through in
    pieces of about 1 MB that end between words, so temporary memory doesn't grow
    with a text. With ``spans`` also the byte offsets where words start and end.
    """
    whole = np.frombuffer(data, dtype=np.uint8)
    hashes, starts, ends, at = [], [], [], 0
    while at < len(whole):
        to = min(len(whole), at + _PIECE)
        while to < len(whole) and not gaps[whole[to]]:
            step = np.flatnonzero(gaps[whole[to : to + _PIECE]])
            to = to + int(step[0]) if len(step) else min(len(whole), to + _PIECE)
        h, s, e = _hash_piece(whole[at:to], gaps)
        hashes.append(h)
        if spans:
            starts.append(s + at)
            ends.append(e + at)
        at = to
    join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
    if spans:
        return join(hashes, np.uint64), join(starts, np.int64), join(ends, np.int64)
    return join(hashes, np.uint64)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` words; a shorter, non-empty sequence is one shingle."""
    if not len(words):
        return words
    if len(words) < k:
        return mix(_chained(words, len(words)) + np.uint64(len(words)))
    return mix(_chained(words, k))


def _chained(words: np.ndarray, k: int) -> np.ndarray:
    n = len(words) - k + 1
    h = words[:n].copy()
    for i in range(1, k):
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
        h += words[i : n + i]
    return h


def as_bytes(column) -> list[bytes]:
    """The values of an Arrow string column as UTF-8, null as empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]
