"""NumPy kernels over the UTF-8 bytes of many texts: rolling hashes and word shingles.

A byte string's hash is a polynomial over a random 64-bit value for each byte,
taken modulo 2**64 and mixed; prefix sums give the hash of any range at once.
Different strings share a 64-bit hash with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


@lru_cache(maxsize=1)
def _values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """The byte values with A-Z as a-z."""
    v = _values().copy()
    v[65:91] = v[97:123]
    return v


_TOGETHER = 1 << 19
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse, kept per process."""
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def prefix(data: np.ndarray, fold: bool = False) -> np.ndarray:
    """Prefix sums from which :func:`ranges` takes hashes; one longer than the bytes."""
    n = len(data)
    out = np.zeros(n + 1, np.uint64)
    np.cumsum((_folded() if fold else _values())[data] * _power(n)[1][:n], out=out[1:])
    return out


def ranges(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The mixed hash of each byte range; equal bytes give equal hashes wherever they stand."""
    return mix((sums[ends] - sums[starts]) * _power(len(sums))[0][starts])


def fixed(sums: np.ndarray, k: int) -> np.ndarray:
    """The mixed hash of every range of ``k`` bytes."""
    n = len(sums) - 1 - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    return mix((sums[k : k + n] - sums[:n]) * _power(len(sums))[0][:n])


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array, one text after the other, and the n + 1 offsets; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


@lru_cache(maxsize=1)
def _blank() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes (A-Z folded) of all words, and the n + 1 offsets of each text's words among them.

    Whole texts are taken together up to about ``_TOGETHER`` bytes, which bounds what is held at once.
    """
    starts, ends, hashes, i = [], [], [], 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + _TOGETHER, side="right")) - 1)
        a, b, h = _words(data[at[i] : at[j]], at[i : j + 1] - at[i])
        starts.append(a + at[i])
        ends.append(b + at[i])
        hashes.append(h)
        i = j
    join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
    found = join(starts, np.int64)
    return found, join(ends, np.int64), join(hashes, np.uint64), np.searchsorted(found, at)


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    solid = ~_blank()[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    begins, last = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(last) + 1
    return starts, ends, ranges(prefix(data, True), starts, ends) if len(starts) else np.empty(0, np.uint64)


def shingles(hashes: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every run of ``k`` words within a text, and the n + 1 offsets; a text of fewer words has one, of none no run.

    A run's hash is a weighted sum of its words' hashes, mixed.
    """
    counts = np.diff(at)
    runs = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(runs)])
    weights = mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(_INVERSE)) | np.uint64(1)
    first = np.repeat(at[:-1] - out_at[:-1], runs) + np.arange(out_at[-1])
    total = np.zeros(len(first), np.uint64)
    short = np.repeat(counts < k, runs)
    size = np.repeat(np.minimum(counts, k), runs)
    for j in range(k):
        there = np.minimum(first + j, max(len(hashes) - 1, 0))
        part = hashes[there] * weights[j]
        total += np.where(size > j, part, np.uint64(0)) if short.any() else part
    return mix(total + size.astype(np.uint64)), out_at
