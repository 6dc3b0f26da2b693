"""Words and word shingles of whole Arrow text columns as 64-bit hashes, vectorised in NumPy.

A word is a run of bytes outside space and 0x09-0x0D, with A-Z lower-cased. A
word's hash is a polynomial of its bytes, a shingle's a polynomial of its
words' hashes, both finished by a mixer; equal hashes count as equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, dtype=bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_BASE, _STEP = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_POW = np.ones(1, dtype=U)


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        with np.errstate(over="ignore"):
            _POW = np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(max(n, 64), _BASE, U)]))
    return _POW


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(30))
    h = h * _M1
    h = h ^ (h >> U(27))
    h = h * _M2
    return h ^ (h >> U(31))


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null texts are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def pieces(offs: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes, so that arrays stay in the caches; a longer text stands alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, side="right")) - 1)
        yield i, j
        i = j


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text, in order, and the number of words of each text."""
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(len(offs) - 1, np.int64)
    low = _LOWER[data]
    w = _WORD[low]
    left = np.empty(n, bool)
    left[0], left[1:] = False, w[:-1]
    left[offs[:-1][offs[:-1] < n]] = False
    st = np.flatnonzero(w & ~left)
    right = np.empty(n, bool)
    right[-1], right[:-1] = False, w[1:]
    right[offs[1:][offs[1:] > 0] - 1] = False
    ln = np.flatnonzero(w & ~right) + 1 - st
    counts = np.diff(np.searchsorted(st, offs))
    if not len(st):
        return np.zeros(0, U), counts
    first = np.cumsum(ln) - ln
    at = np.arange(int(ln.sum())) - np.repeat(first, ln)
    with np.errstate(over="ignore"):
        h = np.add.reduceat((low[w].astype(U) + U(1)) * _powers(int(ln.max()))[at], first)
        return mix(h + ln.astype(U) * _STEP), counts


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, one after the other, and the size of each text's set."""
    h, counts = word_hashes(data, offs)
    ends = np.cumsum(counts)
    ns = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    tot, out = np.cumsum(ns), np.empty(int(ns.sum()), U)
    with np.errstate(over="ignore"):
        if len(h) >= k:
            s = h[: len(h) - k + 1].copy()
            for i in range(1, k):
                s = s * _STEP + h[i : len(h) - k + 1 + i]
            s = mix(s)
        for c, e, m, t in zip(counts.tolist(), ends.tolist(), ns.tolist(), tot.tolist(), strict=True):
            if c >= k:
                part = s[e - c : e - k + 1]
                part.sort()
                out[t - m : t] = part
            elif c:
                v = h[e - c]
                for x in h[e - c + 1 : e]:
                    v = v * _STEP + x
                out[t - 1] = mix(np.array([v ^ U(c)]))[0]
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[(tot - ns)[ns > 0]] = True
    sizes = np.add.reduceat(np.concatenate([keep, [False]]).astype(np.int64), np.minimum(tot - ns, len(out))) if len(ns) else ns
    return out[keep], np.where(ns > 0, sizes, 0)
