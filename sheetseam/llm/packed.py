"""Packed shuffles: many small records travel as one binary row per (task batch, shard).

Records that only numpy touches (hashes with the row they came from) would cost the JVM a row each.
Here a task sorts its records, cuts them by shard and hands over arrays as bytes; Spark still partitions, moves and
retries the rows.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pandas as pd
import pyarrow as pa

_ODD = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes hashed at a time; a text longer than this is cut at white space.
CHUNK = 1 << 20
_powers: list[np.ndarray] = []


def returned(frame):
    """The frame or batch, after memory that this worker no longer uses has gone back to the system.

    Workers outlive their tasks; without this each keeps the most it ever needed, beside the other
    workers of its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
    return frame


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            p = np.cumprod(p, dtype=np.uint64)
            _powers[k : k + 1] = [p]
    return _powers[0][:n], _powers[1][:n]


def _words_of(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of a chunk."""
    space = _SPACE[b]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _power(len(b) + 1)
    sums = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[b] * up[:-1], out=sums[1:])
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _ODD), start


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts (A-Z lower-cased, split at ASCII white space) and, for each
    text, where its words begin (one more entry than texts)."""
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    out, begins, n = [], [0], 0
    k = 0
    while k < len(raw):
        if len(raw[k]) > CHUNK:
            count, at, whole = 0, 0, raw[k]
            while at < len(whole):
                end = min(len(whole), at + CHUNK)
                while end < len(whole) and not _SPACE[whole[end]]:
                    end += 1
                h, _ = _words_of(np.frombuffer(whole[at:end], dtype=np.uint8))
                out.append(h)
                count += len(h)
                at = end
            n += count
            begins.append(n)
            k += 1
            continue
        size, j = 0, k
        while j < len(raw) and size + len(raw[j]) + 1 <= CHUNK + 1:
            size += len(raw[j]) + 1
            j += 1
        h, start = _words_of(np.frombuffer(b" ".join(raw[k:j]), dtype=np.uint8))
        ends = np.cumsum([len(r) + 1 for r in raw[k:j]])
        out.append(h)
        begins.extend((n + np.searchsorted(start, ends)).tolist())
        n += len(h)
        k = j
    return (np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)), np.array(begins, dtype=np.int64)


def by_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key; shards are ranges of keys, so sorted keys stay together."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as gaps, byte plane by byte plane (the high planes compress to nothing)."""
    gaps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return gaps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)
