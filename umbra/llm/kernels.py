"""Array kernels over Arrow string columns: word spans and hashes without a Python loop per word."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once; a text that is longer is cut at separators only.
PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: ASCII white space: space and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64, kept for pieces of the usual size."""
    key = str(int(base))
    have = _powers.get(key)
    if have is None or len(have) < n:
        out = np.full(max(n, 1), base, np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            out = np.multiply.accumulate(out)
        if n > 2 * PIECE:
            return out
        _powers[key] = have = out
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its len+1 offsets; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    large = pa.types.is_large_string(col.type)
    _, offsets, data = col.buffers()
    kind = np.int64 if large else np.int32
    offs = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo, hi = int(offs[0]), int(offs[-1])
    return raw[lo:hi], offs - lo


def words(data: np.ndarray, offs: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts laid end to end: 64-bit hash of the word with A-Z lowered, first byte, end byte, and the texts' offsets into these."""
    n, hashes, firsts, lasts = len(data), [], [], []
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    p = 0
    while p < n:
        q = min(p + PIECE, n)
        while q < n and not edge[q] and not gap[data[q]]:
            step = data[q : q + 4096]
            stop = np.flatnonzero(gap[step] | edge[q : q + len(step)])
            q = q + int(stop[0]) if len(stop) else q + len(step)
        b = LOWER[data[p:q]]
        on = ~gap[b]
        first = on.copy()
        first[1:] &= ~on[:-1] | edge[p + 1 : q]
        last = on.copy()
        last[:-1] &= ~on[1:] | edge[p + 1 : q]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        with np.errstate(over="ignore"):
            total = np.zeros(len(b) + 1, np.uint64)
            np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(b)), out=total[1:])
            hashes.append(mix((total[e] - total[s]) * _power(_INVERSE, len(b) + 1)[s] + (e - s).astype(np.uint64)))
        firsts.append(s + p)
        lasts.append(e + p)
        p = q
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    s = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
    e = np.concatenate(lasts) if lasts else np.zeros(0, np.int64)
    return h, s, e, np.searchsorted(s, offs)


def _trim():
    """glibc's malloc_trim, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return None


_malloc_trim = _trim()


def release() -> None:
    """Gives memory that nothing uses back to the machine, so that an idle worker doesn't hold a former stage's peak."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim:
        _malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, most: int = 4 * PIECE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about so many bytes, a longer text alone."""
    col = batch.column(batch.schema.get_field_index(column))
    size = np.asarray(pc.fill_null(pc.binary_length(col), 0), np.int64)
    total, at = np.cumsum(size), 0
    while at < len(size):
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to
    release()


def shingle_sets(h: np.ndarray, tok: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct word-shingle hashes; a text of fewer words, but not none, is one shingle."""
    with np.errstate(over="ignore"):
        if len(h) >= width:
            rolled = np.zeros(len(h) - width + 1, np.uint64)
            for k in range(width):
                rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + h[k : len(h) - width + 1 + k]
            rolled = mix(rolled)
        else:
            rolled = np.zeros(0, np.uint64)
        for a, b in zip(tok[:-1].tolist(), tok[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                one = np.uint64(b - a)
                for x in h[a:b]:
                    one = one * np.uint64(0xD6E8FEB86659FD93) + x
                yield mix(np.array([one], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
