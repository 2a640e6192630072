"""Arrow text columns as numpy buffers, content hashes, and compact blocks.

Small helpers that run inside tasks.  Everything here is a pure function of its
input, so a task that is run again after a lost executor gives the same bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
#: Fixed odd multipliers of the content hashes (any odd 64-bit values would do).
_MIX1, _MIX2, _BASE = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15 | 5)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit finaliser (SplitMix64), element by element."""
    x = (x + U((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)).astype(U, copy=False)
    x = (x ^ (x >> U(30))) * _MIX1
    x = (x ^ (x >> U(27))) * _MIX2
    return x ^ (x >> U(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=U), 7)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def slices(offsets: np.ndarray, most: int = 1 << 21):
    """Ranges (i, j) of documents of at most about ``most`` bytes; a longer
    document is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def rolling(codes: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash (modulo 2**64) of every run of ``width`` codes, built by
    doubling; entry i covers codes[i : i + width]."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0, U)
    out, done, power, step, base = None, 0, codes.astype(U, copy=False), 1, int(_BASE)
    while True:
        if width & step:
            if out is None:
                out, done = power, step
            else:
                m = len(codes) - (done + step) + 1
                out = out[:m] * U(pow(int(_BASE), step, 1 << 64)) + power[done:done + m]
                done += step
        if done == width:
            return out
        m = len(codes) - 2 * step + 1
        power = power[:m] * U(base) + power[step:step + m]
        base = base * base % (1 << 64)
        step *= 2


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` entries."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return x[:n] if step == width else np.minimum(x[:n], x[width - step:width - step + n])


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs without ASCII white space: starts, ends, and the first word of each
    document (with a closing entry).  No word crosses documents."""
    ink = ~_SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(buf), bool)
    if len(buf):
        before[0] = False
        before[1:] = ink[:-1]
    starts = np.flatnonzero(ink & (~before | edge[:-1]))
    after = np.empty(len(buf), bool)
    if len(buf):
        after[-1] = False
        after[:-1] = ink[1:]
    ends = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit content hash of each run of bytes."""
    size = ends - starts
    out = np.zeros(len(starts), U)
    live, step = np.flatnonzero(size > 0), 0
    while len(live):
        out[live] = out[live] * _BASE + BYTE_CODES[buf[starts[live] + step]]
        step += 1
        live = live[size[live] > step]
        if step >= 64 and len(live):  # a few very long words: one at a time
            for i in live:
                x = rolling(BYTE_CODES[buf[starts[i]:ends[i]]], int(size[i]))
                out[i] = x[0]
            break
    return mix(out ^ size.astype(U))


_CASE = np.arange(256, dtype=np.uint8)
_CASE[65:91] += 32


def ascii_lower(buf: np.ndarray) -> np.ndarray:
    return _CASE[buf]
