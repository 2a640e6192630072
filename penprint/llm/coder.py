"""Adaptive context-mixing range coder for blocks of token ids.

A block is coded on its own from a fresh model and carries a checksum.  For each
id an order-2 and an order-1 context hold the id that followed them last.  The
candidate (of the longer context that has one) is confirmed or refused by one
binary decision, whose probability mixes three adaptive predictions: by the
confidence of the order-2 context, of the order-1 context, and by the
candidate's order-0 class.  The weights of this logistic mix are learned as the
block goes on.  A refused candidate is followed by the id's two bytes under
adaptive order-0 frequencies (the low byte given the size of the high one).

Many blocks are coded in step: position t of all of them is one numpy
operation, so the work per id stays small without compiled code.  All model
arithmetic is on integers, so every machine decodes the same ids.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 2048
_SLOTS = 1024                      # entries of each context table
_REBUILD = (16, 64, 160, 384, 800, 1400)  # places at which byte frequencies are refreshed
_BITS = 14                         # precision of byte frequencies
_TOP, _LOW = np.uint64(48), np.uint64(32)

# Logistic tables: stretch(p) = ln(p / (1 - p)), 12-bit p, 8 fraction bits; squash is its inverse.
_P = (np.arange(4096) + 0.5) / 4096
STRETCH = np.round(np.log(_P / (1 - _P)) * 256).astype(np.int32)
SQUASH = np.clip(np.round(4096 / (1 + np.exp(-np.arange(-2304, 2304) / 256))), 16, 4080).astype(np.int32)
_CLASS = np.array([int(i).bit_length() for i in range(256)], np.int64)  # of a high byte: 0..8


class Model:
    """Adaptive state of ``n`` blocks."""

    def __init__(self, n: int):
        self.base = np.arange(n, dtype=np.int64) * _SLOTS
        self.next = [np.zeros(n * _SLOTS, np.uint16) for _ in range(2)]  # order 1, order 2
        self.sure = [np.zeros(n * _SLOTS, np.int8) for _ in range(2)]
        self.odds = [np.full(n * 16, 1 << 14, np.int32) for _ in range(3)]  # 16-bit, by order
        self.lane = np.arange(n, dtype=np.int64) * 16
        self.weight = [np.full(n, 22000, np.int32) for _ in range(3)]
        self.count = np.zeros((n, 10, 256), np.uint16)  # at most 64 + 24 * BLOCK
        self.count[:, 0] = np.maximum(1, 64 // (np.arange(256) + 1))  # early ids are common
        self.count[:, 1:] = 1
        self.rows = np.arange(n, dtype=np.int64) * 10
        self.rebuild()

    def rebuild(self) -> None:
        """Cumulative byte frequencies, each at least 1, with a fixed total."""
        n = len(self.count)
        cum = np.zeros((n, 10, 257), np.uint16)
        room, floor = np.uint32((1 << _BITS) - 256), np.arange(257, dtype=np.uint32)
        for k in range(10):
            part = np.zeros((n, 257), np.uint32)
            np.cumsum(self.count[:, k], axis=1, out=part[:, 1:], dtype=np.uint32)
            cum[:, k] = part * room // part[:, -1:] + floor
        self.cum = cum.ravel()

    def look(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Candidates after the ids ``one`` (last) and ``two`` (before it), and
        the probability (12 bits) that they are right."""
        self.at = [self.base + ((one * 40503 >> 3) & (_SLOTS - 1)),
                   self.base + ((two * 48271 + one * 40503 >> 5) & (_SLOTS - 1))]
        c1, c2 = self.next[0].take(self.at[0]), self.next[1].take(self.at[1])
        n1, n2 = self.sure[0].take(self.at[0]), self.sure[1].take(self.at[1])
        self.seen = (c1, c2, n1, n2)
        has = n2 > 0
        self.candidate = np.where(has, c2, c1).astype(np.int64)
        self.state = [self.lane + _CLASS.take(self.candidate >> 8), self.lane + (n1 + (has.view(np.int8) << 3)),
                      self.lane + (n2 + ((c1 == c2).view(np.int8) << 3))]
        self.was = [o.take(s) for o, s in zip(self.odds, self.state)]
        self.st = [STRETCH.take(o >> 4) for o in self.was]
        dot = (self.weight[0] * self.st[0] + self.weight[1] * self.st[1] + self.weight[2] * self.st[2]) >> 16
        self.p = SQUASH.take(dot + 2304, mode="clip")
        return self.p

    def learn(self, hit: np.ndarray, ids: np.ndarray) -> None:
        aim = hit.astype(np.int32) << 16
        err = (aim >> 4) - self.p
        for k in range(3):
            w = self.weight[k]
            w += (self.st[k] * err) >> 10
            np.clip(w, -100_000, 100_000, out=w)  # three products stay below 2**31
            self.odds[k][self.state[k]] = self.was[k] + ((aim - self.was[k]) >> 5)
        c1, c2, n1, n2 = self.seen
        for k, (c, n) in enumerate(((c1, n1), (c2, n2))):
            left = np.where(c == ids, np.minimum(n + 1, 7), n >> 1)
            fresh = left == 0
            self.next[k][self.at[k][fresh]] = ids[fresh]
            self.sure[k][self.at[k]] = left + fresh.view(np.int8)

    def tally(self, lanes: np.ndarray, high: np.ndarray, low: np.ndarray) -> None:
        flat = self.count.reshape(-1)
        flat[self.rows[lanes] * 256 + high] += 24
        flat[(self.rows[lanes] + 1 + _CLASS[high]) * 256 + low] += 24


def _split(n: int) -> tuple[int, np.ndarray]:
    lanes = max(1, -(-n // BLOCK))
    return lanes, np.minimum(BLOCK, n - np.arange(lanes, dtype=np.int64) * BLOCK)


def encode(ids: np.ndarray) -> list[bytes]:
    """Blocks of at most ``BLOCK`` ids: a checksum of the ids and the coded words."""
    if not len(ids):
        return []
    if int(ids.max()) > 0xFFFF:
        raise ValueError("ids must lie below 65536")
    n, sizes = _split(len(ids))
    grid = np.zeros(n * BLOCK, np.int64)
    grid[:len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(n, BLOCK).T)
    model = Model(n)
    low, span = np.zeros(n, np.uint64), np.full(n, (1 << 48) - 1, np.uint64)
    out = np.zeros((n, 4 * BLOCK + 8), np.uint16)
    used = np.zeros(n, np.int64)
    mask, sixteen = np.uint64((1 << 48) - 1), np.uint64(16)

    def put(lanes, start, freq, bits):
        nonlocal low, span
        every = len(lanes) == n
        r = (span if every else span[lanes]) >> np.uint64(bits)
        a, s = (low if every else low[lanes]) + r * start, r * freq
        over = a >> _TOP
        if over.any():  # carry into the words already written
            a &= mask
            up = lanes[over > 0]
            at = used[up] - 1
            while len(up):
                out[up, at] += 1
                again = out[up, at] == 0
                up, at = up[again], at[again] - 1
        short = (s >> _LOW) == 0
        if short.any():
            move = lanes[short]
            out[move, used[move]] = (a[short] >> _LOW).astype(np.uint16)
            used[move] += 1
            a[short] = (a[short] << sixteen) & mask
            s[short] <<= sixteen
        if every:
            low, span = a, s
        else:
            low[lanes], span[lanes] = a, s

    everyone = np.arange(n)
    one, two = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for t in range(int(sizes.max())):
        live = everyone if t < sizes[-1] else everyone[:-1]
        if t in _REBUILD:
            model.rebuild()
        now = grid[t]
        p = model.look(one, two).astype(np.uint64)
        hit = model.candidate == now
        start, freq = p * ~hit, np.where(hit, p, np.uint64(4096) - p)
        if len(live) < n:
            start, freq = start[live], freq[live]
        put(live, start, freq, 12)
        miss = live[~hit[live]]
        if len(miss):
            x = now[miss]
            high, lower = x >> 8, x & 255
            for row, sym in ((model.rows[miss], high), (model.rows[miss] + 1 + _CLASS[high], lower)):
                base = row * 257 + sym
                a = model.cum.take(base).astype(np.uint64)
                put(miss, a, model.cum.take(base + 1).astype(np.uint64) - a, _BITS)
            model.tally(miss, high, lower)
        model.learn(hit, now)
        two, one = one, now
    for _ in range(3):  # flush 48 bits
        out[everyone, used] = (low >> _LOW).astype(np.uint16)
        used += 1
        low = (low << sixteen) & mask
    little = ids.astype("<u4")
    return [np.array([zlib.crc32(little[i * BLOCK:i * BLOCK + int(sizes[i])].tobytes())], "<u4").tobytes()
            + out[i, :used[i]].astype("<u2").tobytes() for i in range(n)]


def decode(blocks: list[bytes], total: int) -> np.ndarray:
    """The ids of consecutive blocks; raises ValueError where a checksum fails."""
    if not total:
        return np.empty(0, "<u4")
    n, sizes = _split(total)
    if n != len(blocks):
        raise ValueError("blocks are missing")
    words = [np.frombuffer(b, "<u2", offset=4) for b in blocks]
    width = max(map(len, words)) + 4
    data = np.zeros((n, width), np.uint64)
    for i, w in enumerate(words):
        data[i, :len(w)] = w
    data = data.ravel()
    at = np.arange(n, dtype=np.int64) * width
    code = (data[at] << np.uint64(32)) | (data[at + 1] << np.uint64(16)) | data[at + 2]
    at += 3
    span = np.full(n, (1 << 48) - 1, np.uint64)
    model = Model(n)
    grid = np.zeros((BLOCK, n), np.int64)
    sixteen = np.uint64(16)

    def take(lanes, r, start, freq):
        nonlocal code, span
        every = len(lanes) == n
        c, s = (code if every else code[lanes]) - r * start, r * freq
        short = (s >> _LOW) == 0
        if short.any():
            move = lanes[short]
            c[short] = (c[short] << sixteen) | data[np.minimum(at[move], len(data) - 1)]
            at[move] += 1
            s[short] <<= sixteen
        if every:
            code, span = c, s
        else:
            code[lanes], span[lanes] = c, s

    def symbol(lanes, row):
        r = span[lanes] >> np.uint64(_BITS)
        value = np.minimum(code[lanes] // r, np.uint64((1 << _BITS) - 1)).astype(np.uint16)
        first, sym = row * 257, np.zeros(len(lanes), np.int64)
        base = first
        for step in (128, 64, 32, 16, 8, 4, 2, 1):
            sym += step * (model.cum.take(base + step) <= value)
            base = first + sym
        a = model.cum.take(base).astype(np.uint64)
        take(lanes, r, a, model.cum.take(base + 1).astype(np.uint64) - a)
        return sym

    everyone = np.arange(n)
    one, two = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for t in range(int(sizes.max())):
        live = everyone if t < sizes[-1] else everyone[:-1]
        if t in _REBUILD:
            model.rebuild()
        p = model.look(one, two).astype(np.uint64)
        r = span >> np.uint64(12)
        hit = code < r * p
        start, freq = p * ~hit, np.where(hit, p, np.uint64(4096) - p)
        if len(live) < n:
            hit[live[-1] + 1:] = False
            r, start, freq = r[live], start[live], freq[live]
        take(live, r, start, freq)
        now = model.candidate.copy()
        miss = live[~hit[live]]
        if len(miss):
            high = symbol(miss, model.rows[miss])
            lower = symbol(miss, model.rows[miss] + 1 + _CLASS[high])
            model.tally(miss, high, lower)
            now[miss] = high << 8 | lower
        model.learn(hit, now)
        grid[t] = now
        two, one = one, now
    out = np.ascontiguousarray(grid.T).reshape(-1)
    keep = (np.arange(BLOCK) < sizes[:, None]).ravel()
    out = out[keep].astype("<u4")
    for i, b in enumerate(blocks):
        own = out[i * BLOCK:i * BLOCK + int(sizes[i])]
        if np.array([zlib.crc32(own.tobytes())], "<u4").tobytes() != b[:4]:
            raise ValueError(f"block {i}: checksum does not match")
    return out
