"""Byte-level BPE by the ranks of a public vocabulary file.

A text is cut into pre-tokens by the vocabulary's pattern; each is encoded apart.

1. A *minimal perfect hash* over the vocabulary (hash and displace: a bucket's
   stored displacement seeds the hash that gives each of its keys a slot of its
   own; as many slots as keys) resolves the pre-tokens that are tokens as they
   stand.  A slot's token is compared byte by byte, so foreign strings miss.
2. A miss is merged from its bytes: they form a linked list, a *heap* holds the
   adjacent pairs that are tokens, lowest rank first and leftmost among equals,
   and a pair popped is skipped if a neighbour has been merged since.  That takes
   n log n steps for n bytes, also for one pre-token of megabytes.

The hash is built once on the driver and broadcast: its size is that of the
vocabulary.  Each worker keeps at most ``KEPT`` merged misses and then starts
anew; the results don't depend on it.  Documents are encoded where they lie:
nothing is shuffled, and a task that is run again gives the same ids.

Edge cases: a null or empty text has no ids; strings that look like special
tokens are ordinary text; repeated rows and null ids are encoded row by row; an
empty table gives no rows; other columns are not read.  Ids that the vocabulary
lacks raise ValueError when decoded.
"""

from __future__ import annotations

import base64
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from penprint.llm.arrays import mix, word_hashes

U = np.uint64
#: Merged misses that a worker remembers.
KEPT = 800_000
#: Texts encoded at a time, in characters.
SLICE = 1 << 20


def read_ranks(path: str) -> list[bytes]:
    """Tokens in id order from lines of base64 and rank; ids must be 0 to n - 1."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens: list[bytes | None] = [None] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def hashes(keys: list[bytes]) -> np.ndarray:
    size = np.fromiter(map(len, keys), np.int64, len(keys))
    ends = np.cumsum(size)
    return word_hashes(np.frombuffer(b"".join(keys), np.uint8), ends - size, ends)


def _slots(h: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
    return (mix(h + seed.astype(U) * U(0x9E3779B97F4A7C15)) % U(n)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: ``find`` gives positions in
    ``keys``, -1 for strings that are not among them."""

    LOAD = 2.5  # keys in a bucket on average

    def __init__(self, keys: list[bytes]):
        self.keys, n = keys, len(keys)
        h = hashes(keys)
        if len(np.unique(h)) != n:
            raise ValueError("keys repeat")
        self.seeds = np.zeros(max(1, int(n / self.LOAD)), np.int32)  # below zero: the slot itself, -1 - slot
        self.at = np.full(n, -1, np.int32)  # slot -> position of its key
        bucket = (h % U(len(self.seeds))).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[order], np.arange(len(self.seeds) + 1))
        size = np.diff(first)
        for b in np.argsort(-size, kind="stable"):
            own = order[first[b]:first[b + 1]]
            if len(own) == 1:
                break
            if len(own):
                seed, slots = self._place(h[own], n)
                self.seeds[b], self.at[slots] = seed, own
        free = np.flatnonzero(self.at < 0)
        single = np.flatnonzero(size == 1)  # what is left takes the free slots
        self.seeds[single] = -1 - free
        self.at[free] = order[first[single]]

    def _place(self, h: np.ndarray, n: int):
        """The least seed that sends all keys of a bucket to different free slots."""
        seed, step = 1, 64
        while True:
            tries = np.arange(seed, seed + step)
            slots = _slots(h[None, :], tries[:, None], n)
            fits = (self.at[slots] < 0).all(axis=1)
            for i in np.flatnonzero(fits):
                if len(set(slots[i].tolist())) == len(h):
                    return int(tries[i]), slots[i]
            seed, step = seed + step, min(2 * step, 1 << 14)

    def find(self, strings: list[bytes]) -> list[int]:
        if not strings or not self.keys:
            return [-1] * len(strings)
        h = hashes(strings)
        seed = self.seeds[(h % U(len(self.seeds))).astype(np.int64)]
        slot = np.where(seed < 0, -1 - seed, _slots(h, np.maximum(seed, 0), len(self.keys)))
        keys = self.keys
        return [i if keys[i] == s else -1 for i, s in zip(self.at[slot].tolist(), strings)]


class _Pairs(dict):
    """left << 32 | right -> id of the token that the two make, -1 for none."""

    def __init__(self, tokens: list[bytes], ranks: dict[bytes, int]):
        super().__init__()
        self.tokens, self.ranks = tokens, ranks

    def __missing__(self, key: int) -> int:
        got = self.ranks.get(self.tokens[key >> 32] + self.tokens[key & 0xFFFFFFFF], -1)
        if len(self) > 4 * KEPT:
            self.clear()
        self[key] = got
        return got


class Codec:
    """Encodes and decodes single texts; holds what a worker has merged."""

    def __init__(self, table: PerfectHash, pattern: str):
        import regex
        self.table, self.tokens = table, table.keys
        self.cut = regex.compile(pattern).findall
        self.ranks = {t: i for i, t in enumerate(self.tokens)}
        self.byte = [self.ranks.get(bytes([b])) for b in range(256)]
        if None in self.byte:
            raise ValueError("the vocabulary lacks single bytes")
        self.pairs = _Pairs(self.tokens, self.ranks)
        self.merged: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token by merging its bytes.  Heap entries are
        rank << 32 | place, so equal ranks come out from the left."""
        byte, pairs = self.byte, self.pairs
        ids = [byte[b] for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [rank << 32 | i for i, (x, y) in enumerate(zip(ids, ids[1:])) if (rank := pairs[x << 32 | y]) >= 0]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i, rank = top & 0xFFFFFFFF, top >> 32
            j, left = after[i], ids[i]
            if left < 0 or j == n or pairs[left << 32 | ids[j]] != rank:
                continue  # one of the two has gone or grown
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                got = pairs[rank << 32 | ids[k]]
                if got >= 0:
                    heappush(heap, got << 32 | i)
            h = before[i]
            if h >= 0:
                got = pairs[ids[h] << 32 | rank]
                if got >= 0:
                    heappush(heap, got << 32 | h)
        return [x for x in ids if x >= 0]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        pieces = [self.cut(t) for t in texts]
        if len(self.merged) > KEPT:
            self.merged = {}
        merged = self.merged
        fresh = list(set().union(*pieces).difference(merged))
        raw, whole = [p.encode() for p in fresh], []
        for piece, b, i in zip(fresh, raw, self.table.find(raw)):
            if i >= 0:
                whole.append(piece)
                merged[piece] = i.to_bytes(4, "little")
            else:
                merged[piece] = array("I", self.merge(b)).tobytes()
        out = [b"".join(map(merged.__getitem__, p)) for p in pieces]
        for piece in whole:  # only misses are kept
            del merged[piece]
        return out

    def decode(self, ids: bytes) -> bytes:
        tokens, got = self.tokens, np.frombuffer(ids, "<u4")
        if len(got) and int(got.max()) >= len(tokens):
            raise ValueError(f"id {int(got.max())} is not in the vocabulary")
        return b"".join(map(tokens.__getitem__, got.tolist()))


_CODECS: dict[tuple, Codec] = {}


def _codec(shared, pattern: str) -> Codec:
    """One codec for each broadcast table and worker process."""
    key = (shared.value.id, pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(shared.value.table, pattern)
    return _CODECS[key]


class _Shared:
    def __init__(self, table: PerfectHash, name: str):
        self.table, self.id = table, name


def default_ranks() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


class ByteBpe:
    """Encoder and decoder of DataFrames for one rank file and pattern."""

    def __init__(self, spark, ranks: str | None = None, pattern: str | None = None):
        path = ranks or default_ranks()
        self.pattern = pattern or default_pattern()
        self.shared = spark.sparkContext.broadcast(_Shared(PerfectHash(read_ranks(path)), path))

    def encode(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, ids) of every row: ids as little-endian unsigned 32-bit binary."""
        shared, pattern = self.shared, self.pattern

        def run(batches):
            codec = _codec(shared, pattern)
            for b in batches:
                texts = [t or "" for t in b.column(1).to_pylist()]
                at = 0
                while at < len(texts):
                    size, end = 0, at
                    while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE):
                        size, end = size + len(texts[end]), end + 1
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(at, end - at), pa.array(codec.encode(texts[at:end]), pa.binary())],
                        ["doc_id", "ids"])
                    at = end

        return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
                .mapInArrow(run, "doc_id long, ids binary"))

    def decode(self, encoded: DataFrame) -> DataFrame:
        """(doc_id, ids, decoded): the bytes that the ids stand for."""
        shared, pattern = self.shared, self.pattern

        def run(batches):
            codec = _codec(shared, pattern)
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    got = [codec.decode(x or b"") for x in part.column(1).to_pylist()]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got, pa.binary())],
                                                     ["doc_id", "ids", "decoded"])

        return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def op11_byte_bpe(spark, sf_dir: str) -> DataFrame:
    bpe = ByteBpe(spark)
    done = bpe.decode(bpe.encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return done.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
