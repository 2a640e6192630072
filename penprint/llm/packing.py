"""Vector bin packing of examples into training sequences.

A sequence has simultaneous limits on tokens, segments and loss-bearing tokens.
It is filled by the dot-product heuristic: of the pieces that fit, the one whose
demand vector has the largest dot product with what is left of the sequence
(each dimension as a share of its limit) is placed next.  Where none fits, the
largest piece is cut so that the sequence closes full; the rest of the last
sequence of a task is cut into powers of two, which need no padding.

Each task packs the documents of its own input split, a bounded pool at a time:
nothing is shuffled or gathered, and a task that is run again gives the same
sequences.  ``sequence_id`` is unique: the split's number in the upper bits.

Edge cases: an empty or null text is one piece holding only the end id; a
document longer than a sequence is cut; repeated rows are packed one by one; an
empty table gives no piece; a null id is kept as null.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from penprint.llm.tokens import default_path, encoder

SEQUENCE_TOKENS = 2048
MAX_SEGMENTS = 512
END_ID = 1
POOL = 1024

OUT = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
       "loss_tokens long")


class Packer:
    """Pieces in, (piece, sequence, offset) out.  A piece is a row (document
    index, start, length, loss tokens); its loss-bearing tokens are its last
    ones, so a cut leaves them at the end."""

    def __init__(self, tokens: int, segments: int, loss: int, most_pool: int = POOL):
        self.limit = np.array([tokens, segments, loss], np.float64)
        self.most_pool, self.pool = most_pool, np.empty((0, 4), np.int64)
        self.left, self.n, self.offset = self.limit.copy(), 0, 0
        self.open = False

    def add(self, pieces: np.ndarray) -> list[tuple]:
        self.pool = np.concatenate([self.pool, pieces])
        out = []
        while len(self.pool) > self.most_pool:
            out += self._place()
        return out

    def finish(self) -> list[tuple]:
        out = []
        while len(self.pool):
            rest = int(self.pool[:, 2].sum())
            if not self.open and rest < self.limit[0]:
                out += self._tail(rest)
                break
            out += self._place()
        self._close()
        return out

    def _close(self) -> None:
        if self.open:
            self.n, self.offset, self.open, self.left = self.n + 1, 0, False, self.limit.copy()

    def _put(self, i: int) -> tuple:
        doc, start, length, loss = self.pool[i].tolist()
        self.pool[i:-1] = self.pool[i + 1:]
        self.pool = self.pool[:-1]
        row = (doc, start, length, loss, self.n, self.offset)
        self.offset += length
        self.left -= np.array((length, 1, loss))
        self.open = True
        if self.left[0] == 0 or self.left[1] == 0:
            self._close()
        return row

    def _cut(self, i: int, length: int) -> None:
        """Piece i becomes its first ``length`` tokens; the rest goes to the end."""
        doc, start, whole, loss = self.pool[i].tolist()
        later = min(loss, whole - length)
        self.pool[i, 2:] = length, loss - later
        self.pool = np.concatenate([self.pool, [[doc, start + length, whole - length, later]]])

    def _place(self) -> list[tuple]:
        length, loss = self.pool[:, 2], self.pool[:, 3]
        fits = np.flatnonzero((length <= self.left[0]) & (loss <= self.left[2]))
        if len(fits):
            # (demand / limit) . (left / limit); a piece demands one segment, which is the same for all
            weight = self.left / self.limit ** 2
            return [self._put(int(fits[(length[fits] * weight[0] + loss[fits] * weight[2]).argmax()]))]
        i = int(self.pool[:, 2].argmax())
        length, loss = int(self.pool[i, 2]), int(self.pool[i, 3])
        # tokens that fit: those before the loss-bearing part, then as many of it as are left
        room = min(int(self.left[0]), length - loss + int(self.left[2]))
        if room <= 0:
            self._close()
            return []
        if room < length:
            self._cut(i, room)
        return [self._put(i)]

    def _tail(self, rest: int) -> list[tuple]:
        """What is left at the end: sequences of a power of two."""
        out = []
        while len(self.pool):
            size = 1 << (int(self.pool[:, 2].sum()).bit_length() - 1)
            saved, self.limit = self.limit, np.array([size, self.limit[1], self.limit[2]])
            self.left = self.limit.copy()
            while len(self.pool):
                out += self._place()
                if not self.open:
                    break
            self._close()
            self.limit = saved
            self.left = saved.copy()
        return out


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   tokens: int = SEQUENCE_TOKENS, segments: int = MAX_SEGMENTS, loss: int | None = None,
                   prompt_mark: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents (``OUT``).  Loss-bearing tokens: those after the
    last ``prompt_mark`` of a document (all of them where it is None or absent);
    for instruction data the mark is the string that opens the answer."""
    path = tokenizer or default_path()
    loss = tokens if loss is None else loss
    if min(tokens, segments, loss) < 1:
        raise ValueError("limits must be positive")

    def run(batches):
        encode, packer = encoder(path), Packer(tokens, segments, loss)
        base = TaskContext.get().partitionId() << 40
        held: dict[int, tuple] = {}  # documents with pieces not placed yet
        n = 0

        def emit(rows):
            got = []
            for doc, start, length, lossy, seq, offset in rows:
                doc_id, ids, _ = held[doc]
                got.append((doc_id, start, length, zlib.crc32(ids[start:start + length].tobytes()), len(ids),
                            base + seq, offset, lossy))
                held[doc][2][0] -= length
                if not held[doc][2][0]:
                    del held[doc]
            cols = list(zip(*got)) if got else [[]] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                              [c.split()[0] for c in OUT.split(", ")])

        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows = []
                doc_ids, texts = (c.to_pylist() for c in b.slice(at, 256).columns)
                texts = [t or "" for t in texts]
                for doc_id, text, ids in zip(doc_ids, texts, encode(texts)):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    lossy = len(ids)
                    if prompt_mark and prompt_mark in text:
                        answer = text[text.rindex(prompt_mark) + len(prompt_mark):]
                        lossy = min(len(ids), len(encode([answer])[0]) + 1)
                    held[n] = (doc_id, ids, [len(ids)])
                    starts = list(range(0, len(ids), tokens))
                    pieces = np.array([(n, s, min(tokens, len(ids) - s), 0) for s in starts], np.int64)
                    ends = pieces[:, 1] + pieces[:, 2]
                    pieces[:, 3] = np.clip(ends - np.maximum(pieces[:, 1], len(ids) - lossy), 0, None)
                    rows += packer.add(pieces)
                    n += 1
                yield emit(rows)
        yield emit(packer.finish())

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, OUT))


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
