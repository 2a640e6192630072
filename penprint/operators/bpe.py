"""Subword vocabulary learning and encoding (X7, X8) — byte-pair merges.

The corpus is scanned once into a word-frequency table (partial aggregation).
The distinct words are then held as blocks of symbol ids (numpy arrays), and a
round is one Spark job: every task brings its blocks up to date, counts their
adjacent pairs, and Spark sums the pairs and takes the best ones.  A round takes
as many merges as provably come next whatever the others do to the counts
(``next_merges``), so the merges equal those of one at a time.  The blocks are
written to the shared checkpoint folder every ``_KEEP`` rounds; between that, a
task replays the merges since, so a lost executor costs a replay only.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penprint.functions.text import trainer_text
from penprint.session import cut_lineage

SYMBOL = r"\[EOL\]|\[TAB\]|(?s:.)"  # the cleaning symbols are never spelled
SEP = "\u0001"  # symbol separator inside a word (never occurs in text)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, freq, symbols) — words are the whitespace-separated pieces of the
    trainer text; symbols start as single characters ([EOL] and [TAB] are single
    symbols) joined by SEP."""
    words = docs.select(F.explode(F.split(trainer_text(F.col(text)), "[ \\t\\n\\r\\f\\v]+")).alias("word"))
    wc = words.where(F.length("word") > 0).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
    return wc.withColumn("symbols", F.array_join(F.regexp_extract_all("word", F.lit(SYMBOL), F.lit(0)), SEP))


def pair_counts(wc: DataFrame) -> DataFrame:
    """Weighted counts of adjacent symbol pairs: (left, right, count)."""
    sy = wc.select("freq", F.split("symbols", SEP).alias("s"))
    pairs = sy.select("freq", F.explode(F.arrays_zip(
        F.slice("s", 1, F.greatest(F.size("s") - 1, F.lit(0))),
        F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))))).alias("p"))
    return pairs.groupBy(F.col("p.0").alias("left"), F.col("p.1").alias("right")).agg(
        F.sum("freq").alias("count"))


_KEEP = 16       # rounds between two written states
_CANDIDATES = 1024  # best pairs the driver sees in a round


def symbol_ids(wc: DataFrame) -> dict[str, int]:
    """Ids of the single symbols of the corpus, in code point order (bounded by
    the alphabet)."""
    seen = wc.select(F.explode(F.regexp_extract_all("word", F.lit(SYMBOL), F.lit(0))).alias("s")).distinct().collect()
    return {c: i for i, c in enumerate(sorted(r[0] for r in seen))}


def word_blocks(wc: DataFrame, ids: dict[str, int]) -> DataFrame:
    """(symbols, freq): blocks of words as 32-bit symbol ids, each word closed by
    -1, and the words' frequencies."""
    symbol = re.compile(SYMBOL)

    def pack(batches):
        for b in batches:
            if not b.num_rows:
                continue
            flat: list[int] = []
            for w in b.column("word").to_pylist():
                flat += [ids[c] for c in symbol.findall(w)]
                flat.append(-1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([np.array(flat, "<i4").tobytes()], pa.binary()),
                 pa.array([b.column("freq").to_numpy().astype("<i8").tobytes()], pa.binary())], ["symbols", "freq"])
    return wc.select("word", "freq").mapInArrow(pack, "symbols binary, freq binary")


def merge_symbols(flat: np.ndarray, left: int, right: int, new: int) -> np.ndarray:
    """Merges non-overlapping occurrences of (left, right), left to right."""
    hit = np.flatnonzero((flat[:-1] == left) & (flat[1:] == right))
    if left == right and len(hit):  # a run of the symbol: every second place
        first = np.concatenate([[True], np.diff(hit) > 1])
        hit = hit[(hit - hit[first][np.cumsum(first) - 1]) % 2 == 0]
    if not len(hit):
        return flat
    flat = flat.copy()
    flat[hit] = new
    return np.delete(flat, hit + 1)


def _replayed(blocks: DataFrame, merges: list[tuple[int, int, int]]) -> DataFrame:
    if not merges:
        return blocks

    def run(batches):
        for b in batches:
            out = []
            for raw in b.column("symbols").to_pylist():
                flat = np.frombuffer(raw, "<i4")
                for left, right, new in merges:
                    flat = merge_symbols(flat, left, right, new)
                out.append(flat.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), b.column("freq")], ["symbols", "freq"])
    return blocks.mapInArrow(run, "symbols binary, freq binary")


def _best_pairs(blocks: DataFrame, names: list[str], most: int) -> list:
    """The ``most`` best pairs (left, right, count): count descending, then text."""
    def count(batches):
        for b in batches:
            for raw, freq in zip(b.column("symbols").to_pylist(), b.column("freq").to_pylist()):
                flat, weight = np.frombuffer(raw, "<i4").astype(np.int64), np.frombuffer(freq, "<i8")
                word = np.cumsum(flat < 0) - (flat < 0)
                inner = np.flatnonzero((flat[:-1] >= 0) & (flat[1:] >= 0))
                pair, at = np.unique(flat[inner] << 32 | flat[inner + 1], return_inverse=True)
                total = np.zeros(len(pair), np.int64)
                np.add.at(total, at, weight[word[inner]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[i] for i in (pair >> 32).tolist()], pa.string()),
                     pa.array([names[i] for i in (pair & 0xFFFFFFFF).tolist()], pa.string()),
                     pa.array(total, pa.int64())], ["left", "right", "n"])
    pairs = blocks.mapInArrow(count, "left string, right string, n long")
    return (pairs.groupBy("left", "right").agg(F.sum("n").alias("count"))
            .orderBy(F.col("count").desc(), "left", "right").limit(most).collect())


def next_merges(best: list, symbols, most: int, whole: bool = True) -> list[tuple[str, str, int]]:
    """The merges that come next, one after the other, as far as the counts of
    ``best`` (ordered pairs; ``whole`` when there are no others) settle them.

    Merging (a, b) lowers the pairs that end in a or start with b, and makes pairs
    (x, ab) and (ab, y), which stand at most as often as (x, a) and (b, y) did.
    So the next pair of the list is the next merge unless it is such a lowered
    pair itself, or a pair that starts with b stands exactly as often (then (ab, y)
    could tie with it and come first by its text).  A merge of a symbol with
    itself, or one that spells a symbol that exists, may raise counts: it is the
    last of its round."""
    out: list[tuple[str, str, int]] = []
    ends, starts, made = set(), set(), set()
    for i, (left, right, count) in enumerate(best):
        if len(out) == most:
            break
        if out:
            if right in ends or left in starts:
                break
            j = i + 1
            while j < len(best) and best[j][2] == count and best[j][0] not in starts:
                j += 1
            if (j < len(best) and best[j][2] == count) or (j == len(best) and not whole):
                break
        out.append((left, right, int(count)))
        ends.add(left), starts.add(right)
        if left == right or left + right in symbols or left + right in made:
            break
        made.add(left + right)
    return out


def learn_merges(docs: DataFrame, n_merges: int, text: str = "text") -> list[tuple[str, str, int]]:
    """The first ``n_merges`` byte-pair merges, as a list of (left, right, count)."""
    wc = cut_lineage(word_counts(docs, text))
    ids = symbol_ids(wc)
    blocks = cut_lineage(word_blocks(wc, ids))
    merges: list[tuple[str, str, int]] = []
    since: list[tuple[int, int, int]] = []  # merges that the written blocks lack, as ids
    rounds = 0
    while len(merges) < n_merges:
        best = _best_pairs(_replayed(blocks, since), sorted(ids, key=ids.__getitem__), _CANDIDATES)
        new = next_merges([tuple(r) for r in best], ids, n_merges - len(merges), len(best) < _CANDIDATES)
        if not new:
            break
        for left, right, _ in new:
            made = ids.setdefault(left + right, len(ids))
            since.append((ids[left], ids[right], made))
        merges += new
        rounds += 1
        if rounds % _KEEP == 0:
            blocks, since = cut_lineage(_replayed(blocks, since)), []
    return merges


class WordEncoder:
    """Pieces of words by the merges' ranks (lowest first, standard byte-pair
    encoding).  Every worker remembers the words it met; a full table starts anew."""

    most, longest = 100_000, 256  # words remembered, and characters of the longest of them

    def __init__(self, merges: list[tuple[str, str, int]]):
        self.ranks = {(l_, r_): i for i, (l_, r_, _) in enumerate(merges)}
        self.symbol, self.known = re.compile(SYMBOL), {}

    def __getstate__(self):
        return {**self.__dict__, "known": {}}

    def __call__(self, word: str) -> list[str]:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= self.most:
                self.known.clear()
            got = self._encode(word)
            if len(word) <= self.longest:
                self.known[word] = got
        return got

    def _encode(self, word: str) -> list[str]:
        s = self.symbol.findall(word)
        while len(s) > 1:
            rank, pair = min(((self.ranks.get(p, len(self.ranks)), p) for p in zip(s, s[1:])))
            if rank == len(self.ranks):
                break
            out, i = [], 0
            while i < len(s):
                if (s[i], *s[i + 1:i + 2]) == pair:
                    out.append(s[i] + s[i + 1])
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            s = out
        return s


def encode_words(words: DataFrame, merges: list[tuple[str, str, int]], word_col: str = "word") -> DataFrame:
    """X8 on words: adds ``pieces``.  The merge list is bounded by the vocabulary
    size and shipped with the function."""
    encoder = WordEncoder(merges)

    @F.pandas_udf("array<string>")
    def enc(ws: pd.Series) -> pd.Series:
        return ws.map(encoder)

    return words.withColumn("pieces", enc(F.col(word_col)))


_CHARS = 1 << 18  # bytes of text whose pieces are Python objects at a time (a longer text goes alone)


def slices(texts, most: int):
    """Runs of rows of a text column with at most ``most`` bytes each, or one row."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > at and total + n > most:
            yield slice(at, i)
            at, total = i, 0
        total += n
    if len(size) > at:
        yield slice(at, len(size))


# Ids of the special symbols.
PAD, BOS, EOS, UNK = 0, 1, 2, 3


def vocabulary(wc: DataFrame, merges) -> dict[str, int]:
    """Piece -> id: the four special symbols, the single symbols of the corpus in
    code point order, then the merged pieces by rank (bounded by the alphabet and
    the number of merges)."""
    single = sorted(symbol_ids(wc))
    out = {}
    for piece in [*single, *(l_ + r_ for l_, r_, _ in merges)]:
        out.setdefault(piece, len(out) + 4)
    return out


def subword_encode(docs: DataFrame, merges, id_col: str = "doc_id", text: str = "text",
                   vocab: dict[str, int] | None = None) -> DataFrame:
    """Every document as its sequence of subword pieces, and with ``vocab``
    their ids between BOS and EOS (white space and symbols outside it: UNK).

    Separators are pieces of their own, so the pieces joined give the cleaned
    text; a blank or null document keeps its row.  Documents are encoded where
    they are, with a table of words for each worker: nothing is shuffled."""
    encoder = WordEncoder(merges)
    part = re.compile(r"[ \t\n\r\f\x0b]|[^ \t\n\r\f\x0b]+")
    kind = "pieces array<string>" + ("" if vocab is None else ", ids array<int>")

    def encode(keys, texts):
        pieces = [[p for w in part.findall(t or "") for p in encoder(w)] for t in texts]
        out = [keys, pa.array(pieces, pa.list_(pa.string()))]
        if vocab is not None:
            out.append(pa.array([[BOS, *(vocab.get(p, UNK) for p in ps), EOS] for ps in pieces], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(out, [id_col, "pieces", "ids"][:len(out)])

    def run(batches):
        for b in batches:
            for rows in slices(b.column(1), _CHARS):
                yield encode(b.column(0).slice(rows.start, rows.stop - rows.start),
                             b.column(1).slice(rows.start, rows.stop - rows.start).to_pylist())

    key = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, trainer_text(F.col(text))).mapInArrow(run, f"{id_col} {key}, {kind}")
