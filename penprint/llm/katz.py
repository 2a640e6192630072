"""Language-model scoring: a Katz backoff bigram model.

    P(w | v) = d(c(v w)) c(v w) / C(v)          if c(v w) > 0
             = a(v) P(w)                        otherwise
    P(w)     = d(c(w)) c(w) / N                 if c(w) > 0, else p0 / unseen

Counts up to ``K`` are discounted by Good-Turing ratios from the corpus' counts
of counts.  a(v) makes every context sum to one exactly.  The mass p0 that the
unigram discounts free is spread over the estimated number of unseen words
(n1**2 / 2 n2).  A context none of whose counts is discounted gives one more
count to its denominator, so unseen words keep some mass.  A document starts
after a begin mark that is a context only, and ends with the end token.

Texts become *shards* (a bounded run of documents: a dictionary of word hashes
and token numbers), written to the shared folder.  Unigram counts, bigram counts
and context sums are tables partitioned by hash range.  A shard sends each
distinct word, word pair or context once to its range and gets the corpus value
back in the same order, so a word that is a third of all tokens is one entry of
each shard.

Edge cases: a null text is empty and scores its end token alone; without any
training document every token is unseen, its probability is 1, and the base
formula has N = V = 0; repeated rows are counted and scored one by one; null ids
are never held out.  Words are 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from penprint.llm.arrays import U, ascii_lower, mix, utf8, word_hashes, words
from penprint.llm.frames import saved, text_bytes
from penprint.llm.language import holdout

K = 5
END, BEGIN = mix(np.array([1, 2], U), 31)
_SHARD = 16 << 20

SHARD = "shard long, ids binary, null_ids binary, held binary, sizes binary, words binary, tokens binary"


def shards(docs: DataFrame, id_col: str, text_col: str, held) -> DataFrame:
    """One row for each run of documents (about 16 MB of text)."""
    def run(batches):
        k, rows, size = 0, [], 0

        def flush():
            nonlocal k
            ids, nulls, out, h = (np.concatenate([r[i] for r in rows]) for i in range(4))
            lens = np.concatenate([r[4] for r in rows])
            rows.clear()
            own, tokens = np.unique(h, return_inverse=True)
            pack = zstandard.ZstdCompressor(level=1).compress
            k += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([(TaskContext.get().partitionId() << 24) + k - 1], pa.int64()),
                 *(pa.array([x.tobytes()], pa.binary()) for x in
                   (ids, np.packbits(nulls), np.packbits(out), lens.astype("<u4"), own)),
                 pa.array([pack(tokens.astype("<u4").tobytes())], pa.binary())],
                [c.split()[0] for c in SHARD.split(", ")])

        for b in batches:
            ids = b.column(0)
            nulls = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            out = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            buf, off = utf8(b.column(1))
            i = 0
            while i < len(ids):
                j = max(i + 1, int(np.searchsorted(off, off[i] + _SHARD - size, "right")) - 1)
                part, own = ascii_lower(buf[off[i]:off[j]]), off[i:j + 1] - off[i]
                starts, ends, first = words(part, own)
                h = np.insert(word_hashes(part, starts, ends), first[1:], END)
                rows.append((ids[i:j], nulls[i:j], out[i:j], h, np.diff(first) + 1))
                size += int(off[j] - off[i])
                i = j
                if size >= _SHARD:
                    yield flush()
                    size = 0
        if rows:
            yield flush()

    return (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), held.alias("held"))
            .mapInArrow(run, SHARD))


class Shard:
    """A shard row as arrays; pairs are ordered by their hash."""

    def __init__(self, row: dict):
        sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
        n = len(sizes)
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.null = np.unpackbits(np.frombuffer(row["null_ids"], np.uint8), count=n).astype(bool)
        self.held = np.unpackbits(np.frombuffer(row["held"], np.uint8), count=n).astype(bool)
        self.words = np.frombuffer(row["words"], U)
        self.tokens = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["tokens"]), "<u4").astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.train = np.repeat(~self.held, sizes)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.tokens[self.train], minlength=len(self.words))

    def pairs(self):
        """(pair of each token, context and word of each pair, hash, count)."""
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.first[:-1]] = len(self.words)  # the begin mark
        own, at = np.unique(before * (len(self.words) + 1) + self.tokens, return_inverse=True)
        v, w = own // (len(self.words) + 1), own % (len(self.words) + 1)
        h = mix(np.append(self.words, BEGIN)[v] * U(3) + mix(self.words[w], 33), 34)
        order = np.argsort(h)
        rank = np.empty(len(own), np.int64)
        rank[order] = np.arange(len(own))
        at = rank[at]
        return at, v[order], w[order], h[order], np.bincount(at[self.train], minlength=len(own))


def _cuts(h: np.ndarray, n: int) -> np.ndarray:
    """Where the n ranges of sorted hashes begin."""
    to = ((h >> U(32)) * U(n) >> U(32)).astype(np.int64)
    return np.searchsorted(to, np.arange(n + 1))


def small(x: np.ndarray) -> bytes:
    """Counts, most of them small: a byte each, larger ones listed behind."""
    big = x >= 255
    return np.uint32(len(x)).tobytes() + np.minimum(x, 255).astype(np.uint8).tobytes() + x[big].astype("<u8").tobytes()


def unsmall(b: bytes) -> np.ndarray:
    n = int(np.frombuffer(b, "<u4", 1)[0])
    x = np.frombuffer(b, np.uint8, n, 4).astype(np.int64)
    x[x == 255] = np.frombuffer(b, "<u8", offset=4 + n).astype(np.int64)
    return x


_PART = "bucket int, shard long, hashes binary, body binary"
_BACK = "shard long, step int, bucket int, body binary"


def _table(schema: str, rows):
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    cols = list(zip(*rows)) or [[] for _ in schema.split(", ")]
    return pa.table({c.split()[0]: pa.array(x, kinds[c.split()[1]]) for c, x in zip(schema.split(", "), cols)})


def _send(shard: int, h: np.ndarray, body, n: int):
    cut = _cuts(h, n)
    return _table(_PART, [(b, shard, h[a:z].tobytes(), body(a, z))
                          for b, (a, z) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if z > a])


def _merge(table):
    """(shards, place of each sent entry among the distinct hashes, distinct
    hashes, bodies) of a range."""
    sent = [np.frombuffer(x, U) for x in table.column("hashes").to_pylist()]
    own, at = np.unique(np.concatenate(sent), return_inverse=True)
    cut = np.cumsum([0, *map(len, sent)])
    places = [at[a:z] for a, z in zip(cut[:-1], cut[1:])]
    return table.column("shard").to_pylist(), places, own, table.column("body").to_pylist()


def counts(store: DataFrame, step: int, n: int) -> DataFrame:
    """Corpus counts of words (step 1) or word pairs (step 2), sent back to the
    shards; rows of shard -1 hold counts of counts.  Step 2 also tells each pair
    to one shard as its own."""
    def scatter(batches):
        for b in batches:
            for row in b.to_pylist():
                s = Shard(row)
                if step == 1:
                    h, c = s.words, s.word_counts()
                else:
                    _, _, _, h, c = s.pairs()
                yield from _send(row["shard"], h, lambda a, z, c=c: small(c[a:z]), n).to_batches()

    def settle(bucket, table):
        who, places, own, bodies = _merge(table)
        total = np.zeros(len(own), np.int64)
        for at, body in zip(places, bodies):
            total[at] += unsmall(body)
        taken = np.zeros(len(own), bool)
        rows = []
        for shard, at, _ in zip(who, places, bodies):
            mine = ~taken[at]
            taken[at] = True
            rows.append((shard, step, bucket[0].as_py(), small(total[at]) + np.packbits(mine).tobytes()))
        r, k = np.unique(np.minimum(total, K + 2), return_counts=True)
        info = np.zeros(K + 4, np.int64)
        info[r] = k
        info[K + 3] = total.sum()
        return _table(_BACK, [*rows, (-1, step, bucket[0].as_py(), info.tobytes())])

    return store.mapInArrow(scatter, _PART).groupBy("bucket").applyInArrow(settle, _BACK)


class Discount:
    """Good-Turing ratios from counts of counts n_1 .. n_(K+1)."""

    def __init__(self, info: np.ndarray):
        self.total = int(info[K + 3])
        self.types = int(info[1:K + 3].sum())
        n = info[:K + 2].astype(float)
        self.d = np.ones(K + 1)
        for r in range(1, K + 1):
            ratio = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else 0.0
            cap = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
            value = (ratio - cap) / (1 - cap) if cap < 1 else 0.0
            self.d[r] = value if 0 < value < 1 else (r - 0.5) / r  # where the ratios say nothing
        self.n1, self.n2 = n[1], n[2]
        self.freed = float(sum(n[r] * r * (1 - self.d[r]) for r in range(1, K + 1)))

    def counts(self, c: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return np.where(c <= K, self.d[np.minimum(c, K)], 1.0) * c


class Model:
    def __init__(self, info1: np.ndarray, info2: np.ndarray):
        self.one, self.two = Discount(info1), Discount(info2)
        n = self.one.total
        p0 = self.one.freed / n if n else 1.0
        unseen = max(1.0, self.one.n1 ** 2 / (2 * max(self.one.n2, 1.0))) if n else 1.0
        self.p_unseen = p0 / unseen

    def unigram(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.one.counts(c) / max(self.one.total, 1), self.p_unseen)


def _returned(back):
    """Corpus counts of words and pairs, which pairs are this shard's own, and
    the context sums by range."""
    got: dict[int, list] = {1: [], 2: [], 3: []}
    for step, bucket, body in zip(*(back.column(c).to_pylist() for c in ("step", "bucket", "body"))):
        got[step].append((bucket, body))
    out = []
    for step in (1, 2):
        values, mine = [], []
        for _, body in sorted(got[step], key=lambda x: x[0]):
            m = int(np.frombuffer(body, "<u4", 1)[0])
            big = int((np.frombuffer(body, np.uint8, m, 4) == 255).sum())
            values.append(unsmall(body[:4 + m + 8 * big]))
            mine.append(np.unpackbits(np.frombuffer(body, np.uint8, offset=4 + m + 8 * big), count=m).astype(bool))
        out.append((np.concatenate(values), np.concatenate(mine)))
    return out[0][0], out[1][0], out[1][1], sorted(got[3], key=lambda x: x[0])


def asked(v: np.ndarray, c2: np.ndarray, size: int) -> np.ndarray:
    """Contexts whose corpus sums a shard needs: those before an unseen pair, and
    those all of whose pairs here are frequent (perhaps none is discounted)."""
    here = np.bincount(v, minlength=size) > 0
    unseen = np.bincount(v, c2 == 0, size) > 0
    freed = np.bincount(v, (c2 > 0) & (c2 <= K), size) > 0
    return unseen | (here & ~freed)


def context_sums(store: DataFrame, back: DataFrame, model, n: int) -> DataFrame:
    """For each context a shard asks for, sent back to it: the sums of its pairs'
    discounted counts and of their words' unigram probabilities.  A pair is added
    up by the shard that owns it."""
    def scatter(own, returned):
        out = []
        for row in own.to_pylist():
            s = Shard(row)
            _, v, w, _, _ = s.pairs()
            c1, c2, mine, _ = _returned(returned)
            m = model.value
            seen = mine & (c2 > 0)
            size = len(s.words) + 1
            disc = np.bincount(v[seen], m.two.counts(c2[seen]), size)
            lower = np.bincount(v[seen], m.unigram(c1)[w[seen]], size)
            # contexts by hash: the begin mark takes its place among the words
            h = np.append(s.words, BEGIN)
            ask = asked(v, c2, size)
            use = np.flatnonzero(ask | (disc > 0))
            use = use[np.argsort(h[use])]
            cols = [x[use] for x in (disc, lower, ask)]
            out.append(_send(row["shard"], h[use], lambda a, z, cols=cols: (
                cols[0][a:z].tobytes() + cols[1][a:z].tobytes() + np.packbits(cols[2][a:z]).tobytes()), n))
        return pa.concat_tables(out) if out else _table(_PART, [])

    def settle(bucket, table):
        who, places, own, bodies = _merge(table)
        disc, lower = np.zeros(len(own)), np.zeros(len(own))
        rows = []
        for at, b in zip(places, bodies):
            disc[at] += np.frombuffer(b, float, len(at))
            lower[at] += np.frombuffer(b, float, len(at), 8 * len(at))
        for shard, at, b in zip(who, places, bodies):
            ask = at[np.unpackbits(np.frombuffer(b, np.uint8, offset=16 * len(at)), count=len(at)).astype(bool)]
            if len(ask):
                rows.append((shard, 3, bucket[0].as_py(), disc[ask].tobytes() + lower[ask].tobytes()))
        return _table(_BACK, rows)

    return (store.groupBy("shard").cogroup(back.groupBy("shard")).applyInArrow(scatter, _PART)
            .groupBy("bucket").applyInArrow(settle, _BACK))


_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held=None) -> DataFrame:
    """Scores of all documents (``_OUT``); ``held``: boolean column of the
    documents that are not learned from."""
    spark = docs.sparkSession
    held = F.lit(False) if held is None else held
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(2 * parts, int(text_bytes(docs, text_col) / 24e6) + 1)
    store = saved(shards(docs, id_col, text_col, held))
    back1 = saved(counts(store, 1, n))
    back2 = saved(counts(store, 2, n))

    def info(back):
        # one row of K + 4 numbers for each range
        rows = back.where("shard = -1").select("body").toLocalIterator()
        return sum((np.frombuffer(r[0], np.int64) for r in rows), np.zeros(K + 4, np.int64))

    fitted = Model(info(back1), info(back2))
    model = spark.sparkContext.broadcast(fitted)  # a few numbers
    trained = int(docs.select((~held).cast("int").alias("x")).agg(F.sum("x")).first()[0] or 0)
    back = back1.unionByName(back2).where("shard >= 0")
    back3 = saved(context_sums(store, back, model, n))

    def finish(own, returned):
        out = []
        for row in own.to_pylist():
            s, m = Shard(row), model.value
            at, v, w, _, _ = s.pairs()
            c1, c2, _, sums = _returned(returned)
            size = len(s.words) + 1
            ask = np.flatnonzero(asked(v, c2, size))
            ask = ask[np.argsort(np.append(s.words, BEGIN)[ask])]  # as the ranges sent them back
            disc, lower = np.zeros(size), np.zeros(size)
            halves = [np.frombuffer(b, float).reshape(2, -1) for _, b in sums]
            if halves:
                disc[ask], lower[ask] = np.concatenate(halves, axis=1)
            have = np.append(c1, trained).astype(float)
            # counts that were not discounted add up to the context's count: one more then
            whole = np.zeros(size, bool)
            whole[ask] = (disc[ask] >= have[ask] - 1e-9) & (have[ask] > 0)
            below = have + whole
            weight = np.where(have > 0, 1 - disc / np.maximum(below, 1), 1.0) / np.maximum(1 - lower, 1e-300)
            p1 = m.unigram(c1)
            with np.errstate(divide="ignore", invalid="ignore"):
                p2 = np.where(c2 > 0, m.two.counts(c2) / np.maximum(below, 1)[v], weight[v] * p1[w])
            total, types = m.one.total, m.one.types
            base = np.log10((c1 + 1) / (total + types + 1))
            ends = s.first[:-1]
            out.append(pa.table({
                "doc_id": pa.array(s.ids, mask=s.null), "held_out": pa.array(s.held),
                "n_tokens": pa.array(np.diff(s.first)),
                "n_known": pa.array(np.add.reduceat((c1 > 0)[s.tokens].astype(np.int64), ends)),
                "train_tokens": pa.array(np.full(len(s.ids), total)),
                "base_score": pa.array(np.add.reduceat(base[s.tokens], ends)),
                "score": pa.array(np.add.reduceat(np.log10(p2)[at], ends))}))
        names = [c.split() for c in _OUT.split(", ")]
        empty = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
        return pa.concat_tables(out) if out else pa.table({a: pa.array([], empty[k]) for a, k in names})

    return (store.groupBy("shard").cogroup(back.unionByName(back3).groupBy("shard")).applyInArrow(finish, _OUT))


def op7_language_model(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), held=holdout("doc_id", 7, 2))


def brute_force(texts: list[str], held: list[bool]):
    """(base, score) of each text by the formulas above, with dictionaries; and
    P(w | v), to check that it sums to one."""
    from collections import Counter
    docs = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split() + [None]
            for t in texts]
    uni, bi, ctx = Counter(), Counter(), Counter()
    for d, h in zip(docs, held):
        if not h:
            for v, w in zip([0, *d], d):
                uni[w] += 1
                bi[v, w] += 1
                ctx[v] += 1

    def info(c):
        x = np.zeros(K + 4, np.int64)
        for r in c.values():
            x[min(r, K + 2)] += 1
        x[K + 3] = sum(c.values())
        return x

    m = Model(info(uni), info(bi))
    followers: dict = {}
    for (v, w), c in bi.items():
        followers.setdefault(v, {})[w] = c

    def p1(w):
        return float(m.unigram(np.array([uni[w]]))[0])

    weights: dict = {}

    def p(w, v):
        f = followers.get(v)
        if not f:
            return p1(w)
        den = ctx[v] + (min(f.values()) > K)
        if w in f:
            return float(m.two.counts(np.array([f[w]]))[0]) / den
        if v not in weights:
            left = 1 - sum(float(m.two.counts(np.array([c]))[0]) for c in f.values()) / den
            weights[v] = left / (1 - sum(p1(x) for x in f))
        return weights[v] * p1(w)

    n, k = sum(uni.values()), len(uni)
    base = [sum(np.log10((uni[w] + 1) / (n + k + 1)) for w in d) for d in docs]
    score = [sum(np.log10(p(w, v)) for v, w in zip([0, *d], d)) for d in docs]
    return base, score, p, m, uni
