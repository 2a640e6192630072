"""k-nearest neighbours by inverted lists (J7 for tables beyond a closed set).

``knn_join`` compares every block with every block.  Here each vector belongs to
the list of its nearest centroid, and a query reads only some lists:

* centroids: spherical k-means on a hash sample of at most ``train_rows`` rows
  (the only part that sees a sample; every row is indexed);
* a query probes its ``probes`` nearest lists; members are scored exactly, so
  only which lists are read is approximate;
* ``exact``: the k-th score so far rules out every list that cannot hold a better
  vector (the angle between query and centroid less the list's radius bounds the
  angle to its members); the lists left over are read too, and the result equals
  that of ``knn_join``;
* neighbouring lists lie together on shelves of about ``block_rows`` rows and a
  longer list on several, the queries of a shelf in blocks of as many; a query is
  sent once to each shelf that it probes, with the numbers of its lists.  So tasks
  have bounded size, and a query of all lists costs a row a shelf, not one a list.

Similarity is the cosine.  Null vectors are neither indexed nor searched; a zero
vector has similarity 0 to everything.  Ids must be unique; ties go to the
smaller id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penprint.functions.rng import h
from penprint.operators.ranking import first_k
from penprint.operators.similarity import BLOCK_ROWS, best_columns, block_count, matrix as _matrix
from penprint.session import cut_lineage

MAX_LISTS = 16_384
TRAIN_ROWS = 20_000
SLACK = 1e-9  # rounding of angles
CELLS = 1 << 22  # numbers of one matrix in a task


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def spherical_kmeans(x: np.ndarray, n: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """At most ``n`` unit centroids of unit rows; empty ones are dropped."""
    r = np.random.default_rng(seed)
    c = x[np.sort(r.choice(len(x), min(n, len(x)), replace=False))]
    for _ in range(rounds):
        own = np.concatenate([(x[i:i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = _unit(total[np.bincount(own, minlength=len(c)) > 0])
    return c


class InvertedLists:
    """Index over (id, vector) rows; build once, search often."""

    def __init__(self, base: DataFrame, id_col: str = "file_id", vec_col: str = "embedding", lists: int | None = None,
                 train_rows: int = TRAIN_ROWS, seed="p", block_rows: int = BLOCK_ROWS):
        self.id, self.vec, self.block_rows = id_col, vec_col, block_rows
        self.type = base.schema[id_col].dataType.simpleString()
        rows = self._rows(base, id_col, vec_col)
        n = rows.count()
        share = min(1.0, train_rows / max(n, 1))
        sample = rows.withColumn("_h", h(seed, "ivf", "id")).where(F.col("_h") < F.lit(int(share * 2 ** 52)))
        sample = sample.orderBy("_h", "id").limit(train_rows).select("vec").toArrow()  # bounded by train_rows
        x = _unit(_matrix(sample.column(0)))
        want = lists or min(MAX_LISTS, max(1, math.isqrt(n)))
        self.centroids = spherical_kmeans(x, want) if len(x) else np.zeros((0, 0))
        shared = base.sparkSession.sparkContext.broadcast(self.centroids)

        def assign(batches):
            c = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                v = _unit(_matrix(b.column(1)))
                near = v @ c.T
                own = near.argmax(1)
                angle = np.arccos(np.clip(near[np.arange(len(v)), own], -1, 1))
                angle[(v == 0).all(axis=1)] = np.pi  # a zero vector: no bound holds
                flat = pa.array(v.ravel())
                vec = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([b.column(0), vec, pa.array(own.astype(np.int32)), pa.array(angle)],
                                                 ["id", "vec", "list", "angle"])

        # one row for each list: at most MAX_LISTS
        self.members = cut_lineage(rows.mapInArrow(assign, f"id {self.type}, vec array<double>, list int, angle double"))
        stats = self.members.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("r")).collect()
        self.sizes = {r["list"]: r["n"] for r in stats}
        self.radius = np.zeros(len(self.centroids))
        for r in stats:
            self.radius[r["list"]] = r["r"]
        self._shelve(n, x.shape[1] if len(x) else 0, base.sparkSession.sparkContext.defaultParallelism)

    def _shelve(self, rows: int, dim: int, parallelism: int) -> None:
        """``first[l]`` and ``parts[l]``: the shelves that hold list l."""
        self.rows_a_shelf = max(1, -(-rows // block_count(rows, dim, parallelism, self.block_rows)))
        self.first = np.zeros(len(self.centroids), np.int64)
        self.parts = np.zeros(len(self.centroids), np.int64)
        shelf, held = 0, 0
        for x, n in sorted(self.sizes.items()):
            if held and held + n > self.rows_a_shelf:
                shelf, held = shelf + 1, 0
            self.first[x], self.parts[x] = shelf, -(-n // self.rows_a_shelf)
            held += n
            if self.parts[x] > 1:
                shelf, held = shelf + int(self.parts[x]), 0
        self.shelves = shelf + bool(held)

    @staticmethod
    def _rows(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
        return df.where(F.col(vec_col).isNotNull()).select(
            F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))

    def _probed(self, query: DataFrame, probes: int, beyond: bool, count: bool = False) -> DataFrame:
        """(id, vec, shelf, lists): the ``probes`` nearest lists of each query, or,
        beyond them, those that its ``kth`` score does not rule out, shelf by shelf.
        ``count``: (shelf, n) of these rows instead."""
        shared = query.sparkSession.sparkContext.broadcast((self.centroids, self.radius, self.first, self.parts))
        shelves = self.shelves

        def run(batches):
            c, radius, first, parts = shared.value
            step = max(1, CELLS // max(len(c), shelves * c.shape[1], 1))
            for whole in batches:
                for b in (whole.slice(i, step) for i in range(0, whole.num_rows if len(c) else 0, step)):
                    v = _unit(_matrix(b.column(1)))
                    near = v @ c.T
                    rank = np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1, kind="stable")
                    if beyond:
                        angle = np.maximum(np.arccos(np.clip(near, -1, 1)) - radius, 0)
                        best = np.cos(angle)
                        best[(v == 0).all(axis=1)] = 1
                        kth = b.column(2).to_numpy(zero_copy_only=False)
                        take = (rank >= probes) & (best >= kth[:, None] - SLACK)
                    else:
                        take = rank < probes
                    q, lists = np.nonzero(take & (parts > 0))
                    times = parts[lists]  # a list on several shelves is probed on each
                    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    q, lists = np.repeat(q, times), np.repeat(lists, times)
                    at = first[lists] + nth
                    order = np.lexsort((lists, at, q))
                    q, lists, at = q[order], lists[order], at[order]
                    new = np.flatnonzero(np.diff(q, prepend=-1) | np.diff(at, prepend=-1))
                    if count:
                        n = np.bincount(at[new], minlength=shelves)
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(shelves, dtype=np.int32)), pa.array(n)], ["shelf", "n"])
                        continue
                    some = pa.ListArray.from_arrays(pa.array(np.append(new, len(q)), pa.int32()), pa.array(lists, pa.int32()))
                    q, at = q[new], at[new]
                    vec = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * v.shape[1], pa.int32()), pa.array(v[q].ravel()))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(q)), vec, pa.array(at.astype(np.int32)), some],
                                                     ["id", "vec", "shelf", "lists"])

        kind = "shelf int, n long" if count else (
            f"id {query.schema['id'].dataType.simpleString()}, vec array<double>, shelf int, lists array<int>")
        return query.mapInArrow(run, kind)

    def _scored(self, query: DataFrame, probes: int, beyond: bool, k: int, exclude_self: bool) -> DataFrame:
        """The best k members of each shelf that a query probes."""
        spark, size = query.sparkSession, self.rows_a_shelf
        asked = self._probed(query, probes, beyond, count=True).groupBy("shelf").agg(F.sum("n").alias("n")).collect()
        plan = [(r["shelf"], -(-r["n"] // size)) for r in asked if r["n"]]  # a row for each shelf
        blocks = F.broadcast(spark.createDataFrame(plan, "shelf int, blocks int"))
        lists = [(x, int(self.first[x]), int(self.parts[x])) for x in self.sizes]
        lists = F.broadcast(spark.createDataFrame(lists, "list int, first int, parts int"))  # a row for each list
        dealt = lambda n: F.pmod(F.xxhash64(F.col("id")), F.col(n)).cast("int")
        q = (self._probed(query, probes, beyond).join(blocks, "shelf")
             .select("shelf", dealt("blocks").alias("block"), "id", "vec", "lists"))
        b = (self.members.join(lists, "list").withColumn("shelf", F.col("first") + dealt("parts")).join(blocks, "shelf")
             .select("shelf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "vec", "list"))
        qtype = query.schema["id"].dataType.simpleString()

        def best(q, b):
            b = b.take(pa.array(np.argsort(b.column("id").to_numpy(zero_copy_only=False), kind="stable")))
            x, y = _matrix(q.column("vec")), _matrix(b.column("vec"))
            own, other = (t.column("id").to_numpy(zero_copy_only=False) for t in (q, b))
            names, code = np.unique(b.column("list").to_numpy(zero_copy_only=False), return_inverse=True)
            probed = np.zeros((len(x), len(names)), bool)
            if len(x) and len(y):
                wanted = q.column("lists").combine_chunks()
                row = np.repeat(np.arange(len(x)), wanted.value_lengths().to_numpy(zero_copy_only=False))
                flat = wanted.flatten().to_numpy(zero_copy_only=False)
                col = np.minimum(np.searchsorted(names, flat), len(names) - 1)
                probed[row, col] = names[col] == flat  # none of a list's members may be on this shelf

            def barred(rows, cols):
                out = ~probed[rows][:, code[cols]]
                return out | np.equal.outer(own[rows], other[cols]).astype(bool) if exclude_self else out
            r, c, v = best_columns(x, y, k, lambda a, d: a @ d.T, barred)
            return pa.Table.from_arrays([q.column("id").take(pa.array(r)), b.column("id").take(pa.array(c)),
                                         pa.array(v, pa.float64())], ["query_id", "base_id", "score"])

        keys = ["shelf", "block"]
        tasks = max(1, min(2000, sum(n for _, n in plan)))
        return (q.repartition(tasks, *keys).groupBy(*keys).cogroup(b.repartition(tasks, *keys).groupBy(*keys))
                .applyInArrow(lambda a, c: best(a, c), f"query_id {qtype}, base_id {self.type}, score double"))

    def search(self, query: DataFrame, k: int, probes: int = 8, exact: bool = False, exclude_self: bool = True,
               id_col: str | None = None, vec_col: str | None = None) -> DataFrame:
        """(query_id, base_id, score, rank) of the k most similar vectors found in
        the probed lists, or of all (``exact``)."""
        q = cut_lineage(self._rows(query, id_col or self.id, vec_col or self.vec))
        top = lambda df: first_k(df, ["query_id"], [F.col("score").desc(), F.col("base_id")], k, out="rank")
        found = top(self._scored(q, probes, False, k, exclude_self))
        if not exact:
            return found
        found = cut_lineage(found.drop("rank"))
        kth = found.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("kth"))
        rest = q.join(kth, q["id"] == kth["query_id"], "left").select("id", "vec", F.coalesce("kth", F.lit(-2.0)).alias("kth"))
        more = self._scored(cut_lineage(rest), probes, True, k, exclude_self)
        return top(found.unionByName(more))
