"""All-pairs similarity and k-nearest-neighbour joins.

The reference computes a full ``cdist``/``cosine_similarity`` matrix in memory.
Here the work is tiled: both sides are hashed into blocks, every (query block,
base block) pair becomes one co-group, and each co-group runs dense GEMMs in
numpy over tiles and emits only its local top-k per query row (ties: smaller id).  A final ``row_number() <= k`` per query (partial WindowGroupLimit, so
at most blocks*k candidates per query ever cross the network) picks the global
top-k with a deterministic tie-break on the base id.

No cross join is planned and no pair row is materialised: a co-group holds at
most ``block_rows`` rows per side (and ``BLOCK_BYTES`` of vectors), whatever the
skew of labels or folds.
Each row is replicated once per block of the other side, so this exact tier is
meant for closed sets (authors x k files, 10^4–10^6 rows); beyond that use
``approx_knn_join`` (random-projection LSH buckets).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penprint.operators.ranking import first_k


BLOCK_ROWS = 1 << 15     # rows of one side of a co-group: every row is sent once a block of the other side
BLOCK_BYTES = 1 << 26    # and its vectors as doubles
TILE = 2048              # rows and columns of one product


def block_count(rows: int, dim: int, parallelism: int, block_rows: int = BLOCK_ROWS) -> int:
    """Blocks of a side: as few as memory allows, but enough pairs for all cores."""
    most = max(1, min(block_rows, BLOCK_BYTES // (8 * max(dim, 1))))
    return max(1, -(-rows // most), min(-(-rows // TILE), math.isqrt(2 * parallelism) + 1))


def _blocks(df: DataFrame, vec_col: str, block_rows: int) -> int:
    rows, dim = df.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(vec_col)), F.lit(0))).first()
    return block_count(rows, dim, df.sparkSession.sparkContext.defaultParallelism, block_rows)


def matrix(column) -> np.ndarray:
    """A list column as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.empty((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def best_columns(x: np.ndarray, y: np.ndarray, k: int, score, barred=None):
    """(rows, columns, scores) of the k best columns of each row, tile by tile;
    of equal ones the smaller column.  ``score(a, b)`` gives a tile's scores,
    ``barred(rows, columns)`` (slices) the cells that are no candidates."""
    found = []
    for at in range(0, len(x), TILE):
        rows = slice(at, min(at + TILE, len(x)))
        n = rows.stop - at
        kth = np.full(n, -np.inf)
        r, c, v = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for b in range(0, len(y), TILE):
            cols = slice(b, min(b + TILE, len(y)))
            s = score(x[rows], y[cols])
            if barred is not None:
                s[barred(rows, cols)] = -np.inf
            take = s > kth[:, None]  # an equal one in a later column loses
            if np.count_nonzero(take) > 8 * k * n and s.shape[1] > k:
                take &= s >= np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
            i, j = np.nonzero(take)
            if not len(i):
                continue
            r, c, v = np.concatenate([r, i]), np.concatenate([c, j + b]), np.concatenate([v, s[i, j]])
            order = np.lexsort((c, -v, r))
            r, c, v = r[order], c[order], v[order]
            place = np.arange(len(r)) - np.searchsorted(r, np.arange(n))[r]
            kth[r[place == k - 1]] = v[place == k - 1]
            r, c, v = r[place < k], c[place < k], v[place < k]
        found.append((r + at, c, v))
    return tuple(np.concatenate(p) for p in zip(*found)) if found else (np.empty(0, np.int64),) * 2 + (np.empty(0),)


def _type(df: DataFrame, c: str) -> str:
    return df.schema[c].dataType.simpleString()


def knn_join(query: DataFrame, base: DataFrame, k: int, *, id_col: str = "file_id",
             vec_col: str = "embedding", group_col: str | None = None,
             query_carry: Sequence[str] = (), base_carry: Sequence[str] = (),
             metric: str = "cosine", exclude_self: bool = True,
             block_rows: int = BLOCK_ROWS, query_blocks: int | None = None,
             base_blocks: int | None = None) -> DataFrame:
    """Top-k base rows for every query row.

    Output: ``query_id, base_id, score, rank`` + ``query_<c>`` / ``base_<c>``
    carries.  ``score`` is the cosine similarity (``metric='cosine'``), the raw
    inner product (``'dot'``) or minus the Euclidean distance (``'euclidean'``);
    higher is always better.  Base rows with the query's id (``exclude_self``)
    or the same ``group_col`` value (e.g. the same fold) are never candidates.
    """
    if metric not in ("cosine", "dot", "euclidean"):
        raise ValueError(metric)
    query, base = (d.where(F.col(vec_col).isNotNull()) for d in (query, base))
    qb = query_blocks or _blocks(query, vec_col, block_rows)
    bb = base_blocks or _blocks(base, vec_col, block_rows)
    qcols = list(dict.fromkeys([id_col, vec_col] + ([group_col] if group_col else []) + list(query_carry)))
    bcols = list(dict.fromkeys([id_col, vec_col] + ([group_col] if group_col else []) + list(base_carry)))

    # distinct column names per side: query and base are often the same DataFrame
    q = (query.select(*[F.col(c).alias(f"q__{c}") for c in qcols])
         .withColumn("_qb", F.pmod(F.xxhash64(F.col(f"q__{id_col}")), F.lit(qb)).cast("int"))
         .withColumn("_bb", F.explode(F.sequence(F.lit(0), F.lit(bb - 1)))))
    b = (base.select(*[F.col(c).alias(f"b__{c}") for c in bcols])
         .withColumn("_bb", F.pmod(F.xxhash64(F.col(f"b__{id_col}")), F.lit(bb)).cast("int"))
         .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1)))))

    out_fields = [("query_id", _type(query, id_col)), ("base_id", _type(base, id_col)),
                  ("score", "double")]
    out_fields += [(f"query_{c}", _type(query, c)) for c in query_carry]
    out_fields += [(f"base_{c}", _type(base, c)) for c in base_carry]
    schema = ", ".join(f"{n} {t}" for n, t in out_fields)
    names = [n for n, _ in out_fields]

    def unit(v):
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return v / np.where(norm == 0, 1, norm)

    def score(x, y):
        if metric != "euclidean":
            return x @ y.T
        d2 = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * (x @ y.T)
        return -np.sqrt(np.maximum(d2, 0.0))

    def plain(t, c):
        return t.column(c).to_numpy(zero_copy_only=False)

    def block_topk(q: pa.Table, b: pa.Table) -> pa.Table:
        b = b.take(pa.array(np.argsort(plain(b, f"b__{id_col}"), kind="stable")))  # of equal scores the smaller id
        x, y = matrix(q.column(f"q__{vec_col}")), matrix(b.column(f"b__{vec_col}"))
        if metric == "cosine" and len(x) and len(y):
            x, y = unit(x), unit(y)
        pairs = [(plain(q, f"q__{c}"), plain(b, f"b__{c}"))
                 for c in ([id_col] if exclude_self else []) + ([group_col] if group_col else [])]

        def barred(rows, cols):
            out = np.zeros((rows.stop - rows.start, cols.stop - cols.start), bool)
            for own, other in pairs:
                out |= np.equal.outer(own[rows], other[cols]).astype(bool)
            return out
        r, c, v = best_columns(x, y, k, score, barred if pairs else None)
        r, c = pa.array(r), pa.array(c)
        arrays = [q.column(f"q__{id_col}").take(r), b.column(f"b__{id_col}").take(c), pa.array(v, pa.float64())]
        arrays += [q.column(f"q__{f}").take(r) for f in query_carry] + [b.column(f"b__{f}").take(c) for f in base_carry]
        return pa.Table.from_arrays(arrays, names=names)

    spread = [min(qb * bb, 2000), "_qb", "_bb"]  # tiny blocks cost as much time as large ones: never coalesced
    cand = (q.repartition(*spread).groupBy("_qb", "_bb").cogroup(b.repartition(*spread).groupBy("_qb", "_bb"))
            .applyInArrow(lambda a, c: block_topk(a, c), schema))
    return first_k(cand, ["query_id"], [F.col("score").desc(), F.col("base_id")], k, out="rank")


def approx_knn_join(query: DataFrame, base: DataFrame, k: int, *, id_col: str = "file_id",
                    vec_col: str = "embedding", bucket_length: float = 0.5, num_hash_tables: int = 4,
                    max_distance: float = 1.0, **kw) -> DataFrame:
    """Approximate tier for very large sets: candidates are the pairs that share a
    random-projection LSH bucket (``BucketedRandomProjectionLSH``) within
    ``max_distance`` on unit vectors; the exact score and top-k are then taken
    over those candidates only.  Recall depends on the LSH parameters."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    from penprint.functions.vectors import l2_normalize

    def prep(df):
        return df.select(F.col(id_col).alias("_id"),
                         array_to_vector(l2_normalize(vec_col)).alias("_v"))
    qv, bv = prep(query), prep(base)
    lsh = BucketedRandomProjectionLSH(inputCol="_v", outputCol="_h", bucketLength=bucket_length,
                                      numHashTables=num_hash_tables).fit(bv)
    pairs = lsh.approxSimilarityJoin(qv, bv, max_distance, distCol="_d")
    cand = pairs.select(F.col("datasetA._id").alias("query_id"), F.col("datasetB._id").alias("base_id"),
                        (F.lit(1.0) - F.pow(F.col("_d"), 2) / 2).alias("score"))
    if kw.get("exclude_self", True):
        cand = cand.where(F.col("query_id") != F.col("base_id"))
    return first_k(cand, ["query_id"], [F.col("score").desc(), F.col("base_id")], k, out="rank")


def similarity_pairs_within(df: DataFrame, group_col: str, id_col: str = "file_id",
                            vec_col: str = "embedding", order_col: str | None = None) -> DataFrame:
    """Lower-triangle cosine similarities inside each group.

    Only for groups whose size is bounded by a parameter (a closed set has exactly
    k files per author): the pair count per group is k(k-1)/2.
    """
    from penprint.functions.vectors import cosine_similarity
    o = order_col or id_col
    a = df.select(F.col(group_col).alias("g"), F.col(id_col).alias("id_a"), F.col(o).alias("o_a"),
                  F.col(vec_col).alias("v_a"))
    b = df.select(F.col(group_col).alias("g"), F.col(id_col).alias("id_b"), F.col(o).alias("o_b"),
                  F.col(vec_col).alias("v_b"))
    return (a.join(b, "g").where(F.col("o_a") > F.col("o_b"))
            .select(F.col("g").alias(group_col), "id_a", "id_b",
                    cosine_similarity("v_a", "v_b").alias("similarity")))
