"""Vector expressions on ``array<float|double>`` columns.

All sums run in double precision through ``aggregate`` in the JVM (interpreted
inside the stage, as higher-order functions are); there is no Python on this
path.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(a) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a) -> Column:
    """Unit-length copy of ``a`` (double elements); zero vectors stay zero."""
    n = l2_norm(a)
    return F.transform(_c(a), lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def cosine_similarity(a, b) -> Column:
    return dot(a, b) / (l2_norm(a) * l2_norm(b))


def euclidean_distance(a, b, eps: float = 1e-7) -> Column:
    """``sqrt(max(sum((x-y)^2), eps))`` as in the contrastive model's distance layer."""
    sq = F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)),
                     F.lit(0.0), lambda acc, x: acc + x)
    return F.sqrt(F.greatest(sq, F.lit(eps)))


def unit_distance_from_cosine(cos: Column) -> Column:
    """Euclidean distance between unit vectors: sqrt(2 - 2 cos)."""
    return F.sqrt(F.greatest(F.lit(2.0) - F.lit(2.0) * cos, F.lit(0.0)))
