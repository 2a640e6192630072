"""Contrastive batch losses (A16, A17), one grouped call for each batch.

Input: one row per (batch, slot) with two views ``v1``, ``v2`` (arrays).  A
batch has ``b`` rows (a parameter), so a call holds b^2 similarities — bounded
by the batch size, never by the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _unit(column) -> np.ndarray:
    x = np.array(column.to_pylist(), np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cross_entropy(logits: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """-log softmax of each row at its positive column; -inf entries are masked."""
    top = logits.max(axis=1, keepdims=True)
    lse = top[:, 0] + np.log(np.exp(logits - top).sum(axis=1))
    return lse - logits[np.arange(len(logits)), positive]


def _per_batch(views: DataFrame, loss, batch: str, v1: str, v2: str) -> DataFrame:
    def run(table):
        return pa.table({batch: table.column("b").slice(0, 1),
                         "loss": pa.array([float(loss(_unit(table.column("x")), _unit(table.column("y"))))])})
    rows = views.select(F.col(batch).alias("b"), F.col(v1).alias("x"), F.col(v2).alias("y"))
    return rows.groupBy("b").applyInArrow(run, f"{batch} {views.schema[batch].dataType.simpleString()}, loss double")


def simclr_loss(views: DataFrame, temperature: float = 1.0, batch: str = "batch", slot: str = "slot",
                v1: str = "v1", v2: str = "v2") -> DataFrame:
    """A16 (method 2): per batch, mean over both views of the softmax
    cross-entropy of each row against all rows of the other view (positive =
    same slot) and the other rows of its own view.  Output (batch, loss)."""
    def loss(a, b):
        n = len(a)
        own = np.arange(n)
        total = 0.0
        for x, y in ((a, b), (b, a)):
            near = x @ x.T / temperature
            near[own, own] = -np.inf
            total += _cross_entropy(np.concatenate([x @ y.T / temperature, near], axis=1), own).sum()
        return total / (2 * n)
    return _per_batch(views, loss, batch, v1, v2)


def simclr_loss_matrix(views: DataFrame, temperature: float = 1.0, batch: str = "batch", slot: str = "slot",
                       v1: str = "v1", v2: str = "v2") -> DataFrame:
    """A17 (method 1): the same objective from the stacked 2b x 2b similarity:
    row r = (view, slot); positive = the other view of the same slot; the
    mask removes only r itself.  Equal to A16 by construction of the logit set."""
    def loss(a, b):
        z = np.concatenate([a, b])
        own = np.arange(len(z))
        sim = z @ z.T / temperature
        sim[own, own] = -np.inf
        return _cross_entropy(sim, (own + len(a)) % len(z)).mean()
    return _per_batch(views, loss, batch, v1, v2)
