"""Experiment grids and result tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def param_grid(spark: SparkSession, params: dict, tied: list[str] | None = None) -> DataFrame:
    """Cartesian product of the value lists, in ``itertools.product`` order
    (``combination`` = position).  ``tied`` keys (e.g. train/val/test data
    files) are zipped into one axis at the place of the first of them.  Values
    are kept as JSON text.  One ``posexplode`` per axis multiplies the rows, so
    the product is never built on the driver."""
    tied = list(tied or [])
    axes: list[tuple[str, list]] = []
    for k, v in params.items():
        if k in tied:
            if k == tied[0]:
                axes.append(("|".join(tied), [list(t) for t in zip(*[params[t] for t in tied])]))
        else:
            axes.append((k, list(v)))
    df = spark.range(1).select(F.lit(0).cast("bigint").alias("combination"))
    n_after = 1
    for name, vals in reversed(axes):
        arr = F.array(*[F.lit(json.dumps(v)) for v in vals])
        df = df.select("*", F.posexplode(arr).alias("_i", name))
        df = df.withColumn("combination", F.col("combination") + F.col("_i") * n_after).drop("_i")
        n_after *= len(vals)
    if tied:
        tk = "|".join(tied)
        for i, k in enumerate(tied):
            df = df.withColumn(k, F.get_json_object(F.col(tk), f"$[{i}]"))
        df = df.drop(tk)
    return df.select("combination", *params.keys())


def select_combinations(spark: SparkSession, spec: str) -> DataFrame | None:
    """``"0 3:6 -1"`` -> combinations 0, 3, 4, 5; ``-1`` means all (None)."""
    parts = spec.split()
    if "-1" in parts:
        return None
    df = None
    for p in parts:
        if ":" in p:
            a, b = p.split(":")
            d = spark.range(int(a), int(b))
        else:
            d = spark.range(int(p), int(p) + 1)
        df = d if df is None else df.unionByName(d)
    return df.withColumnRenamed("id", "combination").distinct()


def parse_params(col: str = "model_params"):
    """A Python-dict literal (``{'C': 100, 'kernel': 'rbf', 'x': True}``)
    as map<string,string>: keys and scalar values extracted by pattern."""
    body = F.regexp_replace(F.col(col), r"^\s*\{|\}\s*$", "")
    pairs = F.regexp_extract_all(body, F.lit(r"'([^']*)'\s*:\s*('[^']*'|[^,]+)"), 0)
    keys = F.transform(pairs, lambda p: F.regexp_extract(p, r"^'([^']*)'", 1))
    vals = F.transform(pairs, lambda p: F.trim(F.regexp_replace(F.regexp_extract(p, r":\s*(.*)$", 1), "^'|'$", "")))
    return F.map_from_arrays(keys, vals)


def best_epoch(history: DataFrame, by=("combination",)) -> DataFrame:
    """Metrics at the epoch with the lowest ``val_loss`` (first on ties);
    ``loss`` reported as ``train_loss``."""
    cols = [c for c in history.columns if c not in by]
    best = history.groupBy(*by).agg(F.min_by(F.struct(*cols), F.struct("val_loss", "epoch")).alias("_b"))
    out = best.select(*by, *[F.col(f"_b.{c}").alias(c) for c in cols])
    return out.withColumnRenamed("loss", "train_loss") if "loss" in cols else out


def best_per_combination(results: DataFrame, by=("combination",), metric: str = "accuracy",
                         tie: str | None = None) -> DataFrame:
    """The best row (highest metric, then highest ``tie``) per combination —
    a ``max_by`` aggregate, partial per map task."""
    cols = [c for c in results.columns if c not in by]
    key = F.struct(F.col(metric), F.col(tie)) if tie else F.col(metric)
    best = results.groupBy(*by).agg(F.max_by(F.struct(*cols), key).alias("_b"))
    return best.select(*by, *[F.col(f"_b.{c}").alias(c) for c in cols])


def upsert_results(old: DataFrame, new: DataFrame, key_cols, ts_col: str = "run_ts") -> DataFrame:
    """One row per full parameter tuple, the one with the latest ``ts_col``;
    a new row wins against an old one of the same time, further ties go to the
    larger row.  Null keys are values like any other (grouping, not a join)."""
    keys = list(key_cols)
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys and c != "_new"]
    row = F.struct(*[F.col(c) for c in rest])
    last = both.groupBy(*keys).agg(F.max_by(row, F.struct(F.col(ts_col), F.col("_new"), row)).alias("_r"))
    return last.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def leaderboard(results: DataFrame, group=("model", "k_cross_val", "max_authors"),
                metric: str = "accuracy") -> DataFrame:
    """Best result per (model, k, max_authors) over all experiments, with
    its rank inside the group's experiments."""
    w = Window.partitionBy(*group).orderBy(F.col(metric).desc(), F.col("experiment"))
    ranked = results.withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") == 1)
