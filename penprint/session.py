"""Session helpers: a tuned local/cluster session and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job in this package assumes.  AQE re-plans joins at runtime
# (broadcast when a side turns out small, skew-join splitting, partition
# coalescing), which is what keeps the fixed plans below sane at both 60k and
# 10^11 rows.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # group-limit pushdown (partial top-k before the shuffle) for row_number <= k
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000",
}


def get_spark(app: str = "penprint", master: str | None = None,
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if (master or "").startswith("local"):
        conf["spark.driver.memory"] = "12g"  # local mode: the driver JVM is the whole cluster
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, required: bool = True) -> str | None:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    On a cluster this is configured by the operator and is only read here.  Only
    when it is unset *and* the master is local (tests, laptops) is a private
    temporary folder set, because a machine-local folder is meaningless on a
    cluster.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        if required:
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        return None
    path = tempfile.mkdtemp(prefix="penprint-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return path


def one_blas_thread(spark: SparkSession) -> None:
    """Python workers started from now on run numpy's products in one thread:
    Spark has a task for each core, and threads of all tasks would crowd them."""
    for name in ("OPENBLAS_NUM_THREADS", "OMP_NUM_THREADS"):
        spark.sparkContext.environment.setdefault(name, "1")


def cut_lineage(df):
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
