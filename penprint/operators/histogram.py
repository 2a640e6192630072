"""Histogram densities (A18) and their lookup.

``histogram_auto`` reproduces ``np.histogram(bins='auto')`` + ``rv_histogram``:
bin width = min(Freedman–Diaconis, Sturges) (Sturges when the IQR is 0),
``ceil(range / width)`` equal bins from min to max (a one-unit range centred
on the value when all values are equal), numpy's edge arithmetic and its
one-ulp corrections, and density = count / (N * width).

Everything is distributed: min/max/count are one aggregate; the exact
quartiles come from a bucketed global rank
(no single-task sort, only the two or four order statistics reach the
driver); bin counts are a grouped count.
The bin table is small (its size is known on the driver before it is used in
a broadcast join).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


PDF_FLOOR = 1e-11
BROADCAST_MAX_BINS = 1_000_000


def _lerp(a: float, b: float, t: float) -> float:
    """numpy's linear interpolation (exact at both ends)."""
    d = b - a
    return b - d * (1 - t) if t >= 0.5 else a + d * t


#: Values of one bracket that may be sorted and collected.
KEEP = 10_000
#: Half the width of a bracket, in shares of all rows; the sketch's error is a third.
BRACKET, ACCURACY = 3e-4, 10_000


def order_statistics(values: DataFrame, ranks, n: int) -> dict[int, float]:
    """{rank: value} of the 0-based ``ranks`` of the one column ``_v``, without
    nulls, of ``n`` rows.

    Approximate quantiles are the splitters of a bracket around each rank; one pass
    counts what lies below and at each splitter.  A rank on a splitter is found (so
    repeated values cost nothing, however often they occur); another lies strictly
    between two of them, where it is looked for again.  Nothing depends on how the
    values are spread, and no task sorts more than ``KEEP`` of them."""
    ranks = sorted(set(ranks))
    if not ranks:
        return {}
    if n <= KEEP:
        got = [r[0] for r in values.orderBy("_v").collect()]
        return {r: got[r] for r in ranks}
    shares = sorted({min(1.0, max(0.0, r / n + d)) for r in ranks for d in (-BRACKET, BRACKET)})
    split = sorted(set(values.agg(F.percentile_approx("_v", shares, ACCURACY)).first()[0]))
    v = F.col("_v")
    counts = values.agg(*(F.count_if(v < F.lit(s)) for s in split), *(F.count_if(v <= F.lit(s)) for s in split)).first()
    below, upto = counts[:len(split)], counts[len(split):]
    found, inside = {}, {}
    for r in ranks:
        i = sum(u <= r for u in upto)  # splitters wholly before the rank
        if i < len(split) and below[i] <= r:
            found[r] = split[i]
        else:
            inside.setdefault(i, []).append(r)
    for i, own in inside.items():
        first, last = (upto[i - 1] if i else 0), (below[i] if i < len(split) else n)
        part = values
        if i:
            part = part.where(v > F.lit(split[i - 1]))
        if i < len(split):
            part = part.where(v < F.lit(split[i]))
        got = order_statistics(part, [r - first for r in own], last - first)
        found |= {r + first: x for r, x in got.items()}
    return found


def exact_quantiles(df: DataFrame, col: str, probs, n: int | None = None,
                    mn: float | None = None, mx: float | None = None) -> list[float]:
    """Linear-interpolated quantiles (numpy default / SQL percentile_cont)."""
    if n is None or mn is None or mx is None:
        r = df.agg(F.count(col).alias("n"), F.min(col).alias("mn"), F.max(col).alias("mx")).first()
        n, mn, mx = r["n"], r["mn"], r["mx"]
    if n == 0:
        return [float("nan")] * len(probs)
    if mn == mx:
        return [float(mn)] * len(probs)
    want = {}
    for p in probs:
        pos = p * (n - 1)
        want[p] = (math.floor(pos), min(math.floor(pos) + 1, n - 1), pos - math.floor(pos))
    values = df.select(F.col(col).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    got = order_statistics(values, [r for lo, hi, _ in want.values() for r in (lo, hi)], n)
    return [_lerp(got[lo], got[hi], t) for lo, hi, t in (want[p] for p in probs)]


@dataclass
class Histogram:
    first_edge: float
    last_edge: float
    n_bins: int
    n: int
    bins: DataFrame  # (bin, lo, hi, count, pdf)

    @property
    def step(self) -> float:
        return (self.last_edge - self.first_edge) / self.n_bins

    def edge(self, i: Column) -> Column:
        """numpy.linspace edge i (the last edge is exactly ``last_edge``)."""
        return F.when(i >= self.n_bins, F.lit(self.last_edge)).otherwise(
            i.cast("double") * F.lit(self.step) + F.lit(self.first_edge))

    def bin_of(self, x: Column, for_counting: bool) -> Column:
        """Bin index of x.  Counting (np.histogram): the last bin is closed.
        Lookup (rv_histogram.pdf): half-open everywhere; outside -> null."""
        lo, hi, nb = self.first_edge, self.last_edge, self.n_bins
        b0 = F.floor((x - F.lit(lo)) / F.lit(hi - lo) * F.lit(nb)).cast("bigint")
        if for_counting:
            b0 = F.when(b0 == nb, F.lit(nb - 1)).otherwise(b0)
            b1 = F.when(x < self.edge(b0), b0 - 1).otherwise(b0)
            b2 = F.when((x >= self.edge(b1 + 1)) & (b1 != nb - 1), b1 + 1).otherwise(b1)
            return b2
        b1 = F.when(x < self.edge(b0), b0 - 1).otherwise(b0)
        b2 = F.when(x >= self.edge(b1 + 1), b1 + 1).otherwise(b1)
        return F.when((x >= F.lit(lo)) & (x < F.lit(hi)), b2)

    def pdf(self, df: DataFrame, x: str, out: str, floor: float | None = PDF_FLOOR) -> DataFrame:
        """Attach the density at column ``x`` (0 outside the support,
        floored at ``floor``) with a broadcast join on the bin number."""
        t = self.bins.select(F.col("bin").alias(f"_{out}_bin"), F.col("pdf").alias(f"_{out}_pdf"))
        if self.n_bins <= BROADCAST_MAX_BINS:
            t = F.broadcast(t)
        res = df.withColumn(f"_{out}_bin", self.bin_of(F.col(x), False)).join(t, f"_{out}_bin", "left")
        val = F.coalesce(F.col(f"_{out}_pdf"), F.lit(0.0))
        if floor is not None:
            val = F.greatest(val, F.lit(floor))
        return res.withColumn(out, val).drop(f"_{out}_bin", f"_{out}_pdf")


def auto_bin_count(n: int, mn: float, mx: float, q1: float, q3: float) -> tuple[float, float, int]:
    first, last = (mn - 0.5, mx + 0.5) if mn == mx else (mn, mx)
    sturges = (mx - mn) / (math.log2(n) + 1.0)
    fd = 2.0 * (q3 - q1) * n ** (-1.0 / 3.0)
    width = min(fd, sturges) if fd else sturges
    nb = int(math.ceil((last - first) / width)) if width else 1
    return first, last, max(nb, 1)


def histogram_auto(values: DataFrame, col: str) -> Histogram:
    """Fit a histogram density to ``values[col]``."""
    spark: SparkSession = values.sparkSession
    # one column of numbers, read by four passes: kept until the bins are counted
    v = values.select(F.col(col).cast("double").alias("_v")).where(F.col("_v").isNotNull()).persist()
    r = v.agg(F.count("_v").alias("n"), F.min("_v").alias("mn"), F.max("_v").alias("mx")).first()
    n, mn, mx = int(r["n"]), float(r["mn"]), float(r["mx"])
    q1, q3 = exact_quantiles(v, "_v", [0.25, 0.75], n, mn, mx)
    first, last, nb = auto_bin_count(n, mn, mx, q1, q3)
    hist = Histogram(first, last, nb, n, None)  # type: ignore[arg-type]
    counts = v.groupBy(hist.bin_of(F.col("_v"), True).alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    edges = spark.range(nb).select(F.col("id").alias("bin"))
    edges = edges.select("bin", hist.edge(F.col("bin")).alias("lo"), hist.edge(F.col("bin") + 1).alias("hi"))
    bins = (edges.join(counts, "bin", "left").fillna(0, ["count"])
            .withColumn("pdf", F.col("count") / (F.lit(float(n)) * (F.col("hi") - F.col("lo")))))
    hist.bins = bins.select("bin", "lo", "hi", "count", "pdf").persist()  # nb rows, reused by every lookup
    hist.bins.count()
    v.unpersist()
    return hist


def density_grid(hist: Histogram, points: int = 100) -> DataFrame:
    """The density on ``linspace(lo, hi, points, endpoint=False)``."""
    spark = hist.bins.sparkSession
    step = (hist.last_edge - hist.first_edge) / points
    g = spark.range(points).select(F.col("id").alias("point"),
                                   (F.col("id").cast("double") * F.lit(step) + F.lit(hist.first_edge)).alias("x"))
    return hist.pdf(g, "x", "pdf", floor=None)


def kde_grid(values: DataFrame, col: str, points: int = 200, adjust: float = 0.25, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density of ``values[col]`` on ``points`` places from
    ``cut`` bandwidths below the smallest to ``cut`` above the largest value;
    bandwidth = ``adjust`` * n^(-1/5) * standard deviation.  Each task adds up its
    own values' kernels, so ``points`` partial sums a task are all that is shuffled.
    Equal values have no bandwidth and give no rows."""
    import numpy as np
    import pyarrow as pa
    spark: SparkSession = values.sparkSession
    v = values.select(F.col(col).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    n, mn, mx, sd = v.agg(F.count("_v"), F.min("_v"), F.max("_v"), F.stddev_samp("_v")).first()
    if not n or not sd:
        return spark.createDataFrame([], "point int, x double, pdf double")
    width = adjust * n ** -0.2 * sd
    low, step = mn - cut * width, (mx - mn + 2 * cut * width) / (points - 1)

    def add(batches):
        x, total = low + step * np.arange(points), np.zeros(points)
        for b in batches:
            a = b.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(a), 4096):
                total += np.exp(-0.5 * ((x[:, None] - a[None, i:i + 4096]) / width) ** 2).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(points, dtype=np.int32)), pa.array(total)], ["point", "s"])

    sums = v.mapInArrow(add, "point int, s double").groupBy("point").agg(F.sum("s").alias("s"))
    return sums.select("point", (F.lit(low) + F.lit(step) * F.col("point")).alias("x"),
                       (F.col("s") / F.lit(n * width * math.sqrt(2 * math.pi))).alias("pdf"))
