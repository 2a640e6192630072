"""Benchmark the headline jobs; prints ONE JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is fully executed (``write.format('noop')``) and timed after one
warm-up of the JVM.  ``value`` is the sum of the per-query seconds.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "m1_closed_set_knn",          # M1 closed-set 1-NN
    "m9_verification_report",     # M5+M9 histogram verification
    "m15_pair_dataset",           # M15 pair dataset
    "x10_encode_tokens",          # X9+X10 lex + encode
    "w9_simclr_batches",          # W9 contrastive batches
    "j7_knn_top5_all",
    "a6_match_quota_round_robin",
    "m16_contrastive_combinations",
    "j5_different_author_pairs",
    "k1_top_identifiers",
]


def main() -> None:
    from penprint.plans.registry import load_all
    from penprint.session import get_spark

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [a for a in sys.argv[1:]]
    spark = get_spark("penprint-bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                      extra={"spark.driver.memory": "16g"})
    reg = load_all()
    names = [n for n in (only or HEADLINE) if n in reg]
    # warm-up: JVM, then Python workers with numpy and Arrow
    reg["w5_closed_set_folds"][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.range(64).repartition(int(cpus)).mapInPandas(lambda it: it, "id long").write.format("noop").mode(
        "overwrite").save()
    times = {}
    for name in names:
        fn = reg[name][0]
        t0 = time.time()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        spark.catalog.clearCache()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else None}))
    spark.stop()


if __name__ == "__main__":
    main()
