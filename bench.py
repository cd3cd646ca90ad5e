"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local cores. One query warms the session up, then each runs
once; results go to the no-op sink, so that all columns of all rows are computed.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

WARM_UP = "k4_win_rates"
HEADLINES = [
    "b1_agreed_safe",
    "d5_preference_triples",
    "e1_supervised_examples",
    "e4_padding_report",
    "f1_bidirectional",
    "g2_corpus_bleu",
    "h8_logical_equivalence",
    "i5_group_advantages",
    "i6_reward_report",
    "i9_minmax_scale",
    "j3_clipped_objective_grpo",
    "j4_high_entropy_mask",
    "k4_win_rates",
    "flagship_formula_advantages",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("alignframe-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="alignframe-bench-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from alignframe.plans.queries import QUERIES

    names = sys.argv[1:] or HEADLINES
    QUERIES[WARM_UP](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
