"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from bitcurve.session import local_session  # noqa: E402
from workload import load  # noqa: E402

HEADLINE = (
    "d12_compare_policy",
    "g2_slack_grid",
    "h1_calibration_grid",
    "h3_eligible_dual",
    "e1_source_bootstrap",
    "e1_poisson_bootstrap",
    "e2_shared_resamples",
    "f2_balanced_pick",
    "f3_capped_round_robin",
    "f9_staged_plan",
    "d15_sequence_bd",
    "d16_coco_map",
    "d19_sequence_metrics",
    "d23_saving_quantiles",
    "i6_exported_scores",
    "k2_streaming_curve",
    "l2_complete_grid",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor before the clock runs
    wanted = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in wanted:
        for _ in range(2):  # the first run compiles code and starts workers; the second counts
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
            }
        )
    )


if __name__ == "__main__":
    main()
