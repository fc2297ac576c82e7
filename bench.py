"""Wall seconds of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from plumbline import catalog  # noqa: E402
from plumbline.session import build_session  # noqa: E402

HEADLINE = [
    "diversity_score",
    "column_stats",
    "distribution_fidelity",
    "correlation_preservation",
    "entropy_stability",
    "spectral_coherence",
    "generalization_gap",
    "statistical_consistency",
    "pair_verdict",
    "problem_summary",
    "problem_regions",
    "stratified_sample",
    "match_exact",
    "recommendation_candidates",
    "select_plan_balanced",
    "plan_totals",
    "decide",
    "rate_violations",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(cores)
    spark.range(1000).selectExpr("sum(id)").collect()  # starts the executor threads
    queries, _ = catalog.load()
    times = {}
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(folder).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
