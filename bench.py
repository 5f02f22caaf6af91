"""Benchmark: the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

All queries run in one session and share the analysis artifacts (clean
table, fitted models, linkage) the way one analysis run does; each query's
time is the wall time of executing its full plan into Spark's ``noop`` sink
(no rows are shipped to Python), so artifacts are charged to the first query
that needs them.  ``value`` is the total wall time.  Prints exactly one JSON
line on stdout.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "q_clean", "q_missing", "q_describe", "q_skew", "q_corr", "q_rate_by", "q_crosstab", "q_box", "q_kde",
    "q_strat_split", "q_model_compare", "q_ols_inference", "q_vif", "q_enet_cv", "q_depth_curve", "q_importance",
    "q_paths", "q_cluster_compare", "q_segments", "q_high_risk", "q_fairness", "q_report_facts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("COHORTLAB_SCRATCH", tempfile.mkdtemp(prefix="cohortlab-bench-"))
    from cohortlab.session import get_session
    from cohortlab.plans.registry import all_queries

    spark = get_session(cores=cpus, shuffle_partitions=max(8, 2 * int(cpus)), app="cohortlab-bench")
    qs = all_queries()
    times: dict[str, float] = {}
    t_all = time.time()
    for name in HEADLINE:
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    total = round(time.time() - t_all, 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_sec", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
