"""Time the headline queries at one scale and print ONE JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default the headline set). Each query runs to completion
through the ``noop`` sink (every row produced, nothing collected); the value is the
sum of the per-query wall times, after two untimed warm-up queries on the smallest
scale (JIT and codegen caches).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "triangles_total", "local_clustering", "average_clustering", "global_clustering",
    "transitivity", "degrees_multi", "connected_components", "top_components_edges",
    "label_propagation", "modularity_half_intra", "lpa_modularity_half_intra",
    "graph_report", "blocks_ingest", "block_range_sample", "snowball_sample", "assign_ids",
]


def main() -> None:
    from txgraph.plans.catalog import QUERIES
    from txgraph.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None

    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2, app="txgraph-bench")
    # warm-up (not timed): JVM JIT and codegen caches, on the smallest scale when present
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    warm_dir = warm_dir if os.path.isdir(warm_dir) else sf_dir
    for name in ("degrees_multi", "triangles_total"):
        QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"# {name}: {times[name]:.2f}s", file=sys.stderr)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total_sec", "value": total, "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
