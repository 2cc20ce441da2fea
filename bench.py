"""Time the headline queries: BENCH_SF_DIR (default sf0.1) on local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = (
    "curated_overview", "ws_normalize", "license_rule_a", "char_chunks", "exact_dedupe_keep_first", "dedupe_report", "cross_source_match", "enrich_keep_last", "match_cascade",
    "composite_lookup", "theta_candidates_top20", "best_of_group", "array_overlap_filter", "keyed_upsert", "running_counters", "global_id", "knn_topk", "html_title_links", "prompt_assembly", "benchmark_overlap", "paragraph_pack", "routing_split", "factoid_counts",
)


def main() -> None:
    from loomstone.plans import everything
    from loomstone.session import session

    spark = session("bench", f"local[{CPUS}]", **{"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        took = []
        for _ in range(RUNS + 1):  # the first warms up
            began = time.perf_counter()
            everything.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        times[name] = round(median(took[1:] or took), 4)
    spark.stop()
    print(json.dumps({"metric": "headline queries, sum of warm medians", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "sf": Path(SF_DIR).name, "cpus": int(CPUS)}))


if __name__ == "__main__":
    main()
