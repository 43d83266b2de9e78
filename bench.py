"""Benchmark the headline queries and print one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma
list of query keys, optional). Each query runs to completion into the ``noop`` sink, so the whole
plan executes without collecting rows to the driver.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "G1_queue_stats", "G2_queue_stats_total", "G5_latency_metrics", "B3_list_tasks", "U1_claim_batch",
    "U3_reset_stale", "U2_fold_transitions", "O1_claim_order", "W3_queue_depth", "P1_html_to_blocks",
    "P2_blocks_to_markdown", "P7_convert_documents", "V1b_embed_texts_arrow", "V3_cosine_top_k",
    "V6_retrieve_then_rerank", "K3_queue_monitor", "K2_live_ledger", "K6c_topic_retention",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE

    from scriptorium.plans import registry
    from scriptorium.session import build_session

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2),
                          extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="scriptorium-bench-")})
    # warm-up, not timed: JVM code paths, and one Arrow pass so every Python worker is started
    registry.QUERIES["G1_queue_stats"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    (spark.range(0, cpus * 1000, 1, cpus).mapInPandas(lambda it: (b for b in it), "id long")
     .write.format("noop").mode("overwrite").save())

    times: dict[str, float] = {}
    for key in wanted:
        t0 = time.time()
        registry.QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
