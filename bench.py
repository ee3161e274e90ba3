"""Time the headline queries. ``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the threads.

Prints one JSON line. Every query is computed in full (no-op sink), once after a short warm-up of
the session; the value is the sum over the queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

from partsight import plans
from partsight.session import local_session

HEADLINES = (
    "fitment_verdict", "fitment_set", "fitment_questions", "set_availability", "availability_claim",
    "price_claim", "product_search", "msg_seq", "enqueue_merge", "requeue_merge", "send_eligible",
    "outbox_stop", "dq_row_rules", "attempt_stats", "pagination_audit", "rate_window",
    "schema_issues", "pii_mask", "text_normalize", "part_number_candidates", "policy_exempt",
    "policy_draft_verdict", "policy_rules", "field_stats", "link_stats", "path_rollup",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus)
    queries = plans.queries()
    names = sys.argv[1:] or HEADLINES
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
