"""Headline benchmark: prints ONE JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is run to completion (``write.format('noop')`` forces the whole
plan without collecting to the driver).  The headline set runs twice: the
first (cold: JVM JIT, codegen compile) pass is reported as ``cold_queries``,
the second (warm) pass gives ``queries`` and ``value`` (their sum).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quire.plans.catalog import QUERIES  # noqa: E402
from quire.session import drop_scratch, get_session  # noqa: E402

HEADLINE = ("chunk_text", "distinct_chunks", "detect_language", "translate_documents", "build_books")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or list(HEADLINE)
    spark = get_session(f"local[{cpus}]", app="quire-bench", shuffle_partitions=int(cpus) * 2,
                        extra={"spark.driver.memory": "16g"})
    passes = []
    for _ in range(2):
        times = {}
        for name in names:
            t0 = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
            drop_scratch(spark)  # the query has run to the end: its intermediates can go
        passes.append(times)
    cold, warm = passes
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_warm", "value": round(sum(warm.values()), 3), "unit": "sec",
                      "queries": warm, "sf": sf, "cold_total": round(sum(cold.values()), 3),
                      "cold_queries": cold}))
    spark.stop()


if __name__ == "__main__":
    main()
