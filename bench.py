"""Benchmark: every catalogue query at $BENCH_SF_DIR on local[$BENCH_CPUS].

The queries of docpipe.plans.stored, which write files and run streams, are left out.
Each query is written to Spark's ``noop`` sink (so every column is computed, unlike
``count()`` which lets the optimizer prune projections). After an untimed warm-up, each
query runs twice and the faster run is reported. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from docpipe.plans.catalog import REGISTRY  # noqa: E402
from docpipe.session import build_session, checkpoint_dir  # noqa: E402

HEADLINE = ["clean_response", "document_profile", "chunk_plan"]


def main() -> None:
    data_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    only = os.environ.get("BENCH_QUERIES")
    names = only.split(",") if only else list(REGISTRY)
    m = re.search(r"sf([0-9.]+)", data_dir)
    sf = float(m.group(1)) if m else None

    spark = build_session(f"local[{cpus}]", app_name="docpipe-bench", shuffle_partitions=cpus)
    checkpoint_dir(spark)
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    stats = docs.selectExpr("count(*) AS n", "max(length(text)) AS longest").first()

    # Untimed warm-up: JVM code paths and the Python workers start before the first timing.
    for name in ("clean_response", "document_profile", "convert_documents"):
        REGISTRY[name].run(spark, data_dir).write.format("noop").mode("overwrite").save()

    timings: dict[str, float] = {}
    errors: dict[str, str] = {}
    for name in names:
        best = float("inf")
        try:
            for _ in range(repeats):
                start = time.perf_counter()
                REGISTRY[name].run(spark, data_dir).write.format("noop").mode("overwrite").save()
                best = min(best, time.perf_counter() - start)
            timings[name] = round(best, 3)
        except Exception as exc:  # noqa: BLE001 - report and go on with the other queries
            errors[name] = f"{type(exc).__name__}: {str(exc)[:200]}"

    out = {
        "metric": "sum_of_query_seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": sf,
        "documents": stats["n"],
        "largest_document_chars": stats["longest"],
        "documents_per_sec": {q: round(stats["n"] / timings[q], 1) for q in HEADLINE if q in timings and timings[q] > 0},
        "cpus": cpus,
    }
    if errors:
        out["errors"] = errors
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
