"""Benchmark: run the query catalogue at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with the ``noop`` sink (no collect to the
driver), including building its plan; the catalogue runs ``BENCH_REPS`` times
(default 2) and each query's time is its best run (``first_run_total`` keeps
the cold pass). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spendlens.plans.catalog import QUERIES  # noqa: E402
from spendlens.session import local_session  # noqa: E402

# headline reports first; the rest of the catalogue follows
HEADLINE = ["class_share", "spend_by_class", "spend_by_group", "location_share", "selection_summary", "attach_labels", "prepare_funnel", "token_cost"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or (
        HEADLINE + [n for n in QUERIES if n not in HEADLINE]
    )
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")), app="spendlens-bench")
    # warm-up: JVM JIT, parquet footers, codegen caches (headline queries once, untimed)
    for name in ["positive_amount"] + HEADLINE[:3]:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    reps = max(1, int(os.environ.get("BENCH_REPS", "2")))
    runs: dict[str, list[float]] = {n: [] for n in names}
    errors: dict[str, str] = {}
    for _ in range(reps):
        for name in names:
            if name in errors:
                continue
            t0 = time.perf_counter()
            try:
                QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            except Exception as e:  # noqa: BLE001 - report the failure, keep timing the rest
                errors[name] = f"{type(e).__name__}: {str(e)[:300]}"
                continue
            runs[name].append(round(time.perf_counter() - t0, 3))
    # warm time per query = best of the repetitions (JIT and codegen caches warm)
    times = {n: min(v) for n, v in runs.items() if v and n not in errors}
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    out = {
        "metric": "catalogue_total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "headline_seconds": round(sum(times.get(n, 0.0) for n in HEADLINE), 3),
        "first_run_total": round(sum(v[0] for n, v in runs.items() if v and n not in errors), 3),
        "reps": reps,
    }
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
