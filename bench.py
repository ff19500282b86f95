"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from watchglass.plans import catalogue  # noqa: E402
from watchglass.plans.catalogue.matching import many_rules  # noqa: E402
from watchglass.plans.session import local_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "2"))

HEADLINE = (
    "rul_matches", "rul_alerts", "rul_hundred_rules", "rul_documents",
    "cor_event_count", "cor_value_count", "cor_temporal", "cor_temporal_ordered",
    "cor_temporal_ordered3", "cor_percentile", "cor_fanout", "cor_nested", "cor_suppress",
    "jon_alerts_with_events", "not_rate_limit", "anl_top_rules", "anl_heatmap",
    "met_sum", "met_threshold", "met_absence", "src_events_all", "shp_syslog",
    "prd_keyword", "prd_expand_join", "str_event_count",
)


def main() -> None:
    spark = local_session(CPUS, "bench")
    known = catalogue.all_queries()
    runs = {name: known[name] for name in HEADLINE}
    runs["rul_thousand_rules"] = many_rules(1000)
    spark.read.parquet(f"{SF_DIR}/events.parquet").count()  # start the JVM before timing

    timings: dict[str, float] = {}
    for name, fn in runs.items():
        best = None
        for _ in range(REPEATS):
            start = time.perf_counter()
            fn(spark, SF_DIR).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        timings[name] = round(best, 3)
        print(f"{name} {best:.2f}", file=sys.stderr, flush=True)
    events = spark.read.parquet(f"{SF_DIR}/events.parquet").count()
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": Path(SF_DIR).name.removeprefix("sf"),
        "cpus": CPUS,
        "event_rows_per_sec": {
            name: round(events / timings[name])
            for name in timings if name.startswith(("rul_", "cor_", "str_"))
        },
    }))


if __name__ == "__main__":
    main()
