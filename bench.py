"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every query runs to the end into a sink that keeps nothing. The time is the
better of two runs with a fresh plan each, so that it is not the JVM's warm-up.
"""

from __future__ import annotations

import json
import os
import sys
import time

from leaksieve.plans import catalog
from leaksieve.session import local_session

HEADLINE = (
    "token_totals",
    "token_scan",
    "entropy_filter",
    "complexity_filter",
    "regex_filter",
    "regex_rules_join",
    "default_scan",
    "detect_any_rule",
    "findings_by_file",
    "scan_gate",
    "clean_files",
    "scan_eligible",
    "scan_changed",
    "scan_file_list",
    "merge_scans",
    "mask_lines",
    "mask_reported",
    "restore_lines",
    "literal_scan",
    "entropy_short",
    "token_entropy",
    "scan_pages",
    "stream_scan",
    "stream_gate",
    "stream_batch_gate",
    "rules_table_scan",
    "unit_scan",
    "scan_bytes",
    "folder_scan",
    "stream_folder_scan",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or os.cpu_count()
    chosen = sys.argv[1:] or HEADLINE
    # The tables have one row group each; they are dealt over the cores, which the times include.
    spark = local_session("bench", cpus, spark__leaksieve__spread="true")
    times: dict[str, float] = {}
    for name in chosen:
        query = catalog.queries()[name]
        runs = []
        for _ in range(2):
            started = time.perf_counter()
            query(spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
        times[name] = round(min(runs), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
