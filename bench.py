"""Time the headline queries and print one JSON line.

BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS choose the data, the threads and the timed runs per
query (the median counts; one untimed run comes first). Names as arguments time only those.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from canvass.session import build_session  # noqa: E402
from proofs.queries import queries  # noqa: E402

HEADLINE = (
    "scan_filter", "minmax_probe", "surrogate_keys", "case_fact", "propagate_id", "flag_chain",
    "stage_funnel", "stage_sequence", "daily_cumulative", "screener_report",
    "person_family_report", "appointment_report", "screened_case_join", "anti_not_in",
    "group_broadcast", "dedup_prefer_worked", "health_questions", "freq_table", "freq_masked",
    "codebook", "row_id", "sort_nulls_last", "slicer_labels", "labelled_freq",
)


def seconds(run, spark, folder: str) -> float:
    start = time.perf_counter()
    run(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main(names: list[str]) -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
                          spark__ui__enabled="false", spark__driver__memory="12g",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    registered, timed = queries(), {}
    for name in names or HEADLINE:
        seconds(registered[name], spark, folder)
        timed[name] = round(statistics.median(
            seconds(registered[name], spark, folder) for _ in range(runs)), 3)
        print(name, timed[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(timed.values()), 3),
                      "unit": "sec", "queries": timed, "sf": Path(folder).name[2:]}))


if __name__ == "__main__":
    main(sys.argv[1:])
