"""Per-query stage, task and shuffle volumes from Spark's event log.

Usage: python tools/stage_report.py [sf_dir] [name ...]
Runs each query once (collect) with event logging into a fresh scratch folder (no
UI, no server), then reads the log: for every query, the stages it ran, their
tasks, the bytes read from files and the bytes written to / read from shuffles.
Prints one JSON object per query.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from pulse.plans.catalog import load_all  # noqa: E402
from pulse.session import SCALE_CONF  # noqa: E402

METRICS = {
    "internal.metrics.input.bytesRead": "input_bytes",
    "internal.metrics.shuffle.write.bytesWritten": "shuffle_write_bytes",
    "internal.metrics.shuffle.read.localBytesRead": "shuffle_read_bytes",
    "internal.metrics.shuffle.read.remoteBytesRead": "shuffle_read_bytes",
}


def main():
    args = sys.argv[1:]
    sf = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.1"
    names = [a for a in args if not os.path.isdir(a)] or ["kpi_summary", "sales_timeseries", "dau_by_dim",
                                                           "churn_features", "ab_test_summary"]
    log_dir = tempfile.mkdtemp(prefix="pulse-evlog-", dir="/tmp")
    b = (SparkSession.builder.master("local[8]").appName("pulse-stage-report")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", log_dir)
         .config("spark.eventLog.compress", "false")
         .config("spark.sql.shuffle.partitions", "16"))
    for k, v in SCALE_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    reg = load_all()
    for n in names:
        spark.sparkContext.setJobDescription(n)
        reg[n].run(spark, sf).collect()
    spark.sparkContext.setJobDescription(None)
    spark.stop()
    stage_query, out = {}, {n: {"jobs": 0, "stages": 0, "tasks": 0, "input_bytes": 0, "shuffle_write_bytes": 0,
                                "shuffle_read_bytes": 0} for n in names}
    paths = sorted(p for p in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True) if os.path.isfile(p))
    for path in paths:
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    q = (ev.get("Properties") or {}).get("spark.job.description")
                    if q in out:
                        out[q]["jobs"] += 1
                        for sid in ev.get("Stage IDs", []):
                            stage_query[sid] = q
                elif kind == "SparkListenerStageCompleted":
                    info = ev["Stage Info"]
                    q = stage_query.get(info["Stage ID"])
                    if q is None or "Completion Time" not in info:
                        continue
                    out[q]["stages"] += 1
                    out[q]["tasks"] += info.get("Number of Tasks", 0)
                    for acc in info.get("Accumulables", []):
                        key = METRICS.get(acc.get("Name"))
                        if key:
                            out[q][key] += int(acc.get("Value", 0))
    for n in names:
        print(json.dumps({"query": n, "sf": sf, **out[n]}))


if __name__ == "__main__":
    main()
