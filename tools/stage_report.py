"""Stage and task metrics of a run, read from Spark's event log (no UI, no server).

Usage:
  python tools/stage_report.py [sf_dir] [case_build|hot_members|probe_hot:<families>|<query name>]

Writes the event log into a fresh scratch folder, runs the target through the
no-op sink, stops the session and prints one markdown row per stage: tasks,
median and max task run time, shuffle read / write, records written, spill.
``hot_members`` runs the member aggregation on 3M rows where one family holds
a third of them.
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def session(log_dir: str) -> SparkSession:
    spark = (SparkSession.builder.master("local[8]").appName("caseload-stages")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "8g")
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.eventLog.enabled", "true")
             .config("spark.eventLog.dir", log_dir)
             .config("spark.eventLog.compress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run_target(spark: SparkSession, sf_dir: str, target: str) -> None:
    from caseload import schema as S
    from caseload.operators.cases import member_signals
    from caseload.plans import catalog, context

    def noop(df):
        df.write.format("noop").mode("overwrite").save()

    if target == "case_build":
        context.cases(spark, sf_dir)
    elif target.startswith("probe_hot:"):  # generated tables, one family with 1/3 of the member rows
        from tools.scale_probe import build
        build(spark, int(target.split(":")[1]), hot=True)
    elif target == "hot_members":
        r = spark.range(0, 3_000_000, 1, 16)
        fid = F.when(r.id % 3 == 0, F.lit(0)).otherwise(r.id % 100_000 + 1)
        members = r.select(fid.alias(S.MemberCols.FAMILY_ID), F.lit(S.YES).alias(S.MemberCols.IS_HOH),
                           (r.id % 53 == 0).cast("double").alias(S.MemberCols.V_CHRONIC_DISEASE))
        noop(member_signals(members))
    else:
        noop(catalog.QUERIES[target](spark, sf_dir))


def _mb(b: float) -> str:
    return f"{b / 2**20:.2f}"


def report(log_dir: str) -> str:
    tasks = defaultdict(list)
    names = {}
    for path in glob.glob(os.path.join(log_dir, "**", "events_*"), recursive=True) + \
            glob.glob(os.path.join(log_dir, "local-*")):
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerTaskEnd":
                    m = ev.get("Task Metrics") or {}
                    sr = m.get("Shuffle Read Metrics") or {}
                    sw = m.get("Shuffle Write Metrics") or {}
                    tasks[ev["Stage ID"]].append({
                        "run": m.get("Executor Run Time", 0),
                        "read": sr.get("Remote Bytes Read", 0) + sr.get("Local Bytes Read", 0),
                        "write": sw.get("Shuffle Bytes Written", 0),
                        "records": sw.get("Shuffle Records Written", 0),
                        "spill": m.get("Memory Bytes Spilled", 0) + m.get("Disk Bytes Spilled", 0),
                    })
                elif kind == "SparkListenerStageCompleted":
                    info = ev["Stage Info"]
                    names[info["Stage ID"]] = info["Stage Name"].split(" at ")[0]
    lines = ["| stage | name | tasks | median ms | max ms | shuffle read MB | shuffle write MB | records written | spill MB |",
             "|---|---|---|---|---|---|---|---|---|"]
    for sid in sorted(tasks):
        ts = tasks[sid]
        runs = [t["run"] for t in ts]
        lines.append(f"| {sid} | {names.get(sid, '?')} | {len(ts)} | {statistics.median(runs):.0f} | {max(runs)} | "
                     f"{_mb(sum(t['read'] for t in ts))} | {_mb(sum(t['write'] for t in ts))} | "
                     f"{sum(t['records'] for t in ts)} | {_mb(sum(t['spill'] for t in ts))} |")
    return "\n".join(lines)


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.1"
    target = next((a for a in args if not a.startswith("/")), "case_build")
    log_dir = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark = session(log_dir)
    run_target(spark, sf_dir, target)
    spark.stop()
    print(f"### {target} ({sf_dir})\n")
    print(report(log_dir))


if __name__ == "__main__":
    main()
