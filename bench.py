"""Benchmark of the headline queries.

Runs at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[$BENCH_CPUS]``
and prints ONE JSON line: {"metric", "value", "unit", "queries", "sf", ...}.

Every timed query is executed in full through the no-op sink (all rows are
produced, nothing is collected to the driver). Each query runs
``$BENCH_REPS`` times after one warm-up; the median is reported.

* ``case_build``: the four survey tables → flags, counts, need summaries →
  score → distributed numbering → checkpoint (what a nightly job writes).
* ``case_flags`` / ``need_type``: end-to-end from the raw tables, no cache.
* ``family_numbering``: numbers the stored, scored rows.
* the remaining queries read the materialised case table, as the reports do.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from caseload.operators import planning  # noqa: E402
from caseload.operators.scoring import number_cases  # noqa: E402
from caseload.plans import catalog, context  # noqa: E402
from caseload.session import local_session, materialize  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn, reps: int) -> float:
    fn()  # warm-up
    times = []
    for _ in range(reps):
        t0 = time.perf_counter()
        fn()
        times.append(time.perf_counter() - t0)
    return statistics.median(times)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="caseload-bench")

    def case_build():
        context.clear()
        run(context.cases(spark, sf_dir))

    q = catalog.QUERIES
    results = {
        "case_build": timed(case_build, reps),
        "case_flags": timed(lambda: run(q["case_flags"](spark, sf_dir)), reps),
        "need_type": timed(lambda: run(q["need_type"](spark, sf_dir)), reps),
    }
    cases = context.cases(spark, sf_dir)
    run(cases)
    scored = materialize(context.built_cases(spark, sf_dir))

    def needs_report():
        run(planning.needs_report_table(cases))  # the whole report: one scan, one job

    for name, fn in (
        ("family_numbering", lambda: run(number_cases(scored))),
        ("priority_list", lambda: run(q["priority_list"](spark, sf_dir))),
        ("top_critical", lambda: run(q["top_critical"](spark, sf_dir))),
        ("aggregate_needs", lambda: run(q["aggregate_needs"](spark, sf_dir))),
        ("needs_report", needs_report),
        ("family_costs", lambda: run(q["family_costs"](spark, sf_dir))),
        ("overview_headline", lambda: run(q["overview_headline"](spark, sf_dir))),
        ("search_widow_gt4", lambda: run(q["search_widow_gt4"](spark, sf_dir))),
        ("intake_append", lambda: run(q["intake_append"](spark, sf_dir))),
    ):
        results[name] = timed(fn, reps)

    rows = cases.count()
    out = {
        "metric": "headline_queries_total",
        "value": round(sum(results.values()), 3),
        "unit": "sec",
        "queries": {k: round(v, 3) for k, v in results.items()},
        "sf": sf,
        "families": rows,
        "cpus": cpus,
        "reps": reps,
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
