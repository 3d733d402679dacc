"""

* per-query wall seconds (warm session, median of 3) - from bench.py's method;
* the full query set with the shared tables staged vs. recomputed per query;
* shuffle bytes written by q03, q06 (unified billing) and q11 (client reconciliation), read
  from Spark's event log written to a scratch folder (no UI, no REST).

Run: python tools/measure.py [sf_dir]
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from ledgerlens.operators import reconcile as R  # noqa: E402
from ledgerlens.plans import catalog as C  # noqa: E402
from ledgerlens.plans import stage as ST  # noqa: E402
from ledgerlens.session import local_session  # noqa: E402

SF = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"


def run_all(spark) -> dict[str, float]:
    out = {}
    for name, fn in C.QUERIES.items():
        t0 = time.perf_counter()
        fn(spark, SF).write.format("noop").mode("overwrite").save()
        out[name] = time.perf_counter() - t0
    return out


def shuffle_bytes(log_dir: str) -> dict[str, int]:
    """Shuffle bytes written per job group, from the event log."""
    stage_group: dict[int, str] = {}
    written: dict[str, int] = {}
    paths = sorted(p for p in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True)
                   if os.path.isfile(p) and not os.path.basename(p).startswith("appstatus"))
    for path in paths:
        with open(path) as f:
            for line in f:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    group = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    for sid in ev.get("Stage IDs", []):
                        if group:
                            stage_group[sid] = group
                elif kind == "SparkListenerTaskEnd":
                    group = stage_group.get(ev.get("Stage ID"))
                    metrics = ev.get("Task Metrics") or {}
                    b = (metrics.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
                    if group:
                        written[group] = written.get(group, 0) + b
    return written


def main() -> None:
    log_dir = tempfile.mkdtemp(prefix="ledgerlens-eventlog-")
    spark = local_session(8, app="ledgerlens-measure", extra={
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{log_dir}",
        "spark.eventLog.compress": "false"})
    sc = spark.sparkContext
    run_all(spark)  # warm-up
    runs = []
    for _ in range(3):
        ST.forget(spark)
        runs.append(run_all(spark))
    per_query = {n: statistics.median(r[n] for r in runs) for n in C.QUERIES}

    # staged vs recomputed: disable staging by hiding the checkpoint folder from plans.stage
    original = ST.checkpoint_root
    ST.checkpoint_root = lambda _spark: None
    try:
        unstaged = [sum(run_all(spark).values()) for _ in range(2)]
    finally:
        ST.checkpoint_root = original
    ST.forget(spark)
    staged = [sum(run_all(spark).values())]
    ST.forget(spark)
    staged.append(sum(run_all(spark).values()))

    # shuffle bytes of the heavy builders
    for group, build in (("q03", lambda: C.q03_billing_lines(spark, SF)),
                         ("q06", lambda: C.unified_billing(spark, SF)),
                         ("q11", lambda: R.reconcile_client(C.staged_billing(spark, SF),
                                                            C.staged_demand(spark, SF)))):
        df = build()
        sc.setJobGroup(group, group)
        df.write.format("noop").mode("overwrite").save()
    sc.setJobGroup("done", "done")
    spark.stop()
    sb = shuffle_bytes(log_dir)

    lines = ["# Measurements (this repo, local[8])", "",
             f"Data: `{SF}`. Generated by `tools/measure.py`; figures move by +-30% between runs on this VM.", "",
             "## Per-query seconds (warm session, median of 3, noop sink)", "",
             "| query | sec |", "| --- | --- |"]
    lines += [f"| {n} | {v:.3f} |" for n, v in per_query.items()]
    lines += ["", f"Sum: {sum(per_query.values()):.2f} s", "",
              "## Full query set: shared tables staged vs recomputed per query", "",
              "| mode | total sec (2 runs) |", "| --- | --- |",
              f"| staged (q06, q07, client/supplier reconciliation written once) | {staged[0]:.2f}, {staged[1]:.2f} |",
              f"| recomputed in every query | {unstaged[0]:.2f}, {unstaged[1]:.2f} |", "",
              "## Shuffle bytes written", "", "| plan | bytes |", "| --- | --- |"]
    lines += [f"| {g} | {sb.get(g, 0):,} |" for g in ("q03", "q06", "q11")]
    lines += ["", "q03 = all orders with their suppliers and returns; q06 = the unified billing before staging; "
              "q11 = the client reconciliation from the staged inputs."]
    with open(os.path.join(ROOT, "docs", "MEASUREMENTS.md"), "w") as f:
        f.write("\n".join(lines) + "\n")
    print("\n".join(lines))


if __name__ == "__main__":
    main()
