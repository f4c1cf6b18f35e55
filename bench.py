"""Headline-query benchmark.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Runs each headline query to completion through the ``noop`` sink (all work
done, nothing collected), once to warm up and then timed, and prints one JSON
line.  ``shuffle_mb`` is what the timed run wrote to shuffles, from Spark's event log.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from equiflow.plans import registry  # noqa: E402
from equiflow.session import build_session  # noqa: E402

HEADLINE = ["technical_indicators", "fundamental_ratios", "dcf_summary", "consistent_top3",
            "macd", "rsi", "wacc", "dcf_yearly", "vote_share", "parse_pipe_table"]


def shuffle_mb(folder: str) -> dict[str, float]:
    """MB written to shuffles by job group, from the event log in ``folder``."""
    group: dict[int, str] = {}
    out: dict[str, float] = {}
    for base, _, files in os.walk(folder):
        for f in files:
            for line in open(os.path.join(base, f), errors="replace"):
                if not line.startswith("{"):
                    continue
                e = json.loads(line)
                if e["Event"] == "SparkListenerJobStart":
                    group.update({k: (e.get("Properties") or {}).get("spark.jobGroup.id", "") for k in e["Stage IDs"]})
                elif e["Event"] == "SparkListenerTaskEnd" and (name := group.get(e["Stage ID"])):
                    wrote = (e.get("Task Metrics") or {}).get("Shuffle Write Metrics", {}).get("Shuffle Bytes Written", 0)
                    out[name] = out.get(name, 0) + wrote / 1e6
    return {k: round(v, 1) for k, v in out.items()}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    events = tempfile.mkdtemp(prefix="equiflow-bench-")
    spark = build_session(cpus=cpus, shuffle_partitions=max(int(cpus) * 2, 8), app="equiflow-bench", config={
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{events}", "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false"})
    qs = registry.queries()
    times: dict[str, float] = {}
    for name in HEADLINE:
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        spark.sparkContext.setJobGroup(name, name)
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    spark.stop()  # closes the event log
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": int(cpus),
        "shuffle_mb": shuffle_mb(events),
    }))


if __name__ == "__main__":
    main()
