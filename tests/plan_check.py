"""Print the plan traits of registered queries that do not scale: python tests/plan_check.py [prefix ...]."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

BAD = ("CartesianProduct", "BroadcastNestedLoopJoin", "Exchange SinglePartition", "BatchEvalPython")


def traits(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    found = [b for b in BAD if b in plan]
    if any("Window [" in ln and "], [" not in ln and "Window [" in ln and ln.rstrip().endswith("]") and ", [], " in ln for ln in plan.splitlines()):
        found.append("Window without partition")
    return found


def main(argv):
    import __spark_entry__ as entry
    from tracewright.session import get_spark

    spark = get_spark("plan-check", 8)
    for name, fn in entry.queries().items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        df = fn(spark, "/root/testdata/sf0.001")
        found = traits(df)
        if found:
            print(name, found, flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
