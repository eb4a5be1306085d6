"""Summarise the physical plan of every registered query into PLANS.md.

Usage: python tools/plan_report.py [sf_dir] > PLANS.md

Counts shuffles, broadcasts, join strategies, aggregate and window operators, and lists
the filters pushed into each scan. Plans are taken before execution (AQE may still
coalesce partitions, demote a shuffle join to a broadcast or split skewed partitions).
"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from spendlens.plans.catalog import QUERIES  # noqa: E402
from spendlens.session import get_session  # noqa: E402

OPERATORS = [
    "Exchange hashpartitioning", "Exchange rangepartitioning", "Exchange SinglePartition", "BroadcastExchange",
    "BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct",
    "HashAggregate", "SortAggregate", "ObjectHashAggregate", "Window", "WindowGroupLimit", "TakeOrderedAndProject",
    "Expand", "Generate", "Union",
]


def summarise(plan: str) -> tuple[Counter, list[str], list[str]]:
    counts = Counter()
    for line in plan.splitlines():
        body = line.strip().lstrip(":+- ")
        for op in OPERATORS:
            if body.startswith(op + " ") or body.startswith(op + "(") or body == op:
                counts[op] += 1
        for jt in ("LeftSemi", "LeftAnti", "LeftOuter", "FullOuter", "Inner"):
            if ("Join" in body.split(" ")[0]) and re.search(rf", {jt}(,|$)", body):
                counts[f"join:{jt}"] += 1
    pushed = sorted(set(re.findall(r"PushedFilters: \[([^\]]+)\]", plan)))
    parts = sorted(set(re.findall(r"PartitionFilters: \[([^\]]+)\]", plan)))
    return counts, pushed, parts


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session()
    print("# Physical plans of the registered queries\n")
    print(f"Generated by `tools/plan_report.py` on `{sf_dir}` (local mode; the plan shape, not the sizes, is the point:")
    print("broadcasts of data-dependent sides here are Spark's size-threshold choices and become shuffles at scale).\n")
    print("| Query | Shuffles | Broadcasts | Joins | Aggregates | Windows / top-k | Other |")
    print("|---|---|---|---|---|---|---|")
    details = []
    for name, q in QUERIES.items():
        # append_history and incremental_ingest write before returning: their plan is the read-back scan.
        df = q(spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        c, pushed, parts = summarise(plan)
        shuffles = c["Exchange hashpartitioning"] + c["Exchange rangepartitioning"] + c["Exchange SinglePartition"]
        joins = ", ".join(f"{k}×{c[k]}" for k in ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin",
                                                  "BroadcastNestedLoopJoin", "CartesianProduct") if c[k])
        kinds = ", ".join(f"{k[5:]}×{v}" for k, v in sorted(c.items()) if k.startswith("join:"))
        aggs = ", ".join(f"{k}×{c[k]}" for k in ("HashAggregate", "SortAggregate", "ObjectHashAggregate") if c[k])
        wins = ", ".join(f"{k}×{c[k]}" for k in ("Window", "WindowGroupLimit", "TakeOrderedAndProject") if c[k])
        other = ", ".join(f"{k}×{c[k]}" for k in ("Expand", "Generate", "Union") if c[k])
        print(f"| `{name}` | {shuffles} | {c['BroadcastExchange']} | {joins}{' (' + kinds + ')' if kinds else ''} "
              f"| {aggs} | {wins} | {other} |")
        if pushed or parts:
            details.append((name, pushed, parts))
    print("\n## Filters pushed into scans\n")
    for name, pushed, parts in details:
        print(f"- `{name}`: " + "; ".join(
            ([f"pushed `{p}`" for p in pushed[:3]] + [f"partition `{p}`" for p in parts[:2]])))


if __name__ == "__main__":
    main()
