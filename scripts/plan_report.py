"""Physical-plan summary of every registered query (after AQE ran once).

Usage: python scripts/plan_report.py [sf_dir] > PLANS.md
Per query: shuffles by kind, join strategies, Python evaluations, sort
aggregates, partial window limits, and the filters pushed into scans.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sitegrove.plans.all import REGISTRY  # noqa: E402
from sitegrove.session import build_session  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session()
    print(f"# Physical plans ({sf_dir})\n\nCounts from the plan that ran (adaptive execution's final plan, reused stages counted\n"
          "once), first with the library's broadcast threshold, then without broadcasts, as on tables too large for them.")
    for threshold in (spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        report(spark, sf_dir, threshold)


def report(spark, sf_dir, threshold):
    print(f"\n## Broadcast threshold {threshold}\n")
    print("| query | ops | hash shuffles | round-robin | range | BHJ | SMJ | python | sort-agg | group-limit | pushed filters |")
    print("|---|---|---|---|---|---|---|---|---|---|---|")
    for name, q in sorted(REGISTRY.items()):
        df = q.build(spark, sf_dir)
        df.toArrow()  # runs this frame's own plan
        plan = df._jdf.queryExecution().executedPlan().toString()
        plan = plan.split("== Initial Plan ==")[0]
        pushed = sorted({m for m in re.findall(r"PushedFilters: \[([^\]]*)\]", plan) if m})
        pushed = "; ".join(p[:60] for p in pushed)[:160]
        print(f"| {name} | {q.ops} | {len(re.findall(r'Exchange hashpartitioning', plan))} | "
              f"{len(re.findall(r'RoundRobinPartitioning', plan))} | {len(re.findall(r'rangepartitioning', plan))} | "
              f"{plan.count('BroadcastHashJoin')} | {plan.count('SortMergeJoin')} | "
              f"{plan.count('ArrowEvalPython') + plan.count('FlatMapGroupsInPandas')} | {plan.count('SortAggregate')} | "
              f"{plan.count('WindowGroupLimit')} | {pushed} |")


if __name__ == "__main__":
    main()
