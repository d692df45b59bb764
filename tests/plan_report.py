"""Write PLANS.md: physical-plan facts for representative queries.

    python tests/plan_report.py [sf_dir]

For each query: the parquet scans (columns read, pushed filters), the
number of exchanges, the join strategies and any Python nodes, taken from
the executed plan (AQE final plan after one run).
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from bench import HEADLINE  # noqa: E402

# streams and model fitting return tables that were written before: their last plan is a bare scan
NAMES = [n for n in HEADLINE if n not in ("rf_train_eval", "problem_windows", "incident_stream")] + ["merge_cap"]


def facts(df) -> dict:
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan (\w+) \[([^\]]*)\].*?PushedFilters: \[([^\]]*)\]", plan)
    return {
        "scans": [(fmt, re.sub(r"#\d+L?", "", cols), re.sub(r"#\d+L?", "", pushed)) for fmt, cols, pushed in scans],
        "exchanges": plan.count("Exchange "),
        "broadcast_joins": plan.count("BroadcastHashJoin"),
        "sort_merge_joins": plan.count("SortMergeJoin"),
        "python": sorted(set(re.findall(r"(MapInPandas|FlatMapGroupsInPandas|ArrowEvalPython|BatchEvalPython)",
                                        plan))),
    }


def main(argv):
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    from driftline.session import get_spark
    import __spark_entry__ as E
    spark = get_spark("local[8]", shuffle_partitions=16)
    q = E.queries()
    out = ["# Physical plans (executed, AQE final)", "",
           f"Generated by `tests/plan_report.py` on `{sf}`. Column lists are what each parquet scan reads.",
           "Queries that cut lineage (`checkpoint()`) show the plan after the cut: their one input scan ran",
           "in the eager checkpoint job, and the final plan reads the written table.", ""]
    for name in NAMES:
        f = facts(q[name](spark, sf))
        out += [f"## `{name}`", "",
                f"exchanges: {f['exchanges']} · broadcast hash joins: {f['broadcast_joins']} · "
                f"sort-merge joins: {f['sort_merge_joins']} · python: {', '.join(f['python']) or 'none'}", ""]
        for fmt, cols, pushed in f["scans"]:
            out.append(f"- scan {fmt} [{cols}] pushed: [{pushed}]")
        out.append("")
    with open(os.path.join(ROOT, "PLANS.md"), "w") as fh:
        fh.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
