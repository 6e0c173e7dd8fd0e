"""What a plan read from storage: files, bytes and rows of its scans, from the counters that Spark keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Names of our counters and of Spark's.
COUNTERS = {"files": "numFiles", "bytes": "filesSize", "rows": "numOutputRows"}


def counted(df: DataFrame) -> dict[str, int]:
    """Run df, without keeping its rows, and add up the counters of all its file scans; each call counts from zero."""
    plan = df.select("*")._jdf.queryExecution()  # a plan of its own, whose counters nothing has touched
    plan.toRdd().count()
    out = dict.fromkeys(COUNTERS, 0)
    todo, seen = [plan.executedPlan()], set()
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif name == "ReusedExchangeExec":
            continue
        elif name in ("FileSourceScanExec", "BatchScanExec") and node.id() not in seen:
            seen.add(node.id())
            held = node.metrics()
            for ours, sparks in COUNTERS.items():
                out[ours] += held.apply(sparks).value() if held.contains(sparks) else 0
        else:
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
    return out
