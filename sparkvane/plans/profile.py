"""Plans and per-operation figures of finished queries."""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plan_text(df: DataFrame) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def operations(df: DataFrame) -> dict[str, int]:
    """How often each physical operation stands in the plan."""
    counts: dict[str, int] = {}
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        m = re.match(r"[\s:+\-*()\d]*([A-Z]\w+)", line)
        if m:
            counts[m[1]] = counts.get(m[1], 0) + 1
    return counts


def _nodes(plan):
    """The plan's nodes as they ran, through adaptive wrappers."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        yield from _nodes(plan.executedPlan())
    elif name.endswith("QueryStage"):
        yield from _nodes(plan.plan())
    else:
        yield plan
        children = plan.children()
        for i in range(children.size()):
            yield from _nodes(children.apply(i))


#: What a metric of a node counts: its kind, its name and what one unit is of the figure's.
_FIGURES = {"timing": ("ms", 1.0), "nsTiming": ("ms", 1e-6), "size": ("bytes", 1)}


def measured(df: DataFrame) -> dict[str, dict[str, float]]:
    """Of each physical operation of a frame that has run: how often, milliseconds, rows out and bytes.

    Milliseconds are summed over tasks.  Operations that are compiled into one
    stage have no times of their own; WholeStageCodegen has the stage's.
    """
    out: dict[str, dict[str, float]] = {}
    for node in _nodes(df._jdf.queryExecution().executedPlan()):
        name = re.match(r"\w+", node.nodeName())[0]
        own = out.setdefault(name, {"commands": 0, "ms": 0.0, "rows": 0, "bytes": 0})
        own["commands"] += 1
        found = node.metrics().iterator()
        while found.hasNext():
            pair = found.next()
            metric, kind = pair._2(), pair._2().metricType()
            value = max(0, metric.value())
            if pair._1() in ("numOutputRows", "pythonNumRowsReceived"):
                own["rows"] += value
            elif kind in _FIGURES:
                figure, unit = _FIGURES[kind]
                own[figure] += value * unit
    return out


def observed(df: DataFrame, act: Callable[[DataFrame], object]) -> tuple[object, dict]:
    """act's result, with planning and run times and what each operation of the plan did.  act must run df itself."""
    t = time.perf_counter()
    operations(df)
    planned = time.perf_counter()
    out = act(df)
    run = (time.perf_counter() - planned) * 1000
    return out, {"preparation_ms": (planned - t) * 1000, "run_ms": run, "stages": measured(df), "plan": plan_text(df)}


def stage_counts(df: DataFrame) -> DataFrame:
    """(operation, commands) of df's plan, as rows."""
    return df.sparkSession.createDataFrame(sorted(operations(df).items()), "operation string, commands long")


def overlap(exact: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(qid, overlap): the share of each query's exact top k that found has."""
    hit = exact.where(F.col("rk") <= k).select("qid", "id").join(found.where(F.col("rk") <= k).select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    return hit.groupBy("qid").agg((F.count("hit") / k).alias("overlap"))
