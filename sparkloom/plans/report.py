"""What a DataFrame's physical plan is made of, and why."""

from __future__ import annotations

import re
from collections import Counter
import time
from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

#: Nodes that only pass rows on.
PLUMBING = ("WholeStageCodegen", "InputAdapter", "AdaptiveSparkPlan", "ShuffleQueryStage", "BroadcastQueryStage", "TableCacheQueryStage", "ResultQueryStage", "AQEShuffleRead", "ColumnarToRow", "RowToColumnar", "ReusedExchange", "Subquery", "ReusedSubquery")
SLOW = {"BatchEvalPython": "row-at-a-time Python", "CartesianProduct": "all pairs", "BroadcastNestedLoopJoin": "no equality to join on", "ObjectHashAggregate": "object buffers, not generated code", "SortAggregate": "buffers that hash aggregation can't hold", "ArrowEvalPython": "Python, in Arrow batches", "MapInArrow": "Python, in Arrow batches", "FlatMapGroupsInArrow": "Python, in Arrow batches", "FlatMapCoGroupsInArrow": "Python, in Arrow batches"}


@dataclass
class Node:
    name: str
    text: str
    children: list[Node] = field(default_factory=list)
    metrics: dict[str, int] = field(default_factory=dict)

    def walk(self):
        yield self
        for c in self.children:
            yield from c.walk()


def _node(plan) -> Node:
    name = plan.nodeName()
    kids = plan.children()
    children = [kids.apply(k) for k in range(kids.size())]
    if name.startswith("AdaptiveSparkPlan"):
        children = [plan.executedPlan()]
    elif name in ("ShuffleQueryStage", "BroadcastQueryStage", "TableCacheQueryStage", "ResultQueryStage"):
        children = [plan.plan()]
    return Node(re.sub(r" \(\d+\)$", "", name).strip(), plan.simpleString(200), [_node(c) for c in children], _metrics(plan))


def _metrics(plan) -> dict[str, int]:
    found, each = {}, plan.metrics().iterator()
    while each.hasNext():
        pair = each.next()
        found[pair._1()] = pair._2().value()
    return found


def tree(df: DataFrame) -> Node:
    """The physical plan; after an action, the final one of adaptive execution."""
    return _node(df._jdf.queryExecution().executedPlan())


def metrics(df: DataFrame) -> list[tuple[str, dict[str, int]]]:
    """(operator, its metrics) in the order of tree(): rows, time, bytes, spills; after an action on df itself."""
    return [(n.name, {k: v for k, v in n.metrics.items() if v > 0}) for n in tree(df).walk() if any(v > 0 for v in n.metrics.values())]


class History:
    """The last executions that ran through it: what they were made of, and what they took."""

    def __init__(self, most: int = 100):
        self.entries: deque[dict] = deque(maxlen=most)

    def run(self, name: str, df: DataFrame, action=None):
        """action(df) (collect(), if not given), recorded; a failure is recorded, too, and raised."""
        start, entry = time.perf_counter(), {"name": name, "error": None}
        try:
            return (action or DataFrame.collect)(df)
        except Exception as e:
            entry["error"] = f"{type(e).__name__}: {e}"[:300]
            raise
        finally:
            entry |= {"seconds": time.perf_counter() - start, "operators": dict(operators(df)), **summary(df)}
            entry |= {k: sum(m.get(k, 0) for _, m in metrics(df)) for k in ("spillSize", "shuffleBytesWritten", "dataSize")}
            self.entries.append(entry)

    def slowest(self, n: int = 10) -> list[dict]:
        return sorted(self.entries, key=lambda e: -e["seconds"])[:n]


def operators(df: DataFrame) -> Counter:
    return Counter(re.split(r" |\(", n.name)[0] for n in tree(df).walk() if not n.name.startswith(PLUMBING))


def reasons(df: DataFrame) -> list[tuple[str, str]]:
    """(operator, why it is slow) for the operators that leave generated code or read all pairs."""
    return [(n.name, why) for n in tree(df).walk() for k, why in SLOW.items() if n.name.startswith(k)]


def summary(df: DataFrame) -> dict:
    ops = operators(df)
    slow = sum(v for k, v in ops.items() if k in SLOW)
    total = sum(ops.values())
    return {"operators": total, "native_fraction": 1 - slow / total if total else 1.0, "exchanges": ops["Exchange"], "broadcasts": ops["BroadcastExchange"], "reasons": reasons(df)}


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[([^\]]*)\]", df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))


def read_schemas(df: DataFrame) -> list[str]:
    return re.findall(r"ReadSchema: (.*)", df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))


def dot(df: DataFrame) -> str:
    """The plan in Graphviz's language."""
    lines, number = ["digraph plan {"], iter(range(10**6))

    def add(n: Node) -> int:
        me = next(number)
        lines.append(f'  n{me} [label="{n.name}"];')
        for c in n.children:
            lines.append(f"  n{add(c)} -> n{me};")
        return me

    add(tree(df))
    return "\n".join([*lines, "}"])
