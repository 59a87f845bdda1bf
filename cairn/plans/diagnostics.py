"""What a query will do: access path from its predicate, and facts of Spark's plan."""

from __future__ import annotations

import re
from dataclasses import dataclass

from cairn.plans.paging import pinned
from cairn.plans.query import Query, lower


@dataclass(frozen=True)
class Diagnostics:
    access_path: str
    stages: list[str]
    pushed_filters: list[str]
    columns_read: list[str]
    joins: list[str]
    exchanges: int
    plan: str


def access_path(q: Query, key: list[str]) -> str:
    if q.joins:
        return "join"
    if q.index:
        return "async_index"
    held = pinned(q.where)
    if key and set(key) == set(held) and not (q.aggregates or q.order or q.skip):
        return "primary_key_lookup"
    if key and key[0] in held:
        return "primary_key_prefix"
    return "filtered_scan" if q.where is not None else "full_scan"


def stages(q: Query) -> list[str]:
    out = ["scan", *(["join"] * len(q.joins))]
    for name, there in (("filter", q.where is not None), ("aggregate", q.aggregates), ("having", q.having_ is not None), ("project", q.columns != ("*",) or q.computed), ("distinct", q.unique), ("sort", q.order), ("limit", q.take is not None)):
        if there:
            out.append(name)
    return out


def explain(q: Query, source, caller: str | None = None) -> Diagnostics:
    df = lower(q, source, caller)
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = [x for m in re.findall(r"PushedFilters: \[(.*?)\]", plan) for x in re.split(r", (?=[A-Z])", m) if x]
    read = sorted({c.split(":")[0] for m in re.findall(r"ReadSchema: struct<(.*?)>", plan) for c in m.split(",") if c})
    joins = re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct)", plan)
    return Diagnostics(access_path(q, list(source.primary_key(q.table))), stages(q), pushed, read, joins, len(re.findall(r"Exchange (?:hash|range|Single|round)", plan)), plan)
