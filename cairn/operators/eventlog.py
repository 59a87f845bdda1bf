"""Queries over an append-only event log (commit_seq, ts_micros, topic, event_key, payload, ...)."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("commit_seq", "topic", "event_key")


@dataclass(frozen=True)
class EventQuery:
    topic_: str | None = None
    namespace_: tuple[str | None, str | None] = (None, None)
    after: int | None = None  # exclusive
    before: int | None = None  # exclusive
    time: tuple[int | None, int | None] = (None, None)  # inclusive
    fields: tuple[tuple[str, str], ...] = field(default=())
    descending_: bool = False
    limit_: int = 100

    def topic(self, t: str) -> EventQuery:
        return replace(self, topic_=t)

    def namespace(self, project: str | None, scope: str | None = None) -> EventQuery:
        return replace(self, namespace_=(project, scope))

    def after_commit_seq(self, n: int) -> EventQuery:
        return replace(self, after=n)

    def before_commit_seq(self, n: int) -> EventQuery:
        return replace(self, before=n)

    def time_range(self, start: int | None, end: int | None) -> EventQuery:
        return replace(self, time=(start, end))

    def where_field(self, name: str, value: str) -> EventQuery:
        return replace(self, fields=(*self.fields, (name, value)))

    def descending(self) -> EventQuery:
        return replace(self, descending_=True)

    def limit(self, n: int) -> EventQuery:
        return replace(self, limit_=n)


def payload_field(payload: Column, name: str) -> Column:
    """A top-level field as text; objects, arrays and null give null."""
    quoted = name.replace("'", "\\'")
    text = F.get_json_object(payload, f"$['{quoted}']")
    # A string that itself reads as an object or array counts as one.
    raw = F.json_object_keys(text).isNotNull() | F.json_array_length(text).isNotNull()
    return F.when(~raw, text)


def condition(q: EventQuery, columns: list[str]) -> Column:
    c = F.lit(True)
    if q.topic_ is not None:
        c = c & (F.col("topic") == q.topic_)
    for name, wanted in zip(("project_id", "scope_id"), q.namespace_, strict=True):
        if wanted is not None and name in columns:
            c = c & (F.col(name) == wanted)
    if q.after is not None:
        c = c & (F.col("commit_seq") > q.after)
    if q.before is not None:
        c = c & (F.col("commit_seq") < q.before)
    if q.time[0] is not None:
        c = c & (F.col("ts_micros") >= q.time[0])
    if q.time[1] is not None:
        c = c & (F.col("ts_micros") <= q.time[1])
    for name, wanted in q.fields:
        c = c & (payload_field(F.col("payload"), name) == wanted)
    return c


def filtered(events: DataFrame, q: EventQuery) -> DataFrame:
    return events.where(condition(q, events.columns))


def page(events: DataFrame, q: EventQuery) -> tuple[DataFrame, int | None]:
    """(rows in order, cursor): a page ends at a commit boundary, so it may exceed the limit. The cursor is the last commit
    of the page if any event lies beyond it, else None."""
    hit = filtered(events, q)
    up = not q.descending_
    by = [F.col(c).asc() if up else F.col(c).desc() for c in ORDER]
    if q.limit_ <= 0:
        return hit.limit(0), None
    edge = hit.select("commit_seq").orderBy(by[0]).offset(q.limit_ - 1).limit(1).collect()  # one row
    if not edge:
        return hit.orderBy(*by), None
    b = edge[0][0]
    inside, beyond = (F.col("commit_seq") <= b, F.col("commit_seq") > b) if up else (F.col("commit_seq") >= b, F.col("commit_seq") < b)
    more = not events.where(beyond).isEmpty()
    return hit.where(inside).orderBy(*by), b if more else None


def latest_by_topic(events: DataFrame, topic: str, n: int) -> DataFrame:
    return page(events, EventQuery().topic(topic).descending().limit(n))[0]


def read_stream(events: DataFrame, topic: str | None, after: int, limit: int) -> tuple[DataFrame, int | None]:
    q = EventQuery().after_commit_seq(after).limit(limit)
    return page(events, q.topic(topic) if topic else q)


def inspect_commit(events: DataFrame, seq: int) -> DataFrame:
    return events.where(F.col("commit_seq") == seq).orderBy("topic", "event_key")


def find_by_key(events: DataFrame, key: str) -> DataFrame:
    return events.where(F.col("event_key") == key).orderBy(*ORDER)


def summary(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("n_events"), F.min("commit_seq").alias("oldest_seq"), F.max("commit_seq").alias("newest_seq"))


@dataclass(frozen=True)
class Retention:
    max_age_micros: int | None = None
    keep_last: int | None = None
    processors: bool = False
    most: int | None = None


def prunable(events: DataFrame, policy: Retention, now_micros: int, floor: int | None = None) -> DataFrame:
    """The contiguous oldest events that every set condition lets go; without conditions none."""
    if policy.max_age_micros is None and policy.keep_last is None and not policy.processors:
        return events.limit(0)
    keep = F.lit(False)
    if policy.max_age_micros is not None:
        keep = keep | ~(F.col("ts_micros") < now_micros - policy.max_age_micros)
    if policy.processors:
        keep = keep | (F.lit(True) if floor is None else F.col("commit_seq") > floor)
    out = events
    # The first event that must stay, as one row; what lies before it may go.
    place = F.struct(*ORDER)
    first = events.where(keep).agg(F.min(place).alias("p")).select("p")
    out = out.crossJoin(F.broadcast(first)).where(F.col("p").isNull() | (place < F.col("p"))).drop("p")  # one row
    if policy.keep_last is not None:
        last = events.select(*ORDER).orderBy(*(F.col(c).desc() for c in ORDER)).limit(policy.keep_last).agg(F.min(place).alias("p"))
        if policy.keep_last > 0:
            out = out.crossJoin(F.broadcast(last)).where(place < F.col("p")).drop("p")
    if policy.most is not None:
        out = out.orderBy(*ORDER).limit(policy.most)
    return out


def compact(events: DataFrame, policy: Retention, now_micros: int, floor: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(what stays, what goes)."""
    gone = prunable(events, policy, now_micros, floor)
    return events.join(gone.select(*ORDER), list(ORDER), "left_anti"), gone


def lag(events: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """checkpoints(processor, checkpoint_seq) -> (processor, checkpoint_seq, head_seq, lag)."""
    head = events.agg(F.coalesce(F.max("commit_seq"), F.lit(0)).cast("long").alias("head_seq"))
    return checkpoints.crossJoin(F.broadcast(head)).withColumn("lag", F.greatest(F.col("head_seq") - F.col("checkpoint_seq"), F.lit(0)))  # one row


def backoff(base_ms: int, attempt: int) -> int:
    """Wait before the next try of a processor batch."""
    return base_ms * 2 ** min(max(attempt, 1) - 1, 8)


def health(lag_now: int, max_lag: int, idle_ms: float, max_idle_ms: float) -> str:
    if lag_now > max_lag:
        return "lagging"
    return "stalled" if lag_now and idle_ms > max_idle_ms and not math.isinf(max_idle_ms) else "healthy"


def latest_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    values = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v")).select(key, *(F.col(f"_v.{c}").alias(c) for c in values))


def bounded_series(df: DataFrame, series: str, order: list[str], n: int) -> DataFrame:
    """The last n points of each series; the rank limit is pushed below the shuffle by the window group limit."""
    w = Window.partitionBy(series).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")
