"""What a query read, and whether later commits may have changed it. Never misses a change; may report one too many."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.plans.paging import pinned
from cairn.plans.query import Query, lower


@dataclass(frozen=True)
class Read:
    table: str
    seq: int
    key: tuple[tuple[str, object], ...] = ()  # leading key columns pinned to values; empty: the whole table


@dataclass
class ReadSet:
    reads: list[Read] = field(default_factory=list)

    def intersects(self, writes: list[tuple[str, dict]]) -> bool:
        """Whether any of the written (table, key columns and values) may be what was read; a key column that a write does not name may hold anything."""
        return any(r.table == table and all(c not in key or key[c] == v for c, v in r.key) for r in self.reads for table, key in writes)

    def changed(self, engine, until: int | None = None) -> bool:
        """Whether a commit after the reads touched a key they cover."""
        until = engine.refresh() if until is None else until
        for r in self.reads:
            log = engine.deltas(r.table, r.seq, until)
            for c, v in r.key:
                log = log.where(F.col(c) == F.lit(v))
            if not log.isEmpty():
                return True
        return False


def query_capturing(q: Query, view) -> tuple[DataFrame, ReadSet]:
    """The rows of a query over a snapshot, and what it read."""
    df = lower(q, view, view.caller)
    key = view.primary_key(q.table)
    held = pinned(q.where) if not q.joins else {}
    prefix = []
    for k in key:
        if k not in held:
            break
        prefix.append((k, held[k]))
    first = Read(view.name(q.table), view.seq, tuple(prefix))
    return df, ReadSet([first, *(Read(view.name(j.table), view.seq) for j in q.joins)])
