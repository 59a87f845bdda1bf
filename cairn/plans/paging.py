"""Pages: windows, signed keyset cursors, stable order, totals, existence, batches, hydration."""

from __future__ import annotations

import base64
import datetime
import decimal
import hashlib
import hmac
import json
from collections import deque
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from cairn.functions import expr as E
from cairn.plans.errors import InvalidCursor, InvalidQuery, ScanBoundExceeded
from cairn.plans.query import Query, Scope, count, lower, validate

DEFAULT_PAGE, MAX_SCAN_ROWS = 100, 10_000
#: Rows that a run brings to the driver at once, and runs that a snapshot keeps.
AHEAD, RUNS = 10_000, 4


@dataclass(frozen=True)
class Policy:
    """Guard rails of the page API; DataFrames are never truncated."""

    max_scan_rows: int = MAX_SCAN_ROWS
    allow_full_scan: bool = True
    key: bytes | None = None  # signs cursors


@dataclass(frozen=True)
class Page:
    rows: list[Row]
    cursor: str | None
    truncated: bool
    snapshot_seq: int
    materialized_seq: int | None = None
    split_recommended: bool = False
    rows_examined: int = 0


class Run:
    """A snapshot's rows in the order of a query's pages. Pages asked for one after another are cut from one sorted pass, which comes
    to the driver about AHEAD rows at a time; only a page asked for out of turn is a query of its own."""

    def __init__(self, df: DataFrame, order: list[tuple[str, bool]], shown: list[str]):
        self.df, self.order, self.shown = df, order, shown
        self.columns = [(F.col(f"`{c}`"), up) for c, up in order]
        self.sort = [c.asc_nulls_first() if up else c.desc_nulls_last() for c, up in self.columns]
        self.coming, self.held = None, deque()

    def after(self, state: dict | None) -> DataFrame:
        return self.df if state is None else self.df.where(after(self.columns, [_value(v) for v in state["sort"]]))

    def page(self, state: dict | None, skip: int, size: int) -> list[Row]:
        """The rows of one page and one more, if there is one."""
        return self.after(state).orderBy(*self.sort).offset(skip).limit(size + 1).collect() if size else []

    def go_on(self, state: dict, size: int) -> list[Row]:
        """The same for the page that follows the last one."""
        if self.coming is None:
            rest = self.after(state)
            self.coming = rest.repartitionByRange(max(1, -(-rest.count() // AHEAD)), *self.sort).sortWithinPartitions(*self.sort).toLocalIterator()
        while len(self.held) <= size and (row := next(self.coming, None)) is not None:
            self.held.append(row)
        rows = [self.held[i] for i in range(min(size + 1, len(self.held)))]
        for _ in rows[:size]:
            self.held.popleft()
        return rows


def _plain(v):
    if isinstance(v, (bytes, bytearray)):
        return {"b": base64.b64encode(bytes(v)).decode()}
    if isinstance(v, (datetime.datetime, datetime.date)):
        return {"t": v.isoformat()}
    return {"d": str(v)} if isinstance(v, decimal.Decimal) else v


def _value(v):
    if isinstance(v, dict):
        kind, x = next(iter(v.items()))
        return base64.b64decode(x) if kind == "b" else decimal.Decimal(x) if kind == "d" else datetime.datetime.fromisoformat(x)
    return v


def encode_cursor(state: dict, key: bytes | None) -> str:
    body = json.dumps(state, sort_keys=True).encode()
    tag = hmac.new(key, body, hashlib.sha256).digest() if key else b""
    return base64.urlsafe_b64encode(len(tag).to_bytes(1, "big") + tag + body).decode()


def decode_cursor(token: str, key: bytes | None) -> dict:
    try:
        data = base64.urlsafe_b64decode(token.encode())
        tag, body = data[1 : 1 + data[0]], data[1 + data[0] :]
        if key and not hmac.compare_digest(tag, hmac.new(key, body, hashlib.sha256).digest()):
            raise InvalidCursor("cursor signature differs")
        state = json.loads(body)
        if not {"seq", "sort", "page"} <= state.keys():
            raise ValueError
        return state
    except InvalidCursor:
        raise
    except Exception:
        raise InvalidCursor("no cursor") from None


def after(columns: list[tuple[Column, bool]], values: list) -> Column:
    """Rows that follow `values` in the order of the columns; nulls are smallest."""
    out, same = F.lit(False), F.lit(True)
    for (c, up), v in zip(columns, values, strict=True):
        if v is None:
            beyond = c.isNotNull() if up else F.lit(False)
        else:
            beyond = c > F.lit(v) if up else (c < F.lit(v)) | c.isNull()
        out, same = out | (same & beyond), same & c.eqNullSafe(F.lit(v))
    return out


def page_window(q: Query, policy: Policy) -> tuple[int, int]:
    """(rows of a page, rows to skip)."""
    size = min(q.take if q.take is not None else DEFAULT_PAGE, policy.max_scan_rows)
    skip = q.skip or 0
    if skip + size > policy.max_scan_rows and skip:
        raise ScanBoundExceeded(f"offset + page over {policy.max_scan_rows}")
    return size, skip


def join_bound(q: Query, source, most: int) -> None:
    """Refuses a join whose inputs multiply to more than `most` rows; each is counted no further than that."""
    product = 1
    for name in (q.table, *(j.table for j in q.joins)):
        product *= max(1, source.table(name).limit(most + 1).count())
        if product > most:
            raise ScanBoundExceeded(f"the joined tables multiply to over {most} rows")


def execute_page(q: Query, source, caller: str | None = None, cursor: str | None = None, policy: Policy = Policy(), seq: int = 0) -> Page:
    """One page in a total order: that of the query, then the primary key (a join: all columns)."""
    validate(q)
    if cursor and q.skip:
        raise InvalidQuery("offset and cursor exclude each other")
    if cursor and q.unique:
        raise InvalidQuery("distinct and cursor exclude each other")
    if q.take is None and q.where is None and not policy.allow_full_scan:
        raise ScanBoundExceeded("full scan without a limit")
    size, skip = page_window(q, policy)
    plain, ahead, left, state = bool(q.aggregates or q.unique), getattr(source, "ahead", None), q.take, None
    if cursor:
        state = decode_cursor(cursor, policy.key)
        if state["seq"] != seq:
            raise InvalidCursor("cursor of another snapshot")
        size, left = state["page"], state["left"]
    turn = (repr(q), caller, policy)
    run = ahead.pop((cursor, *turn), None) if ahead and cursor else None
    if run is not None:
        rows = run.go_on(state, size)
    else:
        if q.joins and not policy.allow_full_scan:
            join_bound(q, source, policy.max_scan_rows)
        run = _run(q, source, caller, plain)
        rows = run.page(state, skip, size)
    more, rows = len(rows) > size, rows[:size]
    token = None
    if more and rows and not plain:
        left = None if left is None else max(0, left - len(rows))
        token = encode_cursor({"seq": seq, "sort": [_plain(rows[-1][c]) for c, _ in run.order], "page": size, "left": left}, policy.key)
        if ahead is not None:
            ahead[token, *turn] = run
            while len(ahead) > RUNS:
                ahead.pop(next(iter(ahead)))
    out = [Row(*run.shown)(*(r[c] for c in run.shown)) for r in rows]
    seen = len(rows) + skip + more
    return Page(out, token, more, seq, None, seen * 4 >= policy.max_scan_rows * 3, seen)


def _run(q: Query, source, caller: str | None, plain: bool) -> Run:
    whole = replace(q, take=None, skip=None, order=() if not plain else q.order)
    keys = [] if plain else list(source.primary_key(q.table)) if not q.joins else []
    df = lower(whole if plain else replace(whole, columns=("*",)), source, caller)
    scope = Scope({f.name: f for f in df.schema.fields})
    order = [(scope.name(c), up) for c, up in q.order]
    ties = [scope.name(k) for k in keys] or list(df.columns)
    order += [(t, True) for t in ties if t not in [o for o, _ in order]]
    shown = df.columns if q.columns in (("*",), ()) or plain else [scope.name(c) for c in q.columns] + [a for a, _ in q.computed]
    return Run(df, order, shown)


def list_with_total(q: Query, source, caller: str | None = None, **options) -> tuple[Page, int]:
    """A page, and how many rows its predicate and joins have."""
    total = lower(replace(q, columns=("*",), order=(), take=None, skip=None, computed=(), unique=False, aggregates=(count(),), groups=(), having_=None), source, caller).collect()
    return execute_page(q, source, caller, **options), total[0][0] if total else 0


def total_rows(q: Query, source, caller: str | None = None) -> DataFrame:
    return lower(replace(q, columns=("*",), order=(), take=None, skip=None, computed=(), aggregates=(count(),)), source, caller)


def exists(q: Query, source, caller: str | None = None) -> bool:
    return not lower(replace(q, take=1), source, caller).isEmpty()


def batch(queries: list[Query], source, caller: str | None = None) -> list[DataFrame]:
    return [lower(q, source, caller) for q in queries]


def lookup_then_hydrate(keys: Query, key_column: str, rows: Query, row_column: str, source, caller: str | None = None) -> DataFrame:
    """The rows whose column is among the keys that the first query finds: a semi-join, never a list of literals."""
    k = lower(keys, source, caller).select(F.col(f"`{key_column}`").alias("__key")).distinct()
    r = lower(rows, source, caller)
    return r.join(k, F.col(f"`{row_column}`") == F.col("__key"), "left_semi")


def index_rank(df: DataFrame, index: list[str], keys: list[str], key_values: list) -> DataFrame:
    """0-based position of a row in index order, ties by key: one count, no global window."""
    cols = [F.col(c) for c in [*index, *keys]]
    me = df.where(F.lit(True) if not keys else _all([F.col(k) == F.lit(v) for k, v in zip(keys, key_values, strict=True)])).select(*(c.alias(f"__{i}") for i, c in enumerate(cols))).limit(1)
    before, same = F.lit(False), F.lit(True)
    for i, c in enumerate(cols):
        mine = F.col(f"__{i}")
        before = before | (same & ((c < mine) | (c.isNull() & mine.isNotNull())))
        same = same & c.eqNullSafe(mine)
    return df.crossJoin(F.broadcast(me)).where(before).agg(F.count(F.lit(1)).alias("rank"))  # one row against the table


def _all(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def index_window(df: DataFrame, index: list[str], prefix: list, keys: list[str], offset: int, limit: int) -> DataFrame:
    """Rows under an index prefix, in index order."""
    for c, v in zip(index, prefix, strict=False):
        df = df.where(F.col(c).eqNullSafe(F.lit(v)))
    return df.orderBy(*(F.col(c).asc_nulls_first() for c in [*index, *keys])).offset(offset).limit(limit)


def pinned(e: E.Expr | None) -> dict:
    """Columns that a predicate pins to one value in every row it keeps."""
    if isinstance(e, E.Compare) and e.op == "=":
        return {e.column: e.value}
    return {**pinned(e.left), **pinned(e.right)} if isinstance(e, E.And) else {}
