"""The query builder and its lowering to one DataFrame, which Catalyst plans.

Tables come from a source: `source.table(name)` gives a DataFrame, `source.primary_key(name)` its
key columns (may be empty), `source.policy(name, caller)` a predicate or None.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions import expr as E
from cairn.functions.types import literal_fits, logical
from cairn.plans.errors import ColumnNotFound, InvalidQuery, TypeMismatch

MAX_KEYS = 32
JOIN_TYPES = ("inner", "left", "right", "cross")


@dataclass(frozen=True)
class JoinOn:
    """Comparison of two columns; combine with and_/or_/not_."""

    op: str
    left: str
    right: str


@dataclass(frozen=True)
class JoinLogic:
    kind: str
    parts: tuple


def on(left: str, right: str, op: str = "=") -> JoinOn:
    return JoinOn(op, left, right)


def all_of(*parts) -> JoinLogic:
    return JoinLogic("and", parts)


def any_of(*parts) -> JoinLogic:
    return JoinLogic("or", parts)


def not_of(part) -> JoinLogic:
    return JoinLogic("not", (part,))


@dataclass(frozen=True)
class Join:
    kind: str
    table: str
    alias: str
    condition: object = None


@dataclass(frozen=True)
class Aggregate:
    fn: str
    column: str | None = None

    @property
    def name(self) -> str:
        return "count_star" if self.fn == "count" else f"{self.fn}_{self.column}"


def count() -> Aggregate:
    return Aggregate("count")


def sum_(c: str) -> Aggregate:
    return Aggregate("sum", c)


def min_(c: str) -> Aggregate:
    return Aggregate("min", c)


def max_(c: str) -> Aggregate:
    return Aggregate("max", c)


def avg(c: str) -> Aggregate:
    return Aggregate("avg", c)


@dataclass(frozen=True)
class Query:
    columns: tuple[str, ...] = ("*",)
    table: str = ""
    name: str | None = None
    joins: tuple[Join, ...] = ()
    where: E.Expr | None = None
    order: tuple[tuple[str, bool], ...] = ()  # (column, ascending)
    take: int | None = None
    skip: int | None = None
    groups: tuple[str, ...] = ()
    aggregates: tuple[Aggregate, ...] = ()
    having_: E.Expr | None = None
    index: str | None = None
    unique: bool = False
    computed: tuple[tuple[str, E.Scalar], ...] = field(default=())

    @staticmethod
    def select(*columns: str) -> Query:
        return Query(columns=columns or ("*",))

    def from_(self, table: str) -> Query:
        return replace(self, table=table)

    def alias(self, name: str) -> Query:
        return replace(self, name=name)

    def _join(self, kind: str, table: str, condition, alias: str | None) -> Query:
        return replace(self, joins=(*self.joins, Join(kind, table, alias or table, condition)))

    def inner_join(self, table: str, left: str, right: str, alias: str | None = None) -> Query:
        return self._join("inner", table, JoinOn("=", left, right), alias)

    def left_join(self, table: str, left: str, right: str, alias: str | None = None) -> Query:
        return self._join("left", table, JoinOn("=", left, right), alias)

    def right_join(self, table: str, left: str, right: str, alias: str | None = None) -> Query:
        return self._join("right", table, JoinOn("=", left, right), alias)

    def cross_join(self, table: str, alias: str | None = None) -> Query:
        return self._join("cross", table, None, alias)

    def inner_join_on(self, table: str, condition, alias: str | None = None) -> Query:
        return self._join("inner", table, condition, alias)

    def left_join_on(self, table: str, condition, alias: str | None = None) -> Query:
        return self._join("left", table, condition, alias)

    def right_join_on(self, table: str, condition, alias: str | None = None) -> Query:
        return self._join("right", table, condition, alias)

    def with_last_join_alias(self, alias: str) -> Query:
        if not self.joins:
            raise InvalidQuery("no join to name")
        return replace(self, joins=(*self.joins[:-1], replace(self.joins[-1], alias=alias)))

    def where_(self, predicate: E.Expr) -> Query:
        return replace(self, where=predicate if self.where is None else E.And(self.where, predicate))

    def order_by(self, column: str, ascending: bool = True) -> Query:
        return replace(self, order=(*self.order, (column, ascending)))

    def limit(self, n: int) -> Query:
        return replace(self, take=n)

    def offset(self, n: int) -> Query:
        return replace(self, skip=n)

    def group_by(self, *columns: str) -> Query:
        return replace(self, groups=(*self.groups, *columns))

    def aggregate(self, *aggregates: Aggregate) -> Query:
        return replace(self, aggregates=(*self.aggregates, *aggregates))

    def having(self, predicate: E.Expr) -> Query:
        return replace(self, having_=predicate)

    def use_index(self, name: str) -> Query:
        return replace(self, index=name)

    def distinct(self) -> Query:
        return replace(self, unique=True)

    def compute(self, alias: str, value: E.Scalar) -> Query:
        return replace(self, computed=(*self.computed, (alias, value)))


class Scope:
    """Column names of a query's rows. In a join a column is `alias.column`, or bare where only one table has it."""

    def __init__(self, fields: dict[str, T.StructField]):
        self.fields = fields

    def name(self, wanted: str) -> str:
        if wanted in self.fields:
            return wanted
        ends = [f for f in self.fields if f.rpartition(".")[2] == wanted]
        if len(ends) == 1:
            return ends[0]
        raise ColumnNotFound(f"{'ambiguous' if ends else 'no'} column {wanted}")

    def column(self, wanted: str) -> Column:
        return F.col(f"`{self.name(wanted)}`")

    def kind(self, wanted: str) -> str | None:
        return logical(self.fields[self.name(wanted)])


def micros(c: Column, t: T.DataType) -> Column:
    """A timestamp as microseconds, other columns as they are."""
    if isinstance(t, T.TimestampNTZType):
        return F.unix_micros(c.cast("timestamp"))
    return F.unix_micros(c) if isinstance(t, T.TimestampType) else c


def check_predicate(e: E.Expr, scope: Scope) -> None:
    if E.depth(e) > E.MAX_DEPTH:
        raise InvalidQuery(f"predicate deeper than {E.MAX_DEPTH}")

    def leaf(x: E.Expr) -> None:
        if isinstance(x, (E.And, E.Or)):
            leaf(x.left)
            leaf(x.right)
            return
        if isinstance(x, E.Not):
            leaf(x.inner)
            return
        kind = scope.kind(x.column)
        if isinstance(x, E.Compare):
            values = [x.value]
        elif isinstance(x, E.In):
            values = list(x.values)
            if len(values) > E.MAX_IN:
                raise InvalidQuery(f"more than {E.MAX_IN} values")
            if None in values:
                raise InvalidQuery("null in a list never matches")
        elif isinstance(x, E.Between):
            values = [x.low, x.high]
        elif isinstance(x, E.Like):
            if kind not in ("text", "json", None):
                raise TypeMismatch(f"{x.column} is no text")
            if len(x.pattern.encode()) > E.MAX_LIKE:
                raise InvalidQuery("pattern too long")
            values = []
        else:
            values = []
        for v in values:
            if not literal_fits(v, kind):
                raise TypeMismatch(f"{x.column} is {kind}, {v!r} is not")

    leaf(e)


def validate(q: Query) -> None:
    """What can be told without tables."""
    if not q.table:
        raise InvalidQuery("no table")
    for what in (q.groups, q.aggregates, q.order):
        if len(what) > MAX_KEYS:
            raise InvalidQuery(f"more than {MAX_KEYS}")
    if q.skip is not None and q.take is None:
        raise InvalidQuery("offset needs a limit")
    if (q.take or 0) < 0 or (q.skip or 0) < 0:
        raise InvalidQuery("negative limit or offset")
    if q.groups and not q.aggregates:
        raise InvalidQuery("group by without aggregates; use distinct")
    if q.having_ is not None and not q.aggregates:
        raise InvalidQuery("having without aggregates")
    if q.computed and q.aggregates:
        raise InvalidQuery("computed columns cannot be combined with aggregates")
    aliases = [q.name or q.table, *(j.alias for j in q.joins)]
    if len(set(aliases)) != len(aliases):
        raise InvalidQuery("the same alias twice")


def _condition(c, left: Scope, right: Scope, positive: bool = True) -> Column:
    if isinstance(c, JoinLogic):
        if c.kind == "not":
            return ~_condition(c.parts[0], left, right, not positive)
        parts = [_condition(p, left, right, positive) for p in c.parts]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if c.kind == "and" else out | p
        return out

    both = Scope({**left.fields, **right.fields})
    sides = []
    for wanted in (c.left, c.right):
        f = both.fields[both.name(wanted)]
        sides.append((micros(both.column(wanted), f.dataType), f, logical(f)))
    (a, fa, ka), (b, fb, kb) = sides
    numeric = {"u8", "u64", "integer", "timestamp", "float"}
    if ka != kb and not {ka, kb} <= numeric and not {ka, kb} <= {"text", "json"}:
        raise TypeMismatch(f"{c.left} is {ka}, {c.right} is {kb}")
    if ka != kb and "float" in (ka, kb):
        a, b = a.cast("double"), b.cast("double")
    out = E.OPS[c.op](a, b)
    for side, f in ((a, fa), (b, fb)):
        if c.op == "=" and isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out = out & ~F.isnan(side)  # a key that is not a number joins nothing
    return out if positive else F.coalesce(out, F.lit(False))


def _rows(q: Query, source, caller: str | None) -> tuple[DataFrame, Scope]:
    """The joined, filtered rows."""
    base = source.table(q.table, q.index) if q.index else source.table(q.table)
    policies = []

    def policy(table: str, alias: str) -> None:
        p = source.policy(table, caller)
        if p is not None:
            policies.append(E.qualify(p, alias) if q.joins else p)

    if not q.joins:
        scope = Scope({f.name: f for f in base.schema.fields})
        policy(q.table, q.name or q.table)
        df = base
    else:
        def under(df: DataFrame, alias: str) -> DataFrame:
            return df.select(*(F.col(f"`{f.name}`").alias(f"{alias}.{f.name}", metadata=f.metadata) for f in df.schema.fields))

        df = under(base, q.name or q.table)
        policy(q.table, q.name or q.table)
        scope = Scope({f.name: f for f in df.schema.fields})
        for j in q.joins:
            other = under(source.table(j.table), j.alias)
            new = Scope({f.name: f for f in other.schema.fields})
            policy(j.table, j.alias)
            df = df.crossJoin(other) if j.kind == "cross" else df.join(other, _condition(j.condition, scope, new), j.kind)
            scope = Scope({f.name: f for f in df.schema.fields})
    predicate = q.where
    for p in policies:
        predicate = p if predicate is None else E.And(predicate, p)
    if predicate is not None:
        check_predicate(predicate, scope)
        df = df.where(E.compile_predicate(predicate, lambda n: _comparable(scope, n)))
    return df, scope


def _comparable(scope: Scope, name: str) -> Column:
    """Timestamps stay as they are, so that filters reach the scan; integer literals for them are not mixed in by callers of Parquet tables."""
    return scope.column(name)


def saturating_sum(c: Column) -> Column:
    """Sum of 64-bit integers, held to their range; 0 of nothing. Three limbs are summed as longs, so no row meets a wide decimal."""
    low, mid = (F.sum(F.shiftright(c, n).bitwiseAND(F.lit((1 << 24) - 1).cast("long"))) for n in (0, 24))
    wide = lambda x, n: x.cast("decimal(38,0)") * F.lit(1 << n).cast("decimal(16,0)")
    total = wide(F.sum(F.shiftright(c, 48)), 48) + wide(mid, 24) + low.cast("decimal(38,0)")
    bound = lambda v: F.lit(v).cast("decimal(38,0)")
    return F.least(F.greatest(F.coalesce(total.cast("decimal(38,0)"), bound(0)), bound(-(1 << 63))), bound((1 << 63) - 1)).cast("long")


def aggregate_column(a: Aggregate, scope: Scope) -> Column:
    if a.fn == "count":
        return F.count(F.lit(1)).alias(a.name)
    c, kind = scope.column(a.column), scope.kind(a.column)
    if a.fn in ("sum", "avg"):
        if kind not in ("u8", "u64", "integer", "float"):
            raise TypeMismatch(f"{a.fn} of {a.column}, which is {kind}")
        if a.fn == "avg":
            return F.avg(c.cast("double")).alias(a.name)
        if kind == "integer" and isinstance(scope.fields[scope.name(a.column)].dataType, T.LongType):
            return saturating_sum(c).alias(a.name)
        return F.coalesce(F.sum(c if kind == "float" else c.cast("long") if kind != "u64" else c), F.lit(0)).alias(a.name)
    return (F.min(c) if a.fn == "min" else F.max(c)).alias(a.name)


def sort_key(c: Column, ascending: bool) -> Column:
    """Nulls are smallest."""
    return c.asc_nulls_first() if ascending else c.desc_nulls_last()


def lower(q: Query, source, caller: str | None = None) -> DataFrame:
    """The whole result, without page limits."""
    validate(q)
    df, scope = _rows(q, source, caller)
    if q.aggregates:
        keys = [scope.column(g).alias(scope.name(g)) for g in q.groups]
        aggs = [aggregate_column(a, scope) for a in q.aggregates]
        if keys:
            df = df.groupBy(*keys).agg(*aggs)
        else:  # no rows, no row
            df = df.agg(F.count(F.lit(1)).alias("__n"), *aggs).where(F.col("__n") > 0).drop("__n")
        scope = Scope({f.name: f for f in df.schema.fields})
        if q.having_ is not None:
            check_predicate(q.having_, scope)
            df = df.where(E.compile_predicate(q.having_, scope.column))
        return _paged(df, q, scope)
    picked = list(scope.fields) if q.columns in (("*",), ()) else [scope.name(c) for c in q.columns]
    out = [F.col(f"`{n}`") for n in picked] + [E.compile_scalar(v, lambda n: micros(scope.column(n), scope.fields[scope.name(n)].dataType)).alias(a) for a, v in q.computed]
    extra = [scope.name(c) for c, _ in q.order if scope.name(c) not in picked]
    if not q.unique:
        wide = df.select(*out, *(F.col(f"`{n}`").alias(f"__order.{n}") for n in extra))
        names = wide.columns[: len(out)]
        order = Scope({**{f.name: f for f in wide.schema.fields}, **{n: wide.schema[f"__order.{n}"] for n in extra}})
        return _paged(wide, q, order, {n: f"__order.{n}" for n in extra}).select(*(F.col(f"`{n}`") for n in names))
    # The first of equal rows stands for them: an order by another column is by its least (or greatest) value.
    rows = df.select(*out, *(F.col(f"`{n}`").alias(f"__order.{n}") for n in extra))
    names = rows.columns[: len(out)]
    if extra:
        up = {scope.name(c): a for c, a in q.order}
        rows = rows.groupBy(*(F.col(f"`{n}`") for n in names)).agg(*((F.min if up[n] else F.max)(F.col(f"`__order.{n}`")).alias(f"__order.{n}") for n in extra))
    else:
        rows = rows.distinct()
    order = Scope({f.name: f for f in rows.schema.fields})
    return _paged(rows, q, order, {n: f"__order.{n}" for n in extra}).select(*(F.col(f"`{n}`") for n in names))


def _paged(df: DataFrame, q: Query, scope: Scope, renamed: dict[str, str] | None = None) -> DataFrame:
    renamed = renamed or {}
    if q.order:
        df = df.orderBy(*(sort_key(F.col(f"`{renamed.get(scope.name(c), scope.name(c))}`"), a) for c, a in q.order))
    if q.skip:
        df = df.offset(q.skip)
    return df if q.take is None else df.limit(q.take)
