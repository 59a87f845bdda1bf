"""Predicates and arithmetic as plain data, and their compilers to Spark columns.

Logic is two-valued: a comparison with a null is false, so its negation is true. Filters keep only
true rows and AND/OR are monotone, so under an even number of negations the raw comparison serves
(and reaches the Parquet scan); under an odd number each leaf is wrapped to false.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.plans.errors import InvalidQuery

MAX_DEPTH, MAX_IN, MAX_LIKE = 32, 10_000, 256


class Expr:
    def and_(self, other: Expr) -> Expr:
        return And(self, other)

    def or_(self, other: Expr) -> Expr:
        return Or(self, other)

    def not_(self) -> Expr:
        return Not(self)

    __and__, __or__ = and_, or_

    def __invert__(self) -> Expr:
        return Not(self)


@dataclass(frozen=True)
class Compare(Expr):
    op: str
    column: str
    value: object


@dataclass(frozen=True)
class In(Expr):
    column: str
    values: tuple


@dataclass(frozen=True)
class Between(Expr):
    column: str
    low: object
    high: object


@dataclass(frozen=True)
class IsNull(Expr):
    column: str
    negated: bool = False


@dataclass(frozen=True)
class Like(Expr):
    column: str
    pattern: str


@dataclass(frozen=True)
class And(Expr):
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Or(Expr):
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Not(Expr):
    inner: Expr


class Scalar:
    def __add__(self, other):
        return Arith("+", self, as_scalar(other))

    def __sub__(self, other):
        return Arith("-", self, as_scalar(other))

    def __mul__(self, other):
        return Arith("*", self, as_scalar(other))

    def __truediv__(self, other):
        return Arith("/", self, as_scalar(other))


@dataclass(frozen=True)
class Lit(Scalar):
    value: object


@dataclass(frozen=True)
class Arith(Scalar):
    op: str
    left: Scalar
    right: Scalar


@dataclass(frozen=True)
class Col(Scalar):
    """A column by name: operand of arithmetic, and start of a predicate."""

    name: str

    def eq(self, v):
        return Compare("=", self.name, v)

    def neq(self, v):
        return Compare("!=", self.name, v)

    def lt(self, v):
        return Compare("<", self.name, v)

    def lte(self, v):
        return Compare("<=", self.name, v)

    def gt(self, v):
        return Compare(">", self.name, v)

    def gte(self, v):
        return Compare(">=", self.name, v)

    def between(self, low, high):
        return Between(self.name, low, high)

    def in_(self, values):
        return In(self.name, tuple(values))

    def like(self, pattern: str):
        return Like(self.name, pattern)

    def is_null(self):
        return IsNull(self.name)

    def is_not_null(self):
        return IsNull(self.name, True)


def col(name: str) -> Col:
    return Col(name)


def lit(value) -> Lit:
    return Lit(value)


def as_scalar(x) -> Scalar:
    return x if isinstance(x, Scalar) else Lit(x)


@dataclass(frozen=True)
class Caller:
    """Stands for the caller's id in a read policy until it is bound."""


CALLER = Caller()


def bind_caller(e: Expr, caller: str) -> Expr:
    if isinstance(e, Compare):
        return Compare(e.op, e.column, caller) if e.value is CALLER else e
    if isinstance(e, In):
        return In(e.column, tuple(caller if v is CALLER else v for v in e.values))
    if isinstance(e, (And, Or)):
        return type(e)(bind_caller(e.left, caller), bind_caller(e.right, caller))
    if isinstance(e, Not):
        return Not(bind_caller(e.inner, caller))
    return e


def depth(e: Expr) -> int:
    if isinstance(e, (And, Or)):
        return 1 + max(depth(e.left), depth(e.right))
    return 1 + depth(e.inner) if isinstance(e, Not) else 1


def columns_of(e) -> list[str]:
    if isinstance(e, (And, Or, Arith)):
        return columns_of(e.left) + columns_of(e.right)
    if isinstance(e, Not):
        return columns_of(e.inner)
    if isinstance(e, Col):
        return [e.name]
    return [] if isinstance(e, Lit) else [e.column]


def qualify(e: Expr, alias: str) -> Expr:
    """The predicate with every bare column under an alias."""
    put = lambda c: c if "." in c else f"{alias}.{c}"
    if isinstance(e, (And, Or)):
        return type(e)(qualify(e.left, alias), qualify(e.right, alias))
    if isinstance(e, Not):
        return Not(qualify(e.inner, alias))
    return type(e)(**{**e.__dict__, "column": put(e.column)})


OPS = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def compile_predicate(e: Expr, resolve, positive: bool = True) -> Column:
    """`resolve(name)` gives a column. The result is for a filter: only true counts."""
    if isinstance(e, And):
        return compile_predicate(e.left, resolve, positive) & compile_predicate(e.right, resolve, positive)
    if isinstance(e, Or):
        return compile_predicate(e.left, resolve, positive) | compile_predicate(e.right, resolve, positive)
    if isinstance(e, Not):
        return ~compile_predicate(e.inner, resolve, not positive)
    c = resolve(e.column)
    if isinstance(e, IsNull):
        return c.isNotNull() if e.negated else c.isNull()
    if isinstance(e, Compare):
        leaf = OPS[e.op](c, F.lit(e.value))
    elif isinstance(e, In):
        leaf = c.isin(*e.values) if e.values else F.lit(False)
    elif isinstance(e, Between):
        leaf = (c >= F.lit(e.low)) & (c <= F.lit(e.high))
    elif isinstance(e, Like):
        leaf = c.like(e.pattern.replace("\\", "\\\\"))
    else:
        raise InvalidQuery(f"no predicate: {e!r}")
    return leaf if positive else F.coalesce(leaf, F.lit(False))


def compile_scalar(e: Scalar, resolve) -> Column:
    """+ - * give null on overflow or null; / is double and null on division by zero."""
    if isinstance(e, Lit):
        return F.lit(e.value)
    if isinstance(e, Col):
        return resolve(e.name)
    a, b = compile_scalar(e.left, resolve), compile_scalar(e.right, resolve)
    if e.op == "+":
        return F.try_add(a, b)
    if e.op == "-":
        return F.try_subtract(a, b)
    if e.op == "*":
        return F.try_multiply(a, b)
    return F.try_divide(a.cast("double"), b.cast("double"))


def compile_assertion_filter(e: Expr, resolve) -> Column:
    """The other dialect, of commit-time assertions: LIKE means contains, null sorts below every value and comparisons are total."""
    if isinstance(e, And):
        return compile_assertion_filter(e.left, resolve) & compile_assertion_filter(e.right, resolve)
    if isinstance(e, Or):
        return compile_assertion_filter(e.left, resolve) | compile_assertion_filter(e.right, resolve)
    if isinstance(e, Not):
        return ~compile_assertion_filter(e.inner, resolve)
    c = resolve(e.column)
    total = lambda op, v: F.coalesce(OPS[op](c, F.lit(v)), F.lit(_null_against(op, v))) if v is not None else (c.isNull() if op in ("=", "<=") else F.lit(op == ">=") if op == ">=" else c.isNotNull() if op in ("!=", ">") else F.lit(False))
    if isinstance(e, IsNull):
        return c.isNotNull() if e.negated else c.isNull()
    if isinstance(e, Compare):
        return total(e.op, e.value)
    if isinstance(e, In):
        return F.coalesce(c.isin(*[v for v in e.values if v is not None]), F.lit(None in e.values))
    if isinstance(e, Between):
        return total(">=", e.low) & total("<=", e.high)
    return F.coalesce(F.contains(c, F.lit(e.pattern)), F.lit(False))


def _null_against(op: str, value) -> bool:
    """A null column against a value: it is smaller."""
    return op in ("<", "<=", "!=")


_CLASSES = {c.__name__: c for c in (Compare, In, Between, IsNull, Like, And, Or, Not, Col, Lit, Arith, Caller)}


def to_json(e):
    """A predicate or scalar as plain JSON values."""
    if type(e).__name__ in _CLASSES and type(e) in _CLASSES.values():
        return {"!": type(e).__name__, **{k: to_json(v) for k, v in e.__dict__.items()}}
    if isinstance(e, tuple):
        return {"()": [to_json(v) for v in e]}
    return {"b": e.hex()} if isinstance(e, bytes) else e


def from_json(j):
    if isinstance(j, dict):
        if "!" in j:
            if j["!"] == "Caller":
                return CALLER
            return _CLASSES[j["!"]](**{k: from_json(v) for k, v in j.items() if k != "!"})
        return tuple(from_json(v) for v in j["()"]) if "()" in j else bytes.fromhex(j["b"])
    return j
