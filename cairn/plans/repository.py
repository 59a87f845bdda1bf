"""Typed access to one table of a snapshot: rows as dataclasses, decoded strictly, and pages of them."""

from __future__ import annotations

import dataclasses
import types
import typing
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import functions as F

from cairn.plans.errors import NotFound, TypeMismatch
from cairn.plans.paging import Page, list_with_total
from cairn.plans.query import Query


@dataclass(frozen=True)
class TypedPage:
    items: list
    cursor: str | None
    truncated: bool
    snapshot_seq: int


def _fits(value, hint) -> bool:
    if hint is typing.Any:
        return True
    if typing.get_origin(hint) in (typing.Union, types.UnionType):
        return any(_fits(value, h) for h in typing.get_args(hint))
    if hint in (None, type(None)):
        return value is None
    kind = typing.get_origin(hint) or hint
    return isinstance(value, kind) and not (kind in (int, float) and isinstance(value, bool))


def decode(row, cls: type, decoders: dict[str, Callable] | None = None):
    """A row as an instance of a dataclass: its fields by name, through their decoder if there is one. Missing fields need a default."""
    given, hints, out = row.asDict() if hasattr(row, "asDict") else dict(row), typing.get_type_hints(cls), {}
    for f in dataclasses.fields(cls):
        if f.name not in given:
            if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING:
                raise TypeMismatch(f"no column {f.name}")
            continue
        v = given[f.name]
        v = bytes(v) if isinstance(v, bytearray) else v
        if decoders and f.name in decoders and v is not None:
            v = decoders[f.name](v)
        if not _fits(v, hints[f.name]):
            raise TypeMismatch(f"{f.name}: {v!r} is no {hints[f.name]}")
        out[f.name] = v
    return cls(**out)


class Repository:
    """Rows of `table` in a view, as instances of `cls`."""

    def __init__(self, view, table: str, cls: type, decoders: dict[str, Callable] | None = None):
        self.view, self.table, self.cls, self.decoders = view, table, cls, decoders

    def decode(self, row):
        return decode(row, self.cls, self.decoders)

    def query(self) -> Query:
        return Query.select("*").from_(self.table)

    def find(self, *key):
        """The row of a key, or None."""
        rows = self.view.query(self.query())
        for c, v in zip(self.view.primary_key(self.table), key, strict=True):
            rows = rows.where(F.col(c) == F.lit(v))
        r = rows.first()
        return None if r is None else self.decode(r)

    def get(self, *key):
        out = self.find(*key)
        if out is None:
            raise NotFound(f"{self.table} {key}")
        return out

    def _typed(self, page: Page) -> TypedPage:
        return TypedPage([self.decode(r) for r in page.rows], page.cursor, page.truncated, page.snapshot_seq)

    def page(self, q: Query | None = None, size: int | None = None, cursor: str | None = None, **options) -> TypedPage:
        q = q or self.query()
        return self._typed(self.view.page(replace(q, take=size) if size is not None else q, cursor=cursor, **options))

    def page_with_total(self, q: Query | None = None, size: int | None = None, **options) -> tuple[TypedPage, int]:
        q = q or self.query()
        page, total = list_with_total(replace(q, take=size) if size is not None else q, self.view, self.view.caller, seq=self.view.seq, **options)
        return self._typed(page), total

    def all(self, q: Query | None = None) -> Iterator:
        """Every row, one after another; only a partition at a time is held."""
        return map(self.decode, self.view.query(q or self.query()).toLocalIterator())
