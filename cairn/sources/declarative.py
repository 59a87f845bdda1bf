"""Schemas as declarations: tables and indexes as they should be, and the DDL that leads there.

`plan` compares declarations with a catalog and gives the operations that are missing, in an order in
which each finds what it needs; `migration` wraps such a plan, with its way back, for Engine.migrate.
Nothing that holds data is dropped unless `drop=True` asks for it.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from cairn.functions import expr as E
from cairn.plans.errors import ValidationError
from cairn.sources import catalog as C


@dataclass(frozen=True)
class IndexSpec:
    name: str
    columns: tuple[str, ...]
    kind: str = "btree"
    partial: E.Expr | None = None
    asynchronous: bool = False

    def ddl(self, table: str) -> dict:
        op = {"op": "create_async_index" if self.asynchronous else "create_index", "table": table, "index": self.name, "columns": list(self.columns), "kind": self.kind}
        return op | ({"partial": E.to_json(self.partial)} if self.partial is not None else {})


@dataclass(frozen=True)
class TableSpec:
    """Built step by step: TableSpec("users").column("id", "integer").key("id").index("by_age", "age")."""

    name: str
    columns: tuple[dict, ...] = ()
    primary_key: tuple[str, ...] = ()
    uniques: tuple[tuple[str, ...], ...] = ()
    checks: tuple[E.Expr, ...] = ()
    defaults: dict = field(default_factory=dict)
    fks: tuple[dict, ...] = ()
    indexes: tuple[IndexSpec, ...] = ()

    def column(self, name: str, kind: str, nullable: bool = True, default=None) -> TableSpec:
        out = replace(self, columns=(*self.columns, {"name": name, "type": kind, "nullable": nullable}))
        return out if default is None else replace(out, defaults={**self.defaults, name: default})

    def key(self, *columns: str) -> TableSpec:
        return replace(self, primary_key=columns)

    def unique(self, *columns: str) -> TableSpec:
        return replace(self, uniques=(*self.uniques, columns))

    def check(self, e: E.Expr) -> TableSpec:
        return replace(self, checks=(*self.checks, e))

    def foreign_key(self, columns, table: str, references, on_delete: str = "restrict", on_update: str = "restrict") -> TableSpec:
        return replace(self, fks=(*self.fks, {"columns": list(columns), "table": C.full_name(table), "references": list(references), "on_delete": on_delete, "on_update": on_update}))

    def index(self, name: str, *columns: str, **more) -> TableSpec:
        return replace(self, indexes=(*self.indexes, IndexSpec(name, columns, **more)))

    def ddl(self) -> list[dict]:
        table = C.full_name(self.name)
        make = {"op": "create_table", "table": table, "columns": list(self.columns), "primary_key": list(self.primary_key), "unique": [list(u) for u in self.uniques], "checks": [E.to_json(c) for c in self.checks], "defaults": dict(self.defaults), "fks": list(self.fks)}
        return [make, *(i.ddl(table) for i in self.indexes)]


def _altered(spec: TableSpec, held: dict, drop: bool) -> list[dict]:
    table = C.full_name(spec.name)
    if list(spec.primary_key) != held["primary_key"]:
        raise ValidationError(f"{table}: a primary key does not change")
    alter = lambda change, **more: {"op": "alter_table", "table": table, "change": change, **more}
    have, out = {c["name"]: c for c in held["columns"]}, []
    for c in spec.columns:
        if c["name"] not in have:
            if c["name"] in spec.defaults:
                out.append(alter("set_default", column=c["name"], value=spec.defaults[c["name"]]))
            out.append(alter("add_column", column=c))
        elif have[c["name"]]["type"] != c["type"]:
            raise ValidationError(f"{table}.{c['name']} is {have[c['name']]['type']}, not {c['type']}")
        elif c["name"] in spec.defaults and held["defaults"].get(c["name"]) != spec.defaults[c["name"]]:
            out.append(alter("set_default", column=c["name"], value=spec.defaults[c["name"]]))
    by_hash = [i["columns"] for i in held["indexes"].values() if i["kind"] == "unique_hash"]
    wanted, checks = [list(u) for u in spec.uniques], [E.to_json(c) for c in spec.checks]
    out += [alter("add_unique", columns=u) for u in wanted if u not in held["unique"]]
    out += [alter("add_check", check=c) for c in checks if c not in held["checks"]]
    out += [alter("add_fk", fk=f) for f in spec.fks if f not in held["fks"]]
    for i in spec.indexes:
        if i.name not in held["async_indexes" if i.asynchronous else "indexes"]:
            out.append(i.ddl(table))
    if drop:
        named = {(i.name, i.asynchronous) for i in spec.indexes}
        out = [
            *({"op": "drop_async_index" if a else "drop_index", "table": table, "index": n} for a, of in ((False, "indexes"), (True, "async_indexes")) for n in held[of] if (n, a) not in named),
            *(alter("drop_unique", columns=u) for u in held["unique"] if u not in wanted and u not in by_hash),
            *(alter("drop_check", check=c) for c in held["checks"] if c not in checks),
            *(alter("drop_fk", columns=f["columns"]) for f in held["fks"] if f not in spec.fks),
            *out,
            *(alter("drop_column", column=c) for c in have if c not in {x["name"] for x in spec.columns}),
        ]
    return out


def plan(cat: dict, specs: list[TableSpec], drop: bool = False) -> list[dict]:
    """The DDL that brings the declared tables of a catalog to their declarations; drop=True also takes away what they do not name."""
    make, change = [], []
    for s in specs:
        table = C.full_name(s.name)
        if table in cat["tables"]:
            change += _altered(s, cat["tables"][table], drop)
        else:
            make += s.ddl()
    return [*C.order_by_dependency(make), *change]


def migration(version: int, name: str, cat: dict, specs: list[TableSpec]) -> dict:
    """A migration for Engine.migrate, with the way back of what it adds."""
    up = plan(cat, specs)
    undo = {"create_table": lambda o: {"op": "drop_table", "table": o["table"]}, "create_index": lambda o: {"op": "drop_index", "table": o["table"], "index": o["index"]}, "create_async_index": lambda o: {"op": "drop_async_index", "table": o["table"], "index": o["index"]}}
    alter = {"add_column": lambda o: {"change": "drop_column", "column": o["column"]["name"]}, "add_unique": lambda o: {"change": "drop_unique", "columns": o["columns"]}, "add_check": lambda o: {"change": "drop_check", "check": o["check"]}, "add_fk": lambda o: {"change": "drop_fk", "columns": o["fk"]["columns"]}}
    made, down = {o["table"] for o in up if o["op"] == "create_table"}, []
    for o in reversed(up):
        if o["op"] in undo and (o["op"] == "create_table" or o["table"] not in made):
            down.append(undo[o["op"]](o))
        elif o["op"] == "alter_table" and o["change"] in alter:
            down.append({"op": "alter_table", "table": o["table"], **alter[o["change"]](o)})
    return {"version": version, "name": name, "up": up, "down": down}
