import json

import pytest

from cairn.__main__ import main
from cairn.functions.expr import col
from cairn.plans import errors
from cairn.plans.query import Query
from cairn.plans.readset import query_capturing
from cairn.sources.store import Engine

T = {"op": "create_table", "table": "main/app/t", "columns": [{"name": "a", "type": "integer"}, {"name": "b", "type": "integer"}, {"name": "v", "type": "text"}], "primary_key": ["a", "b"]}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("ops") / "db"))
    e.ddl({"op": "create_project", "project": "main", "owner": "me"}, T)
    e.commit({"kind": "insert", "table": "t", "rows": [{"a": a, "b": b, "v": "x"} for a in (1, 2) for b in (1, 2)]}, {"kind": "kv_set", "key": b"k1", "value": b"1"})
    return e


def test_read_set(engine):
    one, seen = query_capturing(Query.select().from_("t").where_(col("a").eq(1) & col("v").eq("x")), engine.view())
    _, whole = query_capturing(Query.select().from_("t").where_(col("v").eq("x")), engine.view())
    assert one.count() == 2 and not seen.changed(engine)
    engine.commit({"kind": "update_fields", "table": "t", "key": [2, 1], "updates": {"v": "y"}})
    assert not seen.changed(engine) and whole.changed(engine)
    engine.commit({"kind": "delete", "table": "t", "keys": [(1, 2)]})
    assert seen.changed(engine)


def test_kv_projection_and_introspection(engine):
    with pytest.raises(errors.NotFound):
        engine.view().kv_projection()
    engine.ddl({"op": "enable_kv_projection", "namespace": "main/app"})
    engine.commit({"kind": "kv_set", "ns": "main/other", "key": b"z", "value": b"2"})
    v = engine.view()
    assert [tuple(r)[:2] + (bytes(r["key"]),) for r in v.kv_projection().collect()] == [("main", "app", b"k1")]
    assert v.kv_project("main").count() == 2
    assert v.projects()[0]["tables"] == 1 and v.describe("t")["primary_key"] == ["a", "b"] and v.exists("t") and not v.exists("u")
    assert [json.loads(r["event"])["op"] for r in engine.lifecycle().collect()] == ["create_project", "create_table", "enable_kv_projection"]


def test_command_line(engine, capsys):
    def run(*a):
        code = main([engine.root, *a])
        return code, json.loads(capsys.readouterr().out.strip().splitlines()[-1])

    assert run("verify") == (0, [])
    assert run("tables", "--seq", "2")[1][0]["rows"] == 4
    assert run("scan", "t", "--limit", "1")[1] == [{"a": 1, "b": 1, "v": "x"}]
    assert run("parity", "t", "--seq", "2")[1]["n_rows"] == 4
