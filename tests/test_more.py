"""CAS helpers, plans, read sets, contexts, repository, declarations, dumps, bounds."""

from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from cairn.functions.expr import col
from cairn.functions.wideint import from_u256, u256
from cairn.operators import cas, tasks
from cairn.plans import errors, paging, readset
from cairn.plans.query import Query, count, lower, sum_
from cairn.plans.repository import Repository
from cairn.sources import declarative as D
from cairn.sources import offline
from cairn.sources.store import Engine
from cairn.sources.tables import ParquetTables
from cairn.streaming import processors as P

ACC = D.TableSpec("acc").column("id", "integer").column("bal", "integer", nullable=False).column("who", "text").column("big", "u256").key("id").unique("who").check(col("bal").gte(0)).index("by_bal", "bal")


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    e.ddl(*D.plan(e.catalog(), [ACC]))
    e.commit({"kind": "insert", "table": "acc", "rows": [{"id": 1, "bal": 10, "who": "a", "big": u256(5)}, {"id": 2, "bal": 20, "who": "b"}, {"id": 3, "bal": 30}]})
    return e


def rows(e, table="acc", seq=None):
    return sorted(tuple(r)[:3] for r in e.view(seq).table(table).collect())


def test_compare_and_swap(engine):
    v = cas.row_version(engine, "acc", [1])
    assert v == 2 and cas.row_version(engine, "acc", [9]) == 0
    cas.compare_and_swap(engine, "acc", [1], v, {"id": 1, "bal": 11, "who": "a", "big": u256(5)}, {"kind": "kv_set", "key": b"k", "value": u256(7)})
    with pytest.raises(errors.Conflict):
        cas.compare_and_swap(engine, "acc", [1], v, {"id": 1, "bal": 12})
    cas.compare_and_swap(engine, "acc", [9], 0, {"id": 9, "bal": 9})
    cas.compare_and_add_u256(engine, "acc", [1], 3, "big", 4)
    with pytest.raises(errors.Underflow):
        cas.compare_and_add_u256(engine, "acc", [1], cas.row_version(engine, "acc", [1]), "big", -100)
    assert from_u256(bytes(engine.view().table("acc").where("id = 1").first()["big"])) == 9
    at = cas.key_version(engine, b"k")
    cas.kv_compare_and_add(engine, b"k", at, 3)
    with pytest.raises(errors.Conflict):
        cas.kv_compare_and_add(engine, b"k", at, 3)
    cas.kv_compare_u256_and_add(engine, b"k", 10, -4)
    assert from_u256(engine.view().kv_get(b"k")) == 6
    with pytest.raises(errors.Conflict):
        cas.kv_compare_value_and_swap(engine, b"k", b"other", b"x")
    cas.kv_compare_value_and_swap(engine, b"k", u256(6), b"x")
    cas.kv_compare_and_swap(engine, b"k", cas.key_version(engine, b"k"), None)
    cas.kv_compare_and_swap(engine, b"new", 0, b"1")
    assert engine.view().kv_get(b"k") is None and engine.view().kv_get(b"new") == b"1"


def test_read_sets_guard_commits(engine):
    df, seen = readset.query_capturing(Query.select("id").from_("acc").where_(col("id").eq(1)), engine.view())
    assert df.count() == 1 and seen.intersects([("main/app/acc", {"id": 1})]) and not seen.intersects([("main/app/acc", {"id": 2})]) and seen.intersects([("main/app/acc", {})])
    engine.commit({"kind": "upsert", "table": "acc", "rows": [{"id": 2, "bal": 1}]}, read_set=seen)  # another row changed
    engine.commit({"kind": "upsert", "table": "acc", "rows": [{"id": 1, "bal": 1}]}, read_set=seen, write_class="economic")
    with pytest.raises(errors.Conflict):
        engine.commit({"kind": "kv_set", "key": b"x", "value": b"1"}, read_set=seen)
    assert engine.entries[-1]["write_class"] == "economic" and engine.view().kv_get(b"x") is None
    with pytest.raises(errors.ValidationError):
        engine.commit({"kind": "kv_set", "key": b"x", "value": b"1"}, write_class="none")


def test_plans_write_nothing(engine):
    head = engine.head
    p = engine.preflight_plan({"kind": "delete_where", "table": "acc", "where": col("bal").gte(20)}, {"kind": "kv_number", "key": b"n", "op": "add", "amount": 1}, {"kind": "emit", "topic": "t", "key": "k", "payload": {}})
    assert p.errors == [] and p.writes == {"main/app/acc": 2, "_system/app/kv": 1, "_system/app/event_outbox": 1} and engine.head == head == p.base
    engine.commit({"kind": "kv_set", "key": b"m", "value": b"1"}, read_set=p.read_set)
    engine.commit({"kind": "kv_set", "key": b"n", "value": b"1"})
    with pytest.raises(errors.Conflict):
        engine.commit({"kind": "delete", "table": "acc", "keys": [(1,)]}, read_set=p.read_set)
    assert "ConstraintViolation" in engine.preflight_plan({"kind": "upsert", "table": "acc", "rows": [{"id": 1, "bal": -1}]}).errors[0]


def test_idempotency_window(engine):
    m = {"kind": "kv_set", "key": b"k", "value": b"1"}
    one = engine.commit(m, idempotency_key="x")
    assert engine.commit(m, idempotency_key="x").duplicate
    engine.idempotency_commits = 1
    engine.commit({"kind": "kv_set", "key": b"l", "value": b"1"})
    assert not engine.commit(m, idempotency_key="x").duplicate and one.seq == 3
    engine.idempotency_commits, engine.idempotency_seconds = 100, 0
    assert not engine.commit(m, idempotency_key="x").duplicate


def test_foreign_keys_follow_updates(engine):
    for act in ("cascade", "set_null", "restrict"):
        engine.ddl({"op": "create_table", "table": f"main/app/{act}", "columns": [{"name": "id", "type": "integer"}, {"name": "who", "type": "text"}], "primary_key": ["id"], "fks": [{"columns": ["who"], "table": "main/app/acc", "references": ["who"], "on_update": act}]})
    engine.commit({"kind": "insert", "table": "cascade", "rows": [{"id": 1, "who": "a"}, {"id": 2, "who": "b"}]}, {"kind": "insert", "table": "set_null", "rows": [{"id": 1, "who": "a"}]}, {"kind": "insert", "table": "restrict", "rows": [{"id": 1, "who": "b"}]})
    engine.commit({"kind": "update_where", "table": "acc", "where": col("id").eq(1), "updates": {"who": "z"}})
    assert rows(engine, "cascade") == [(1, "z"), (2, "b")] and rows(engine, "set_null") == [(1, None)]
    with pytest.raises(errors.ConstraintViolation):
        engine.commit({"kind": "update_where", "table": "acc", "where": col("id").eq(2), "updates": {"who": "y"}})
    engine.commit({"kind": "update_where", "table": "acc", "where": col("id").eq(2), "updates": {"bal": 1}})


def test_value_bound(engine):
    big = "x" * ((1 << 20) + 1)
    with pytest.raises(errors.ValidationError):
        engine.commit({"kind": "upsert", "table": "acc", "rows": [{"id": 1, "bal": 1, "who": big}]})
    with pytest.raises(errors.ValidationError):
        engine.commit({"kind": "upsert", "table": "acc", "rows": engine.spark.range(1).select("id", F.lit(1).cast("long").alias("bal"), F.lit(big).alias("who"))})


def test_hooks(engine):
    seen = []
    engine.query_hooks.append(seen.append)
    engine.view(caller=None).query(Query.select("id").from_("acc")).count()
    engine.view(2).page(Query.select("id").from_("acc"))
    assert [(x["table"], x["seq"], x["seconds"] is None) for x in seen] == [("main/app/acc", 2, True), ("main/app/acc", 2, False)]


def test_namespace_restore(engine, spark, tmp_path):
    engine.commit({"kind": "kv_set", "key": b"k", "value": b"1"}, {"kind": "kv_set", "ns": "other/app", "key": b"k", "value": b"1"})
    to = str(tmp_path / "copy")
    engine.backup(to)
    engine.ddl({"op": "create_table", "table": "other/app/t", "columns": [{"name": "id", "type": "integer"}], "primary_key": ["id"]})
    engine.commit({"kind": "delete", "table": "acc", "keys": [(1,)]}, {"kind": "kv_del", "key": b"k"}, {"kind": "kv_set", "key": b"l", "value": b"2"}, {"kind": "kv_set", "ns": "other/app", "key": b"k", "value": b"9"}, {"kind": "insert", "table": "other/app/t", "rows": [{"id": 1}]})
    assert engine.restore_namespace(Engine(spark, to), "main") == ["main/app/acc"]
    v = engine.view()
    assert [r[0] for r in rows(engine)] == [1, 2, 3] and v.kv_get(b"k") == b"1" and v.kv_get(b"l") is None and v.kv_get(b"k", "other/app") == b"9" and v.table("other/app/t").count() == 1


def test_effect_batch(engine):
    r = tasks.commit_effect_batch(engine, {"acc": [{"id": 8, "bal": 8}]}, {"acc": [(1,)]}, {b"k": b"v"}, [{"topic": "t", "key": "e", "payload": {"n": 1}}], idempotency_key="b")
    assert r.seq == engine.head and [x[0] for x in rows(engine)] == [2, 3, 8] and engine.view().kv_get(b"k") == b"v" and engine.events().count() == 1
    assert tasks.commit_effect_batch(engine, {"acc": [{"id": 8, "bal": 8}]}, {"acc": [(1,)]}, {b"k": b"v"}, [{"topic": "t", "key": "e", "payload": {"n": 1}}], idempotency_key="b").duplicate
    with pytest.raises(errors.ValidationError):
        tasks.commit_effect_batch(engine)


def test_processor_bounds_and_context(engine):
    for i in range(4):
        engine.commit({"kind": "emit", "topic": "t", "key": f"e{i}", "payload": {"x": "y" * 50}})
    got = []
    p = P.Processor(engine, "p", lambda df: got.append(sorted(r["event_key"] for r in df.collect())), P.Options(max_bytes=130, watermark_commits=3))
    assert p.run_once() == 2 and p.checkpoint() == 4 and p.run_once() == 2 and got == [["e0", "e1"], ["e2", "e3"]]
    assert p.checkpoint() == 4  # two commits on, the watermark is three
    p.flush()
    assert p.checkpoint() == 6
    q = P.Processor(engine, "q", lambda df: got.append(1), P.Options(max_events=1, max_duration_ms=0))
    assert q.run_until_idle() == 1
    c = P.Processor(engine, "c", lambda df: None, P.Options(topic="t", max_events=2)).context()
    assert c.events.count() == 2 and c.read("acc", 1)["bal"] == 10
    c.write("acc", {**c.read("acc", 1), "bal": 99})
    c.delete("acc", 2)
    c.kv_set(b"k", b"v")
    c.emit("out", "o", {})
    assert c.read("acc", 1)["bal"] == 99 and c.read("acc", 2) is None and c.kv_get(b"k") == b"v" and engine.view().kv_get(b"k") is None
    head = engine.head
    c.commit()
    assert engine.head == head + 1 and [x[:2] for x in rows(engine)] == [(1, 99), (3, 30)] and c.processor.checkpoint() == c.last and engine.view().kv_get(b"k") == b"v"


@dataclass
class Account:
    id: int
    bal: int
    who: str | None = None
    note: str = "none"


def test_repository(engine):
    r = Repository(engine.view(), "acc", Account, {"who": str.upper})
    assert r.get(1) == Account(1, 10, "A") and r.find(77) is None and [a.id for a in r.all(r.query().order_by("id"))] == [1, 2, 3]
    with pytest.raises(errors.NotFound):
        r.get(77)
    one = r.page(r.query().order_by("bal", False), size=2)
    two = r.page(r.query().order_by("bal", False), size=2, cursor=one.cursor)
    assert [a.id for a in one.items + two.items] == [3, 2, 1] and one.truncated and not two.truncated
    assert r.page_with_total(size=1)[1] == 3

    @dataclass
    class Wrong:
        id: str

    with pytest.raises(errors.TypeMismatch):
        Repository(engine.view(), "acc", Wrong).get(1)


def test_declarations(engine):
    assert D.plan(engine.catalog(engine.head), [ACC]) == []
    child = D.TableSpec("child").column("id", "integer").column("acc", "integer").key("id").foreign_key(["acc"], "acc", ["id"], on_delete="cascade")
    more = ACC.column("note", "text", default="hi").index("by_who", "who", asynchronous=True)
    m = D.migration(1, "more", engine.catalog(engine.head), [child, more])
    assert engine.migrate([m]) == [1] and D.plan(engine.catalog(engine.head), [child, more]) == []
    engine.commit({"kind": "upsert", "table": "acc", "rows": [{"id": 4, "bal": 1}]})
    assert engine.view().table("acc").where("id = 4").first()["note"] == "hi"
    assert engine.rollback([m], 0) == [1] and not engine.view().exists("child") and "note" not in engine.view().table("acc").columns
    ops = D.plan(engine.catalog(engine.head), [D.TableSpec("acc", ACC.columns[:3], ("id",))], drop=True)
    engine.ddl(*ops)
    assert engine.view().table("acc").columns == ["id", "bal", "who"] and engine.view().describe("acc")["checks"] == []
    with pytest.raises(errors.ValidationError):
        D.plan(engine.catalog(engine.head), [D.TableSpec("acc").column("id", "text").key("id")])


def test_dumps_and_invariants(engine, spark, tmp_path):
    engine.ddl({"op": "create_index", "table": "main/app/acc", "index": "u", "columns": ["bal"], "kind": "unique_hash"}, {"op": "grant", "caller": "x", "permission": "table_read", "on": "main/app/acc"})
    engine.commit({"kind": "kv_set", "key": b"k", "value": b"1"}, {"kind": "emit", "topic": "t", "key": "e", "payload": {}})
    dump, root, folder = str(tmp_path / "dump"), str(tmp_path / "new"), tmp_path / "backups"
    sums = offline.export(engine, dump)
    assert sums["main/app/acc"][0] == 3 and offline.parity(engine, dump) == []
    new = offline.restore(spark, dump, root)
    assert rows(new) == rows(engine) and new.view().kv_get(b"k") == b"1" and new.events().count() == 1 and offline.parity(new, dump) == [] and offline.invariants(new) == []
    assert new.view().describe("acc")["indexes"] == engine.view().describe("acc")["indexes"] and new.view().describe("acc")["unique"] == engine.view().describe("acc")["unique"]
    engine.commit({"kind": "delete", "table": "acc", "keys": [(1,)]})
    assert offline.parity(engine, dump) == ["main/app/acc"]
    bad = spark.createDataFrame([(1, -5, None, None, 1, "U")], "c0 long, c1 long, c2 string, c3 binary, _seq long, _op string")
    new.publish({"files": {"main/app/acc": new.write(bad.withColumn("_seq", F.lit(2).cast("long")), "main/app/acc")}})
    assert any("check" in x for x in offline.invariants(new))
    engine.backup(str(folder / "b1"), until_seq=2)
    engine.backup(str(folder / "b2"))
    assert [b["seq"] for b in offline.backups(spark, str(folder))] == [2, engine.head] and offline.verify_backup(spark, str(folder / "b2")) == []
    engine.log.fs.delete(engine.log.jvm.org.apache.hadoop.fs.Path(str(folder / "b2" / "data" / "main")), True)
    assert offline.verify_backup(spark, str(folder / "b2"))


def test_sums_saturate(spark):
    top = 2**63 - 1
    df = spark.createDataFrame([("over", top), ("over", 1), ("under", -top), ("under", -5), ("mixed", top), ("mixed", 7), ("mixed", -9), ("null", None), ("small", -3), ("small", 1)], "k string, v long")
    q = Query.select().from_("t").group_by("k").aggregate(sum_("v"), count())
    got = {r[0]: r[1] for r in lower(q, ParquetTables(spark, "/none").add("t", df)).collect()}
    assert got == {"over": top, "under": -(2**63), "mixed": top - 2, "null": 0, "small": -2}


def test_join_bound(spark):
    t = ParquetTables(spark, "/none", {"a": ("id",)}).add("a", spark.range(50)).add("b", spark.range(50).withColumnRenamed("id", "x"))
    q = Query.select("a.id").from_("a").inner_join("b", "a.id", "b.x")
    with pytest.raises(errors.ScanBoundExceeded):
        paging.execute_page(q, t, policy=paging.Policy(max_scan_rows=1000, allow_full_scan=False))
    assert len(paging.execute_page(q.limit(5), t, policy=paging.Policy(max_scan_rows=5000, allow_full_scan=False)).rows) == 5
    assert len(paging.execute_page(q.limit(5), t, policy=paging.Policy(max_scan_rows=1000)).rows) == 5
