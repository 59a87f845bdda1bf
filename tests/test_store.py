import pytest
from pyspark.sql import functions as F

from cairn.functions import expr as E
from cairn.functions.expr import CALLER, col
from cairn.functions.wideint import from_u256, i256, u256
from cairn.operators import eventlog
from cairn.plans import errors
from cairn.plans.query import Query, count
from cairn.sources.catalog import order_by_dependency
from cairn.sources.store import Engine

ACC = {"op": "create_table", "table": "main/app/acc", "columns": [{"name": "id", "type": "integer"}, {"name": "bal", "type": "integer", "nullable": False}, {"name": "who", "type": "text"}], "primary_key": ["id"], "unique": [["who"]], "checks": [E.to_json(col("bal").gte(0))]}


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    e.ddl(ACC)
    e.commit({"kind": "insert", "table": "acc", "rows": [{"id": 1, "bal": 10, "who": "a"}, {"id": 2, "bal": 20, "who": "b"}, {"id": 3, "bal": 30}]})
    return e


def rows(e, table="acc", seq=None):
    return sorted(tuple(r) for r in e.view(seq).table(table).collect())


def test_write_read_travel(engine):
    assert rows(engine) == [(1, 10, "a"), (2, 20, "b"), (3, 30, None)]
    engine.commit({"kind": "update_where", "table": "acc", "where": col("id").lte(2), "updates": {"bal": ("add", 5)}, "limit": 1}, {"kind": "delete", "table": "acc", "keys": [(3,), (99,)]})
    assert rows(engine) == [(1, 15, "a"), (2, 20, "b")] and len(rows(engine, seq=2)) == 3
    engine.checkpoint()
    engine.commit({"kind": "upsert", "table": "acc", "rows": [{"id": 2, "bal": 1, "who": "z"}]})
    assert rows(engine) == [(1, 15, "a"), (2, 1, "z")] and rows(engine, seq=3) == [(1, 15, "a"), (2, 20, "b")]
    assert rows(engine, seq="checkpoint") == [(1, 15, "a"), (2, 20, "b")]
    assert engine.verify() == [] and engine.deltas("main/app/acc", 2, 3).count() == 2
    assert engine.parity("acc", 3).first() != engine.parity("acc").first()


@pytest.mark.parametrize(
    ("m", "error"),
    [
        ({"kind": "insert", "table": "acc", "rows": [{"id": 1, "bal": 1}]}, errors.DuplicateKey),
        ({"kind": "insert", "table": "acc", "rows": [{"id": 7, "bal": 1}, {"id": 7, "bal": 1}]}, errors.DuplicateKey),
        ({"kind": "upsert", "table": "acc", "rows": [{"id": 7, "bal": 1, "who": "a"}]}, errors.ConstraintViolation),
        ({"kind": "upsert", "table": "acc", "rows": [{"id": 7, "bal": -1}]}, errors.ConstraintViolation),
        ({"kind": "upsert", "table": "acc", "rows": [{"id": 7, "bal": None}]}, errors.TypeMismatch),
        ({"kind": "upsert", "table": "acc", "rows": [{"id": 7, "bal": 1.5}]}, errors.TypeMismatch),
        ({"kind": "upsert", "table": "acc", "rows": [{"id": 7, "bal": 1, "x": 1}]}, errors.ValidationError),
        ({"kind": "delete_where", "table": "acc", "where": col("id").eq(1), "limit": 0}, errors.ValidationError),
        ({"kind": "update_where", "table": "acc", "where": col("id").eq(1), "updates": {}}, errors.ValidationError),
        ({"kind": "update_where", "table": "acc", "where": col("id").eq(1), "updates": {"id": 4}}, errors.ValidationError),
        ({"kind": "update_fields", "table": "acc", "key": [77], "updates": {"bal": 4}}, errors.NotFound),
    ],
)
def test_refused(engine, m, error):
    with pytest.raises(error):
        engine.commit(m)
    assert len(rows(engine)) == 3 and engine.head == 2


def test_conflict_actions(engine):
    engine.commit({"kind": "upsert_on_conflict", "table": "acc", "rows": [{"id": 1, "bal": 7, "who": "q"}, {"id": 5, "bal": 5}], "action": "nothing"})
    assert rows(engine)[0] == (1, 10, "a") and rows(engine)[-1] == (5, 5, None)
    engine.commit({"kind": "upsert_on_conflict", "table": "acc", "rows": [{"id": 1, "bal": 7, "who": None}], "action": "merge"})
    assert rows(engine)[0] == (1, 7, "a")
    engine.commit({"kind": "upsert_on_conflict", "table": "acc", "rows": [{"id": 50, "bal": 3, "who": "a"}], "target": ["who"], "action": "with", "updates": {"bal": ("add", 2)}})
    assert rows(engine)[0] == (1, 9, "a")


def test_assertions_and_idempotency(engine):
    engine.commit({"kind": "kv_set", "key": b"k", "value": u256(100)})
    good = [
        {"kind": "count_compare", "table": "acc", "where": col("bal").gt(15), "op": "=", "threshold": 2},
        {"kind": "sum_compare", "table": "acc", "column": "bal", "op": "<=", "threshold": 60},
        {"kind": "row_version", "table": "acc", "key": [1], "version": 2},
        {"kind": "row_column_compare", "table": "acc", "key": [2], "column": "bal", "op": ">", "value": 19},
        {"kind": "key_compare", "key": b"k", "op": ">=", "value": u256(80)},
        {"kind": "any", "of": [{"kind": "row_exists", "table": "acc", "key": [9]}, {"kind": "not", "of": {"kind": "key_exists", "key": b"zz"}}]},
    ]
    one = engine.commit({"kind": "kv_number", "key": b"k", "op": "sub", "amount": 80, "width": 32}, assertions=good, idempotency_key="x")
    again = engine.commit({"kind": "kv_number", "key": b"k", "op": "sub", "amount": 80, "width": 32}, assertions=good, idempotency_key="x")
    assert again.duplicate and again.seq == one.seq and from_u256(engine.view().kv_get(b"k")) == 20
    with pytest.raises(errors.AssertionFailed):
        engine.commit({"kind": "kv_del", "key": b"k"}, assertions=[good[4]])
    with pytest.raises(errors.Underflow):
        engine.commit({"kind": "kv_number", "key": b"k", "op": "sub", "amount": 80, "width": 32})
    engine.commit({"kind": "kv_number", "key": b"k", "op": "sub", "amount": 80, "width": 32, "underflow": "noop"})
    assert from_u256(engine.view().kv_get(b"k")) == 20 and len(engine.audit) == 1
    with pytest.raises(errors.AssertionFailed):  # after the mutations
        engine.commit({"kind": "delete", "table": "acc", "keys": [(1,)]}, {"kind": "postflight", "assertions": [{"kind": "count_compare", "table": "acc", "op": "=", "threshold": 3}]})


def test_assertion_dialect(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "id long, t string")
    keep = lambda e: [r["id"] for r in df.where(E.compile_assertion_filter(e, F.col)).collect()]
    assert keep(col("t").like("b")) == [1] and keep(col("t").lt("z")) == [1, 2] and keep(~col("t").eq("abc")) == [2]


def test_kv_numbers_and_counters(engine):
    c = lambda **m: engine.commit({"kind": "kv_number", "key": b"n", **m})
    n = lambda: int.from_bytes(engine.view().kv_get(b"n"), "big")
    c(op="add", amount=5)
    c(op="max", amount=9)
    c(op="min", amount=20)
    assert n() == 9
    c(op="add", amount=2**64 - 1, overflow="saturate")
    assert n() == 2**64 - 1
    with pytest.raises(errors.Overflow):
        c(op="add", amount=1)
    with pytest.raises(errors.Conflict):
        c(op="set", amount=1, expected=3)
    engine.commit(*({"kind": "counter_add", "key": b"hits", "amount": i, "hint": i} for i in range(1, 6)))
    assert engine.view().counter(b"hits") == 15
    engine.commit({"kind": "kv_set", "key": b"p\xff", "value": b"1"}, {"kind": "kv_set", "key": b"p\x00", "value": b"2"}, {"kind": "kv_set", "key": b"q", "value": b"3"})
    assert [bytes(r["key"]) for r in engine.view().kv_scan(b"p").collect()] == [b"p\x00", b"p\xff"]


def test_foreign_keys(engine):
    child = {"op": "create_table", "table": "main/app/c", "columns": [{"name": "id", "type": "integer"}, {"name": "acc", "type": "integer"}], "primary_key": ["id"], "fks": [{"columns": ["acc"], "table": "main/app/acc", "references": ["id"], "on_delete": "cascade"}]}
    assert [o["table"] for o in order_by_dependency([child, ACC])] == ["main/app/acc", "main/app/c"]
    engine.ddl(child)
    engine.commit({"kind": "upsert", "table": "c", "rows": [{"id": 1, "acc": 1}, {"id": 2, "acc": None}]})
    with pytest.raises(errors.ConstraintViolation):
        engine.commit({"kind": "upsert", "table": "c", "rows": [{"id": 3, "acc": 77}]})
    engine.commit({"kind": "delete", "table": "acc", "keys": [(1,)]})
    assert rows(engine, "c") == [(2, None)]


def test_ddl_and_migrations(engine):
    up = [{"op": "alter_table", "table": "acc", "change": "add_column", "column": {"name": "note", "type": "text"}}, {"op": "alter_table", "table": "acc", "change": "rename_column", "column": "who", "to": "owner"}]
    down = [{"op": "alter_table", "table": "acc", "change": "drop_column", "column": "note"}]
    m = [{"version": 1, "name": "note", "up": up, "down": down}]
    with pytest.raises(errors.ConstraintViolation):
        engine.ddl({"op": "alter_table", "table": "main/app/acc", "change": "drop_column", "column": "id"})
    assert engine.migrate(m) == [1] and engine.migrate(m) == []
    assert engine.view().table("acc").columns == ["id", "bal", "owner", "note"] and rows(engine)[0] == (1, 10, "a", None)
    assert engine.view(2).table("acc").columns == ["id", "bal", "who"]
    with pytest.raises(errors.ValidationError):
        engine.migrate([{**m[0], "up": up[:1]}])
    assert engine.rollback(m, 0) == [1] and engine.view().table("acc").columns == ["id", "bal", "owner"]
    assert engine.ddl({**ACC, "if_not_exists": True}) == [False]


def test_policy_and_permissions(engine):
    engine.ddl({"op": "set_read_policy", "table": "main/app/acc", "policy": E.to_json(col("who").eq(CALLER))}, {"op": "grant", "caller": "a", "permission": "table_read", "on": "main/app/acc"})
    q = Query.select("id").from_("acc")
    assert [r["id"] for r in engine.view(caller="a").query(q).collect()] == [1] and len(engine.view().query(q).collect()) == 3
    assert engine.view(caller="a").query(Query.select().from_("acc").aggregate(count())).first()[0] == 1
    with pytest.raises(errors.PermissionDenied):
        engine.view(caller="b").query(q)
    with pytest.raises(errors.PermissionDenied):
        engine.commit({"kind": "delete", "table": "acc", "keys": [(1,)]}, caller="a")


def test_async_projection(engine):
    engine.ddl({"op": "create_async_index", "table": "main/app/acc", "index": "by_bal", "columns": ["bal"]})
    with pytest.raises(errors.IndexNotFound):
        engine.view().table("acc", "by_bal")
    seq = engine.refresh_projection("main/app/acc", "by_bal")
    engine.commit({"kind": "upsert", "table": "acc", "rows": [{"id": 1, "bal": 99, "who": "a"}]}, {"kind": "delete", "table": "acc", "keys": [(2,)]})
    v = engine.view()
    assert sorted(tuple(r) for r in v.query(Query.select().from_("acc").use_index("by_bal")).collect()) == [(1, 10), (2, 20), (3, 30)] and v.materialized_seq == seq
    engine.refresh_projection("main/app/acc", "by_bal")
    assert sorted(tuple(r) for r in engine.view().query(Query.select().from_("acc").use_index("by_bal")).collect()) == [(1, 99), (3, 30)]


def test_events_retention_backup(engine, spark, tmp_path):
    for i in range(4):
        engine.commit({"kind": "emit", "topic": "t", "key": f"k{i}", "payload": {"n": i}}, {"kind": "emit", "topic": "u", "key": "x", "payload": {}})
    page, cursor = eventlog.page(engine.events(), eventlog.EventQuery().limit(3))
    assert page.count() == 4 and cursor == 4
    assert engine.compact_events(eventlog.Retention(keep_last=3)) == 5 and engine.events().count() == 3
    engine.commit({"kind": "emit", "topic": "t", "key": "k9", "payload": {}})
    assert engine.events().count() == 4
    to = str(tmp_path / "copy")
    engine.backup(to, until_seq=2)
    assert rows(Engine(spark, to)) == rows(engine, seq=2)


def test_wide_ints(spark):
    import random

    r = random.Random(1)
    v = [r.randrange(-(2**250), 2**250) for _ in range(50)] + [0, -1, 1]
    df = spark.createDataFrame([(i256(x),) for x in v], "b binary").orderBy("b")
    assert [bytes(x["b"]) for x in df.collect()] == [i256(x) for x in sorted(v)]


def test_two_writers(engine, spark):
    other = Engine(spark, engine.root)
    engine.commit({"kind": "kv_set", "key": b"a", "value": b"1"})
    assert other.commit({"kind": "kv_set", "key": b"b", "value": b"2"}).seq == 4 and engine.view().kv_get(b"b") == b"2"
    assert not engine.log.create(f"{4:020d}.json", "{}")


def test_a_crash_blocks_nobody(engine):
    for left in (f".{3:020d}.json.lock", f".{3:020d}.json.0123"):  # what a writer that died may leave
        engine.log.fs.createNewFile(engine.log._at(left))
    assert engine.commit({"kind": "kv_set", "key": b"a", "value": b"1"}).seq == 3 and engine.head == 3
    aside = engine.log._at(".aside")
    engine.log.fs.createNewFile(aside)  # file systems without hard links
    assert not engine.log._moved(aside, engine.log._at(f"{3:020d}.json"), local=False) and engine.log._moved(aside, engine.log._at("x"), local=False)


def test_checkpoints_build_on_the_last(engine):
    e = Engine(engine.spark, engine.root, checkpoint_every=3)
    for i in range(4, 8):
        e.commit({"kind": "upsert", "table": "acc", "rows": [{"id": i, "bal": i}]}, {"kind": "delete", "table": "acc", "keys": [(i - 1,)]})
    made = [x["seq"] for x in e.entries if x["checkpoints"]]
    assert len(made) == 2 and rows(e) == [(1, 10, "a"), (2, 20, "b"), (7, 7, None)]
    e.log.fs.delete(e.log.jvm.org.apache.hadoop.fs.Path(f"{e.root}/data"), True)  # the last checkpoint needs no data before it
    assert made[-1] == len(e.entries) and rows(e) == [(1, 10, "a"), (2, 20, "b"), (7, 7, None)]
    assert e.checkpoint() and rows(e) == [(1, 10, "a"), (2, 20, "b"), (7, 7, None)]


def test_partial_projection(engine):
    engine.ddl({"op": "create_async_index", "table": "main/app/acc", "index": "rich", "columns": ["bal"], "partial": E.to_json(col("bal").gte(20) & ~col("who").is_null())})
    held = lambda: sorted(tuple(r) for r in engine.view().query(Query.select().from_("acc").use_index("rich")).collect())
    engine.refresh_projection("main/app/acc", "rich")
    assert held() == [(2, 20)]
    engine.commit({"kind": "upsert", "table": "acc", "rows": [{"id": 1, "bal": 99, "who": "a"}, {"id": 2, "bal": 1, "who": "b"}, {"id": 3, "bal": 50}]})
    engine.refresh_projection("main/app/acc", "rich")
    assert held() == [(1, 99)]


def test_backfill_in_batches(engine):
    sizes = []

    def double(df):
        sizes.append(df.count())
        if len(sizes) == 2 and not again:
            raise RuntimeError("broken off")
        return df.withColumn("bal", F.col("bal") * 2)

    again = False
    with pytest.raises(RuntimeError):
        engine.backfill("acc", double, batch=2, name="twice")
    assert rows(engine) == [(1, 20, "a"), (2, 40, "b"), (3, 30, None)]
    again = True
    assert len(engine.backfill("acc", double, batch=2, name="twice")) == 1 and rows(engine) == [(1, 20, "a"), (2, 40, "b"), (3, 60, None)]
    assert engine.backfill("acc", double, batch=2, name="twice") == [] and sizes == [2, 1, 1]
    assert len(engine.backfill("acc", double)) == 1 and rows(engine)[0] == (1, 40, "a")


def test_small_kv_commits_stand_in_the_log_and_agree_with_files(engine, monkeypatch):
    from cairn.sources import store as S

    def jobs():
        return len(engine.spark.sparkContext.statusTracker().getJobIdsForGroup(None))

    before = jobs()
    for i in range(5):
        engine.commit({"kind": "kv_set", "key": b"k", "value": b"%d" % i})
        engine.commit({"kind": "kv_number", "key": b"n", "op": "add", "amount": i})
    assert jobs() == before and engine.view().kv_get(b"k") == b"4"
    at = len(engine.entries)
    monkeypatch.setattr(S, "INLINE", 0)
    engine.commit({"kind": "kv_set", "key": b"k", "value": b"file"}, {"kind": "kv_set", "key": b"f", "value": b"x"})
    monkeypatch.undo()
    assert (engine.view().kv_get(b"k"), engine.view().kv_get(b"f"), engine.view(at).kv_get(b"f")) == (b"file", b"x", None)
    engine.commit({"kind": "kv_del", "key": b"f"}, {"kind": "kv_number", "key": b"n", "op": "add", "amount": 1})
    engine.checkpoint()
    engine.commit({"kind": "kv_set", "key": b"z", "value": b"9"})
    for e in (engine, S.Engine(engine.spark, engine.root)):
        assert {bytes(r["key"]): bytes(r["value"]) for r in e.view().kv().collect()} == {b"k": b"file", b"n": (11).to_bytes(8, "big"), b"z": b"9"}
        assert e.view().kv_get(b"f") is None and e.view(at).kv_get(b"k") == b"4" and e.view(2).kv_get(b"n") is None


def test_pages_in_turn_come_from_one_pass(engine, monkeypatch):
    from cairn.plans import paging
    from cairn.plans.query import Query

    monkeypatch.setattr(paging, "AHEAD", 20)
    engine.ddl({"op": "create_table", "table": "main/app/many", "columns": [{"name": "id", "type": "integer"}, {"name": "v", "type": "integer"}], "primary_key": ["id"]})
    made = [(i, None if i % 7 == 0 else i * 37 % 11) for i in range(103)]
    engine.commit({"kind": "insert", "table": "many", "rows": engine.spark.createDataFrame(made, "id long, v long")})
    passes, whole = [], paging.Run.after
    monkeypatch.setattr(paging.Run, "after", lambda self, state: passes.append(state) or whole(self, state))
    for up in (True, False):
        passes.clear()
        v, q, got, seen, cursor = engine.view(), Query.select("id", "v").from_("many").order_by("v", up).limit(4), [], [], None
        while cursor or not got:
            page = v.page(q, cursor=cursor)
            if cursor and len(seen) % 9 == 5:  # asked for again, out of turn
                assert v.page(q, cursor=cursor) == page
            got, cursor = got + [tuple(r) for r in page.rows], page.cursor
            seen.append(page)
        want = sorted(made, key=lambda r: ((r[1] is not None, r[1] or 0) if up else (r[1] is None, -(r[1] or 0)), r[0]))
        assert got == want and [len(p.rows) for p in seen] == [4] * 25 + [3] and len(passes) <= 8
