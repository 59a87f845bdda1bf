"""Registered queries that go through a store: tables are written by commits, changed by mutations, and read back from snapshots.

Each builds its own store in scratch space from whole tables; rows stay in Spark from scan to result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import expr as E
from cairn.functions.expr import CALLER, col
from cairn.operators import cas, changelog, eventlog, orderbook, tasks
from cairn.plans import errors
from cairn.plans.query import Query, count, sum_
from cairn.sources import book, offline
from cairn.sources.scratch import scratch
from cairn.sources.store import Engine

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
CUST = {
    "op": "create_table",
    "table": "main/app/cust",
    "columns": [{"name": "id", "type": "integer"}, {"name": "name", "type": "text"}, {"name": "seg", "type": "text"}, {"name": "nation", "type": "integer", "nullable": False}, {"name": "bal", "type": "integer"}],
    "primary_key": ["id"],
    "unique": [["name"]],
}
ORD = {
    "op": "create_table",
    "table": "main/app/ord",
    "columns": [{"name": "id", "type": "integer"}, {"name": "cust", "type": "integer"}, {"name": "status", "type": "text"}],
    "primary_key": ["id"],
    "fks": [{"columns": ["cust"], "table": "main/app/cust", "references": ["id"], "on_delete": "cascade"}],
}
_CUST = "(SELECT c_custkey AS id, c_name AS name, c_mktsegment AS seg, CAST(c_nationkey AS BIGINT) AS nation, CAST(floor(c_acctbal) AS BIGINT) AS bal FROM customer)"
_ORD = "(SELECT o_orderkey AS id, o_custkey AS cust, o_orderstatus AS status FROM orders)"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def customers(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d.rstrip('/')}/customer.parquet")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").cast("long").alias("nation"), F.floor("c_acctbal").cast("long").alias("bal"))


def orders(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"))


def store(spark: SparkSession, d: str, with_orders: bool = False) -> Engine:
    """Commit 1 makes the tables, commit 2 inserts the rows."""
    e = Engine(spark, scratch(spark, "store"))
    e.ddl(CUST, *([ORD] if with_orders else []))
    more = [{"kind": "insert", "table": "ord", "rows": orders(spark, d)}] if with_orders else []
    e.commit({"kind": "insert", "table": "cust", "rows": customers(spark, d)}, *more)
    return e


def _case(name: str, sql: str, with_orders: bool = False):
    """Registers f(engine, spark, sf_dir)."""

    def put(f):
        _QUERIES[name] = lambda s, d: f(store(s, d, with_orders), s, d)
        _SQL[name] = sql
        return f

    return put


def _plain(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.replace(".", "_") for c in df.columns))


@_case("store_insert", f"SELECT * FROM {_CUST}")
def _insert(e, s, d):
    return e.view().table("cust")


@_case("store_upsert", f"SELECT id, name, seg, nation, CASE WHEN nation < 10 THEN 0 ELSE bal END AS bal FROM {_CUST} UNION ALL SELECT id + 10000000, name || '+', seg, nation, bal FROM {_CUST} WHERE nation = 3")
def _upsert(e, s, d):
    c = customers(s, d)
    e.commit({"kind": "upsert", "table": "cust", "rows": c.where("nation < 10").withColumn("bal", F.lit(0).cast("long"))}, {"kind": "upsert", "table": "cust", "rows": c.where("nation = 3").withColumn("id", F.col("id") + 10_000_000).withColumn("name", F.concat("name", F.lit("+")))})
    return e.view().table("cust")


@_case("store_upsert_on_conflict", f"SELECT id, name, seg, nation, CASE WHEN nation = 4 THEN bal + 7 ELSE bal END AS bal FROM {_CUST}")
def _conflict(e, s, d):
    c = customers(s, d)
    e.commit({"kind": "upsert_on_conflict", "table": "cust", "rows": c.where("nation = 4").withColumn("id", -F.col("id")), "target": ["name"], "action": "with", "updates": {"bal": ("add", 7)}}, {"kind": "upsert_on_conflict", "table": "cust", "rows": c.where("nation = 5").withColumn("bal", F.lit(None).cast("long")), "action": "merge"}, {"kind": "upsert_on_conflict", "table": "cust", "rows": c.where("nation = 6").withColumn("bal", F.lit(1).cast("long")), "action": "nothing"})
    return e.view().table("cust")


@_case("store_delete_where", f"SELECT * FROM {_CUST} WHERE id NOT IN (SELECT id FROM {_CUST} WHERE nation >= 20 ORDER BY id LIMIT 40) AND NOT (seg = 'BUILDING' AND bal < 0)")
def _delete_where(e, s, d):
    e.commit({"kind": "delete_where", "table": "cust", "where": col("nation").gte(20), "limit": 40}, {"kind": "delete_where", "table": "cust", "where": col("seg").eq("BUILDING") & col("bal").lt(0)})
    return e.view().table("cust")


@_case("store_update_where", f"SELECT id, name, CASE WHEN seg = 'MACHINERY' THEN name ELSE seg END AS seg, nation + CASE WHEN nation < 3 THEN 100 ELSE 0 END AS nation, CASE WHEN seg = 'MACHINERY' THEN NULL ELSE bal END AS bal FROM {_CUST}")
def _update_where(e, s, d):
    e.commit({"kind": "update_where", "table": "cust", "where": col("nation").lt(3), "updates": {"nation": ("add", 100)}}, {"kind": "update_where_expr", "table": "cust", "where": col("seg").eq("MACHINERY"), "updates": {"seg": ("copy", "name"), "bal": None}})
    return e.view().table("cust")


@_case("store_update_fields", f"SELECT id, name, CASE WHEN id = 7 THEN 'seven' ELSE seg END AS seg, nation, CASE WHEN id = 7 THEN -1 ELSE bal END AS bal FROM {_CUST} WHERE id NOT IN (3, 5)")
def _update_fields(e, s, d):
    e.commit({"kind": "update_fields", "table": "cust", "key": [7], "updates": {"seg": "seven", "bal": -1}}, {"kind": "delete", "table": "cust", "keys": [(3,), (5,), (-1,)]})
    return e.view().table("cust")


_CHANGED = f"SELECT id, name, seg, nation, CASE WHEN nation = 1 THEN 5 ELSE bal END AS bal FROM {_CUST}"


@_case("store_as_of", f"SELECT nation, CAST(sum(bal) AS BIGINT) AS sum_bal, count(*) AS n FROM ({_CHANGED}) WHERE nation <> 2 GROUP BY nation")
def _as_of(e, s, d):
    e.commit({"kind": "update_where", "table": "cust", "where": col("nation").eq(1), "updates": {"bal": 5}})
    e.commit({"kind": "delete_where", "table": "cust", "where": col("nation").eq(2)})
    e.checkpoint()
    e.commit({"kind": "update_where", "table": "cust", "where": col("nation").gte(0), "updates": {"bal": 0}})
    q = Query.select().from_("cust").group_by("nation").aggregate(sum_("bal"), count())
    return _plain(e.view("checkpoint").query(q)).toDF("nation", "sum_bal", "n")


@_case("store_before_checkpoint", f"SELECT id, bal FROM ({_CHANGED})")
def _before(e, s, d):
    e.commit({"kind": "update_where", "table": "cust", "where": col("nation").eq(1), "updates": {"bal": 5}})
    e.commit({"kind": "delete_where", "table": "cust", "where": col("nation").eq(2)})
    e.checkpoint()
    return e.view(3).table("cust").select("id", "bal")


@_case("store_row_changes", f"SELECT id, CASE WHEN nation = 1 THEN 'Update' WHEN nation = 2 THEN 'Delete' ELSE 'Insert' END AS kind FROM (SELECT id, nation FROM {_CUST} WHERE nation IN (1, 2) UNION ALL SELECT id + 10000000, 9 FROM {_CUST} WHERE nation = 3)")
def _row_changes(e, s, d):
    e.commit({"kind": "update_where", "table": "cust", "where": col("nation").eq(1), "updates": {"bal": 5}}, {"kind": "delete_where", "table": "cust", "where": col("nation").eq(2)})
    e.commit({"kind": "insert", "table": "cust", "rows": customers(s, d).where("nation = 3").withColumn("id", F.col("id") + 10_000_000).withColumn("name", F.concat("name", F.lit("+")))})
    return changelog.row_changes(e.deltas("main/app/cust", 0, e.head), ["id"], 2, e.head)


@_case("store_fk_cascade", f"SELECT o.* FROM {_ORD} o JOIN {_CUST} c ON o.cust = c.id WHERE c.nation >= 5", True)
def _cascade(e, s, d):
    e.commit({"kind": "delete_where", "table": "cust", "where": col("nation").lt(5)})
    return e.view().table("ord")


@_case("store_join_policy", f"SELECT c.id AS c_id, o.id AS o_id FROM {_CUST} c JOIN {_ORD} o ON o.cust = c.id WHERE c.seg = 'AUTOMOBILE' AND o.status = 'F'", True)
def _policy(e, s, d):
    e.ddl({"op": "set_read_policy", "table": "main/app/cust", "policy": E.to_json(col("seg").eq(CALLER))}, *({"op": "grant", "caller": "AUTOMOBILE", "permission": "table_read", "on": f"main/app/{t}"} for t in ("cust", "ord")))
    q = Query.select("c.id", "o.id").from_("cust").alias("c").inner_join("ord", "c.id", "o.cust", alias="o").where_(col("o.status").eq("F"))
    return _plain(e.view(caller="AUTOMOBILE").query(q))


@_case("store_assertions", f"SELECT * FROM (SELECT 'count' AS what, (SELECT count(*) FROM {_CUST} WHERE seg = 'BUILDING') > 10 AS held UNION ALL SELECT 'sum', (SELECT sum(bal) FROM {_CUST}) <= 0 UNION ALL SELECT 'row', EXISTS (SELECT 1 FROM {_CUST} WHERE id = 1) UNION ALL SELECT 'column', (SELECT bal FROM {_CUST} WHERE id = 2) > 100 UNION ALL SELECT 'any', true UNION ALL SELECT 'not', false)")
def _assertions(e, s, d):
    has = {"kind": "row_exists", "table": "cust", "key": [1]}
    cases = {
        "count": {"kind": "count_compare", "table": "cust", "where": col("seg").eq("BUILDING"), "op": ">", "threshold": 10},
        "sum": {"kind": "sum_compare", "table": "cust", "column": "bal", "op": "<=", "threshold": 0},
        "row": has,
        "column": {"kind": "row_column_compare", "table": "cust", "key": [2], "column": "bal", "op": ">", "value": 100},
        "any": {"kind": "any", "of": [{"kind": "key_exists", "key": b"none"}, has]},
        "not": {"kind": "not", "of": has},
    }
    out = []
    for name, a in cases.items():
        try:
            e.commit({"kind": "kv_set", "key": name.encode(), "value": b"1"}, assertions=[a])
        except errors.AssertionFailed:
            pass
        out.append((name, e.view().kv_get(name.encode()) is not None))
    return s.createDataFrame(out, "what string, held boolean")


@_case("store_kv_numbers", "SELECT * FROM (VALUES ('a', 12::BIGINT), ('b', 3::BIGINT), ('c', 40::BIGINT), ('d', 0::BIGINT), ('e', 255::BIGINT)) t(k, v)")
def _kv(e, s, d):
    n = lambda key, op, amount, **more: {"kind": "kv_number", "key": key, "op": op, "amount": amount, **more}
    e.commit(n(b"a", "add", 5), n(b"a", "add", 7), n(b"b", "max", 3), n(b"c", "set", 90), n(b"d", "add", 4), {"kind": "kv_set", "key": b"gone", "value": b"x"})
    e.commit(n(b"b", "max", 2), n(b"c", "min", 40), n(b"d", "sub", 9, underflow="noop"), n(b"e", "add", 1000, signed=True, high=255, overflow="saturate"), {"kind": "kv_del", "key": b"gone"}, n(b"d", "sub", 4))
    return e.view().kv().select(F.decode("key", "utf-8").alias("k"), F.conv(F.hex("value"), 16, 10).cast("long").alias("v"))


@_case("store_compare_and_swap", f"SELECT id, name, seg, nation, CASE WHEN id = 1 THEN 77 ELSE bal END AS bal FROM {_CUST}")
def _cas(e, s, d):
    row = {"id": 1, "name": "Customer#000000001", "seg": "x", "nation": 1, "bal": 77}
    mine = e.view().table("cust").where("id = 1").first().asDict()
    cas.compare_and_swap(e, "cust", [1], cas.row_version(e, "cust", [1]), {**mine, "bal": 77})
    try:
        cas.compare_and_swap(e, "cust", [1], 2, row)  # that version is past
    except errors.Conflict:
        pass
    return e.view().table("cust")


@_case("store_async_index", f"SELECT id, bal, nation FROM {_CHANGED.replace('SELECT id, name, seg, nation,', '(SELECT id, nation,')}) WHERE bal >= 5")
def _async(e, s, d):
    e.ddl({"op": "create_async_index", "table": "main/app/cust", "index": "rich", "columns": ["bal", "nation"], "partial": E.to_json(col("bal").gte(5))})
    e.refresh_projection("main/app/cust", "rich")
    e.commit({"kind": "update_where", "table": "cust", "where": col("nation").eq(1), "updates": {"bal": 5}})
    e.refresh_projection("main/app/cust", "rich")
    return e.view().query(Query.select("id", "bal", "nation").from_("cust").use_index("rich"))


@_case("store_backfill", f"SELECT id, upper(seg) || '!' AS seg FROM {_CUST}")
def _backfill(e, s, d):
    e.backfill("cust", lambda df: df.withColumn("seg", F.concat(F.upper("seg"), F.lit("!"))), name="shout")
    return e.view().table("cust").select("id", "seg")


@_case("store_events", "SELECT 'seg' AS topic, c_mktsegment AS event_key, CAST(count(*) AS VARCHAR) AS n FROM customer GROUP BY c_mktsegment")
def _events(e, s, d):
    counted = e.view().query(Query.select().from_("cust").group_by("seg").aggregate(count())).collect()  # one row a segment
    for r in counted:
        tasks.commit_effect_batch(e, events=[{"topic": "seg", "key": r[0], "payload": {"n": r[1]}}, {"topic": "other", "key": r[0], "payload": {}}])
    return eventlog.filtered(e.events(), eventlog.EventQuery().topic("seg")).select("topic", "event_key", F.get_json_object("payload", "$.n").alias("n"))


@_case("store_dump_restore", f"SELECT id, name, bal FROM {_CUST} WHERE nation <> 2")
def _dump(e, s, d):
    e.commit({"kind": "delete_where", "table": "cust", "where": col("nation").eq(2)})
    to = scratch(s, "dump")
    offline.export(e, to)
    return offline.restore(s, to, scratch(s, "store")).view().table("cust").select("id", "name", "bal")


@_case("store_backup_as_of", f"SELECT id, bal FROM {_CUST}")
def _backup(e, s, d):
    e.commit({"kind": "delete_where", "table": "cust", "where": col("nation").eq(2)})
    to = scratch(s, "backup")
    e.backup(to, until_seq=2)
    return Engine(s, to).view().table("cust").select("id", "bal")


@_case("store_order_book", "SELECT 'bid' AS side, 110 - n AS price_ticks, CAST(2 * (n + 1) AS BIGINT) AS qty, 2::BIGINT AS orders FROM (SELECT unnest(range(2, 5)) AS n)")
def _book(e, s, d):
    """Bids at 110, 109 ... 106, two of n + 1 each; asks take the best two levels whole."""
    e.commit({"kind": "book_instrument", "instrument": "i"})
    base = {"instrument": "i", "action": "new", "owner": "o"}
    e.commit({"kind": "order_book", "commands": [{**base, "order_id": 10 * n + k, "side": "bid", "price_ticks": 110 - n, "qty": n + 1} for n in range(5) for k in range(2)]})
    e.commit({"kind": "order_book", "commands": [{**base, "order_id": 900, "owner": "m", "side": "ask", "price_ticks": 105, "qty": 6}]})
    return orderbook.depth(orderbook.open_orders(e.view().table(book.ORDERS)), 3).select("side", "price_ticks", "qty", "orders")


@_case("store_sql", f"SELECT c.seg, count(*) AS n FROM {_CUST} c JOIN {_ORD} o ON o.cust = c.id GROUP BY c.seg", True)
def _sql(e, s, d):
    return e.view().sql("SELECT c.seg, count(*) AS n FROM {cust} c JOIN {ord} o ON o.cust = c.id GROUP BY c.seg", "cust", "ord")


@_case("store_cursor_pages", f"SELECT id, bal FROM {_CUST} ORDER BY bal DESC NULLS LAST, id LIMIT 30 OFFSET 60")
def _pages(e, s, d):
    """The third page of 30, by the cursors of the first two."""
    v, q, cursor, page = e.view(), Query.select("id", "bal").from_("cust").order_by("bal", False).limit(30), None, None
    for _ in range(3):
        page = v.page(q, cursor=cursor)
        cursor = page.cursor
    return s.createDataFrame([tuple(r) for r in page.rows], "id long, bal long")


# --- small stores: outcomes as rows --------------------------------------------------------------------------------
def _outcome(name: str, columns: str, sql: str):
    """Registers f(engine, spark, sf_dir) -> list of tuples, on a store with customers."""

    def put(f):
        _QUERIES[name] = lambda s, d: s.createDataFrame([tuple(r) for r in f(store(s, d), s, d)], columns)
        _SQL[name] = sql
        return f

    return put


def _code(do) -> str:
    try:
        do()
    except (errors.QueryError, errors.EngineError) as e:
        return e.code
    return "ok"


@_outcome("store_kv_scopes", "ns string, k string, v string", "SELECT * FROM (VALUES ('main/app', 'a', '1'), ('main/x', 'a', '2'), ('main/x', 'b', '3')) t(ns, k, v)")
def _kv_scopes(e, s, d):
    put = lambda ns, k, v: {"kind": "kv_set", "ns": ns, "key": k, "value": v}
    e.ddl({"op": "enable_kv_projection", "namespace": "main/x"})
    e.commit(put("main/app", b"a", b"1"), put("main/x", b"a", b"2"), put("main/x", b"b", b"3"), put("other/app", b"a", b"4"), put("main/x", b"c", b"5"))
    e.commit({"kind": "kv_del", "ns": "main/x", "key": b"c"})
    v = e.view()
    held = {(f"{r['project_id']}/{r['scope_id']}", bytes(r["key"])) for r in v.kv_projection("main/x").collect()}
    return [(r["ns"], r["key"].decode(), bytes(r["value"]).decode()) for r in v.kv_project("main").collect() if r["ns"] != "main/x" or (r["ns"], bytes(r["key"])) in held]


@_outcome("store_introspection", "what string, n long", "SELECT 'rows' AS what, count(*) AS n FROM customer UNION ALL SELECT 'columns', 5 UNION ALL SELECT 'projects', 1 UNION ALL SELECT 'indexes', 1 UNION ALL SELECT 'exists', 1 UNION ALL SELECT 'commits', 4")
def _introspection(e, s, d):
    e.ddl({"op": "create_project", "project": "p2"})
    e.ddl({"op": "create_index", "table": "main/app/cust", "index": "by_seg", "columns": ["seg"]})
    v = e.view()
    (t,) = v.tables()
    return [("rows", t["rows"]), ("columns", len(v.describe("cust")["columns"])), ("projects", len(v.projects())), ("indexes", len(t["indexes"])), ("exists", int(v.exists("cust") and not v.exists("none"))), ("commits", e.head)]


@_outcome("store_global_table", "scope string, n long", "SELECT scope, n FROM (VALUES ('app'), ('x')) t(scope), (SELECT count(*) AS n FROM nation)")
def _global(e, s, d):
    e.ddl({"op": "create_table", "table": "_global.nation", "columns": [{"name": "id", "type": "integer"}, {"name": "name", "type": "text"}], "primary_key": ["id"]})
    n = s.read.parquet(f"{d.rstrip('/')}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    e.commit({"kind": "insert", "table": "_global.nation", "rows": n})
    return [(scope, e.view(scope=scope).table("_global.nation").count()) for scope in ("app", "x")]


_REFUSED = {
    "same key": "duplicate_primary_key", "unique": "constraint_violation", "null": "type_mismatch", "type": "type_mismatch", "unknown column": "validation", "limit 0": "validation", "key column": "validation", "no row": "not_found",
    "postflight": "assertion_failed", "no table": "table_not_found", "group without aggregate": "invalid_query", "literal": "type_mismatch", "no permission": "permission_denied", "system table": "validation", "overflow": "overflow", "cursor": "invalid_cursor",
    "foreign key": "constraint_violation", "check": "constraint_violation", "bound": "scan_bound_exceeded", "depth": "invalid_query",
}


@_outcome("store_refusals", "what string, code string, commits long", "SELECT *, 3::BIGINT AS commits FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _REFUSED.items()) + ") t(what, code)")
def _refusals(e, s, d):
    from cairn.plans import paging

    e.ddl({"op": "create_table", "table": "main/app/kid", "columns": [{"name": "id", "type": "integer"}, {"name": "cust", "type": "integer"}], "primary_key": ["id"], "fks": [{"columns": ["cust"], "table": "main/app/cust", "references": ["id"]}], "checks": [E.to_json(col("id").gt(0))]})
    ok = {"id": -1, "name": "n", "seg": "s", "nation": 1, "bal": 1}
    up = lambda **more: {"kind": "upsert", "table": "cust", "rows": [{**ok, **more}]}
    v, q = e.view(), Query.select("id").from_("cust")
    deep = col("id").eq(1)
    for _ in range(300):
        deep = ~deep
    tries = {
        "same key": lambda: e.commit({"kind": "insert", "table": "cust", "rows": [{**ok, "id": 1}]}),
        "unique": lambda: e.commit({"kind": "insert", "table": "cust", "rows": [ok, {**ok, "id": -2}]}),
        "null": lambda: e.commit(up(nation=None)),
        "type": lambda: e.commit(up(bal=1.5)),
        "unknown column": lambda: e.commit(up(x=1)),
        "limit 0": lambda: e.commit({"kind": "delete_where", "table": "cust", "where": col("id").gt(0), "limit": 0}),
        "key column": lambda: e.commit({"kind": "update_where", "table": "cust", "where": col("id").gt(0), "updates": {"id": 1}}),
        "no row": lambda: e.commit({"kind": "update_fields", "table": "cust", "key": [-9], "updates": {"bal": 1}}),
        "postflight": lambda: e.commit({"kind": "delete", "table": "cust", "keys": [(1,)]}, {"kind": "postflight", "assertions": [{"kind": "row_exists", "table": "cust", "key": [1]}]}),
        "no table": lambda: v.query(Query.select("id").from_("none")),
        "group without aggregate": lambda: v.query(q.group_by("id")),
        "literal": lambda: v.query(q.where_(col("id").eq("x"))),
        "no permission": lambda: e.view(caller="nobody").query(q),
        "system table": lambda: e.commit({"kind": "upsert", "table": "_system/app/kv", "rows": []}),
        "overflow": lambda: e.commit({"kind": "kv_number", "key": b"n", "op": "add", "amount": 1 << 64}),
        "cursor": lambda: v.page(q, cursor="none"),
        "foreign key": lambda: e.commit({"kind": "insert", "table": "kid", "rows": [{"id": 1, "cust": -7}]}),
        "check": lambda: e.commit({"kind": "insert", "table": "kid", "rows": [{"id": -1, "cust": 1}]}),
        "bound": lambda: v.page(q, policy=paging.Policy(allow_full_scan=False)),
        "depth": lambda: v.query(q.where_(deep)),
    }
    assert set(tries) == set(_REFUSED)
    return [(k, _code(f), e.head) for k, f in tries.items()]


@_outcome("store_wide_numbers", "k string, v string", "SELECT 'table' AS k, '1000000000000000000000000000000000000005' AS v UNION ALL SELECT 'kv', '999999999999999999999999999999999999999' UNION ALL SELECT 'sum holds', 'True' UNION ALL SELECT 'counter', '120'")
def _wide(e, s, d):
    from cairn.functions.wideint import from_u256, u256

    big = 10**39
    e.ddl({"op": "create_table", "table": "main/app/w", "columns": [{"name": "id", "type": "integer"}, {"name": "v", "type": "u256"}], "primary_key": ["id"]})
    e.commit({"kind": "insert", "table": "w", "rows": [{"id": 1, "v": u256(5)}, {"id": 2, "v": u256(7)}]}, {"kind": "kv_number", "key": b"k", "width": 32, "op": "add", "amount": big})
    e.commit({"kind": "table_add_u256", "table": "w", "key": [1], "column": "v", "amount": big}, {"kind": "kv_number", "key": b"k", "width": 32, "op": "sub", "amount": 1}, *({"kind": "counter_add", "key": b"c", "amount": i, "hint": i} for i in range(16)))
    holds = _code(lambda: e.commit({"kind": "kv_set", "key": b"x", "value": b"1"}, assertions=[{"kind": "sum_compare", "table": "w", "column": "v", "op": "=", "threshold": big + 12}])) == "ok"
    return [("table", str(from_u256(bytes(e.view().table("w").where("id = 1").first()["v"])))), ("kv", str(from_u256(e.view().kv_get(b"k")))), ("sum holds", str(holds)), ("counter", str(e.view().counter(b"c")))]


@_outcome("store_mutate_returning", "id long, before string, after string", f"SELECT id, seg AS before, 'taken' AS after FROM {_CUST} WHERE nation = 7 ORDER BY id LIMIT 3")
def _returning(e, s, d):
    out = []
    for _ in range(3):
        got = tasks.mutate_returning(e, "cust", col("nation").eq(7) & col("seg").neq("taken"), {"seg": "taken"})
        if got is not None:
            out.append((got[0]["id"], got[0]["seg"], got[1]["seg"]))
    return out


@_outcome("store_queue", "name string, place long", "SELECT n_name AS name, row_number() OVER (ORDER BY n_regionkey DESC, n_nationkey) - 1 AS place FROM nation QUALIFY place < 8")
def _queue(e, s, d):
    q = tasks.Queue(e, "q")
    for r in s.read.parquet(f"{d.rstrip('/')}/nation.parquet").orderBy("n_nationkey").collect():  # 25 rows
        q.enqueue(r["n_name"], priority=r["n_regionkey"], now=0)
    q.enqueue("later", priority=99, delay_ms=1000, now=0)
    got = q.claim(8, "w", 100, now=10)
    q.complete(got[0]["id"], got[0]["token"])
    return [(j["payload"], i) for i, j in enumerate(got)]


@_outcome("store_leases_effects", "what string, got string", "SELECT * FROM (VALUES ('first owner', '1'), ('second owner', 'None'), ('after expiry', '2'), ('stale token', 'fencing_lost'), ('checkpoint back', 'validation'), ('effect', 'fresh'), ('effect again', 'in_progress'), ('effect done', 'already_committed'), ('done', '1'), ('state', '4'), ('series', '[3, 2]'), ('projection', 'b=3')) t(what, got)")
def _leases(e, s, d):
    lease, m, fx = tasks.Lease(e, "l"), tasks.Monitor(e, "m"), tasks.Effects(e)
    out = [("first owner", lease.acquire("a", 100, now=0)), ("second owner", lease.acquire("b", 100, now=50)), ("after expiry", lease.acquire("b", 100, now=200)), ("stale token", _code(lambda: lease.renew("a", 1, 100, now=201)))]
    token = m.acquire("a", 1000, now=0)
    m.advance("a", token, 5, now=1)
    out.append(("checkpoint back", _code(lambda: m.advance("a", token, 4, now=2))))
    out += [("effect", fx.begin("x")[0]), ("effect again", fx.begin("x")[0])]
    fx.complete("x", {"r": 1})
    out += [("effect done", fx.begin("x")[0]), ("done", {r["status"]: r["count"] for r in fx.by_status().collect()}["done"])]
    e.ddl({"op": "create_table", "table": "main/app/st", "columns": [{"name": "id", "type": "integer"}, {"name": "n", "type": "integer"}], "primary_key": ["id"]})
    k = tasks.KeyedState(e, "st")
    k.write(1, {"n": 1})
    k.update(1, lambda r: {**r, "n": r["n"] + 3})
    series, p = tasks.Series(e, "s", 2), tasks.Projection(e, "p")
    for i in range(4):
        series.append(i)
    p.put("b", 1)
    p.put("b", 3)
    out += [("state", k.read_field(1, "n")), ("series", series.read(newest_first=True)), ("projection", ",".join(f"{a}={b}" for a, b in p.list()))]
    return [(a, str(b)) for a, b in out]


@_outcome("store_processor", "what string, got string", "SELECT * FROM (VALUES ('handled', '6'), ('seen', 'a0,a1,a2,b0,b1,b2'), ('lag', '0'), ('dead', '1'), ('status', 'healthy'), ('paused', '0'), ('listed', 'p:paused')) t(what, got)")
def _processor(e, s, d):
    import json

    from cairn.streaming import processors as P

    for i in range(3):
        e.commit(*({"kind": "emit", "topic": "t", "key": f"{x}{i}", "payload": {}} for x in "ab"), {"kind": "emit", "topic": "u", "key": "z", "payload": {}})
    seen: list[str] = []

    def handler(rows):
        keys = [r["event_key"] for r in rows.collect()]
        if "bad" in keys:
            raise RuntimeError("bad")
        seen.extend(keys)
        return [{"kind": "kv_set", "key": b"seen", "value": json.dumps(sorted(seen)).encode()}]

    p = P.Processor(e, "p", handler, P.Options(topic="t", max_events=3, max_retries=1, retry_backoff_ms=1, run_on_interval=False))
    handled = p.run_until_idle()
    e.commit({"kind": "emit", "topic": "t", "key": "bad", "payload": {}})
    p.run_once()
    out = [("handled", handled), ("seen", ",".join(json.loads(e.view().kv_get(b"seen")))), ("lag", p.lag()), ("dead", len(p.dead_letters())), ("status", p.slo()["status"])]
    p.pause()
    out += [("paused", p.run_once()), ("listed", ",".join(f"{x['processor']}:{x['state']}" for x in P.list_processors(e)))]
    return [(a, str(b)) for a, b in out]


@_outcome("store_lifecycle", "commit_seq long, op string", "SELECT * FROM (VALUES (1::BIGINT, 'create_table'), (3, 'create_index'), (4, 'alter_table'), (5, 'record_migration'), (5, 'alter_table'), (6, 'forget_migration'), (6, 'alter_table')) t(commit_seq, op)")
def _lifecycle(e, s, d):
    import json

    e.ddl({"op": "create_index", "table": "main/app/cust", "index": "i", "columns": ["seg"]})
    e.ddl({"op": "alter_table", "table": "main/app/cust", "change": "rename_column", "column": "seg", "to": "segment"})
    add = {"op": "alter_table", "table": "main/app/cust", "change": "add_column", "column": {"name": "note", "type": "text"}}
    m = [{"version": 1, "name": "note", "up": [add], "down": [{"op": "alter_table", "table": "main/app/cust", "change": "drop_column", "column": "note"}]}]
    e.migrate(m)
    e.rollback(m, 0)
    return [(r["commit_seq"], json.loads(r["event"])["op"]) for r in e.lifecycle().collect()]


@_outcome("store_pages", "what string, n long", "SELECT 'default page' AS what, least(count(*), 100) AS n FROM customer UNION ALL SELECT 'more', CAST(count(*) > 100 AS BIGINT) FROM customer UNION ALL SELECT 'examined', least(count(*), 101) FROM customer UNION ALL SELECT 'ids over pages', count(*) FROM customer WHERE c_nationkey < 3 UNION ALL SELECT 'total', count(*) FROM customer WHERE c_nationkey < 3 UNION ALL SELECT 'exists', 1 UNION ALL SELECT 'batch', 2 UNION ALL SELECT 'seq', 2")
def _page_facts(e, s, d):
    from cairn.plans import paging

    v = e.view()
    one = v.page(Query.select("id").from_("cust"))
    q, ids, cursor = Query.select("id").from_("cust").where_(col("nation").lt(3)).order_by("bal").limit(40), [], None
    while True:
        page = v.page(q, cursor=cursor)
        e.commit({"kind": "kv_set", "key": b"between", "value": b"1"})  # later commits do not move a snapshot's pages
        ids += [r["id"] for r in page.rows]
        cursor = page.cursor
        if cursor is None:
            break
    total = paging.list_with_total(q, v, seq=v.seq)[1]
    return [("default page", len(one.rows)), ("more", int(one.truncated)), ("examined", one.rows_examined), ("ids over pages", len(set(ids))), ("total", total), ("exists", int(paging.exists(q, v))), ("batch", len(paging.batch([q, q], v))), ("seq", v.seq)]


@_case("store_change_stream", f"SELECT id, 2::BIGINT AS seq, 'U' AS op FROM {_CUST} UNION ALL SELECT id, 3, 'D' FROM {_CUST} WHERE nation = 2 UNION ALL SELECT id, 5, 'U' FROM {_CUST} WHERE nation = 4")
def _stream(e, s, d):
    """The change stream into a table, in two runs with a checkpoint between."""
    from cairn.streaming import processors as P

    out, at = scratch(s, "changes"), scratch(s, "offsets")
    e.commit({"kind": "delete_where", "table": "cust", "where": col("nation").eq(2)})

    def run() -> None:
        P.for_each_batch(P.stream_changes(e, "cust"), lambda b, n: b.write.mode("append").parquet(out), at).awaitTermination()

    run()
    e.checkpoint()
    e.commit({"kind": "update_where", "table": "cust", "where": col("nation").eq(4), "updates": {"bal": 1}})
    run()
    return s.read.parquet(out).select("id", F.col("_seq").alias("seq"), F.col("_op").alias("op"))
