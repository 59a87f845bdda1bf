"""The registered queries over the star-schema, event and document tables, with their SQL twins.

Every query runs over whole tables; a limit stands only where it is the feature.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.expr import CALLER, col, lit
from cairn.operators import changelog, eventlog, keyed
from cairn.plans import paging
from cairn.plans.query import Query, all_of, any_of, avg, count, lower, max_, min_, not_of, on, sum_
from cairn.sources.tables import ParquetTables

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
KEYS = {"orders": ("o_orderkey",), "customer": ("c_custkey",), "nation": ("n_nationkey",), "region": ("r_regionkey",), "part": ("p_partkey",), "supplier": ("s_suppkey",), "documents": ("doc_id",), "events": ("event_id",)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from cairn.plans import storequeries

    return _QUERIES | storequeries.queries()


def oracle_sql() -> dict[str, str]:
    from cairn.plans import storequeries

    return _SQL | storequeries.oracle_sql()


def _tables(spark: SparkSession, d: str, **policies) -> ParquetTables:
    return ParquetTables(spark, d, KEYS, policies)


def _flat(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.replace(".", "_") for c in df.columns))


def _frame(name: str, sql: str | None):
    """Registers a function of (spark, sf_dir)."""

    def put(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def _query(name: str, q: Query, sql: str, finish=None, caller: str | None = None, **policies) -> None:
    """Registers a builder query."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        df = _flat(lower(q, _tables(spark, d, **policies), caller))
        return finish(df) if finish else df

    _QUERIES[name], _SQL[name] = run, sql


def _rounded(*names: str):
    return lambda df: df.withColumns({n: F.round(n, 2) for n in names})


def _as(**to: str):
    """Renames new=old."""
    return lambda df: df.withColumnsRenamed({v: k for k, v in to.items()})


S = Query.select

# --- scans, predicates -------------------------------------------------------------------------
_query("scan_project_star", S().from_("nation"), "SELECT * FROM nation")
_query("project_columns", S("r_name", "r_regionkey").from_("region"), "SELECT r_name, r_regionkey FROM region")
_query("pk_point_lookup", S("o_orderkey", "o_totalprice").from_("orders").where_(col("o_orderkey").eq(7)), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7")
_query("pk_prefix_scan", S("l_orderkey", "l_linenumber", "l_partkey").from_("lineitem").where_(col("l_orderkey").eq(11)), "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey = 11")
_LI = ("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
for _n, _e, _s in (
    ("eq", col("l_quantity").eq(17.0), "l_quantity = 17"),
    ("ne", col("l_returnflag").neq("N"), "l_returnflag <> 'N'"),
    ("lt", col("l_quantity").lt(5.0), "l_quantity < 5"),
    ("lte", col("l_quantity").lte(5.0), "l_quantity <= 5"),
    ("gt", col("l_quantity").gt(45.0), "l_quantity > 45"),
    ("gte", col("l_quantity").gte(45.0), "l_quantity >= 45"),
    ("between", col("l_quantity").between(10.0, 12.0), "l_quantity BETWEEN 10 AND 12"),
    ("in", col("l_quantity").in_([1.0, 2.0, 50.0]), "l_quantity IN (1, 2, 50)"),
):
    _query(f"filter_{_n}", S(*_LI).from_("lineitem").where_(_e), f"SELECT {', '.join(_LI)} FROM lineitem WHERE {_s}")

_DL = S("documents.doc_id", "labels.quality").from_("documents").left_join("labels", "documents.doc_id", "labels.doc_id")
_DLQ = "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
_query("filter_is_null", _DL.where_(col("labels.quality").is_null()), f"SELECT d.doc_id AS documents_doc_id, l.quality AS labels_quality {_DLQ} WHERE l.quality IS NULL")
_query("filter_is_not_null", _DL.where_(col("labels.quality").is_not_null()), f"SELECT d.doc_id AS documents_doc_id, l.quality AS labels_quality {_DLQ} WHERE l.quality IS NOT NULL")
_query("filter_not_two_valued", _DL.where_(~col("labels.quality").eq(1)), f"SELECT d.doc_id AS documents_doc_id, l.quality AS labels_quality {_DLQ} WHERE NOT coalesce(l.quality = 1, false)")
_query(
    "filter_or_and_nested",
    _DL.where_((col("labels.quality").eq(0) | col("documents.lang").eq("de")) & ~(col("documents.n_chars").gt(3000) | col("labels.toxic").eq(1))),
    f"SELECT d.doc_id AS documents_doc_id, l.quality AS labels_quality {_DLQ} WHERE (coalesce(l.quality = 0, false) OR d.lang = 'de') AND NOT (coalesce(d.n_chars > 3000, false) OR coalesce(l.toxic = 1, false))",
)
_query("filter_like_prefix", S("p_partkey", "p_name").from_("part").where_(col("p_name").like("part_1%")), "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'part_1%'")
_query("filter_like_suffix", S("c_custkey", "c_name").from_("customer").where_(col("c_name").like("%7")), "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%7'")
_query("filter_like_infix", S("p_partkey", "p_type").from_("part").where_(col("p_type").like("%A%")), "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%A%'")
_query("filter_like_underscore", S("c_custkey", "c_mktsegment").from_("customer").where_(col("c_mktsegment").like("_U%")), "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment LIKE '_U%'")
_query("index_and_intersection", S(*_LI).from_("lineitem").where_(col("l_quantity").gt(40.0) & col("l_returnflag").eq("R") & col("l_linenumber").eq(3)), f"SELECT {', '.join(_LI)} FROM lineitem WHERE l_quantity > 40 AND l_returnflag = 'R' AND l_linenumber = 3")
_query("index_or_union", S(*_LI).from_("lineitem").where_(col("l_quantity").eq(1.0) | col("l_orderkey").lt(20)), f"SELECT {', '.join(_LI)} FROM lineitem WHERE l_quantity = 1 OR l_orderkey < 20")
_query("composite_prefix", S(*_LI).from_("lineitem").where_(col("l_returnflag").eq("A") & col("l_linestatus").eq("F") & col("l_quantity").between(3.0, 4.0)), f"SELECT {', '.join(_LI)} FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F' AND l_quantity BETWEEN 3 AND 4")


@_frame("partial_index", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 48")
def _partial_index(spark, d):
    t = _tables(spark, d)
    t.projections["by_returned"] = lower(S("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag").from_("lineitem").where_(col("l_returnflag").eq("R")), t)
    return lower(S("l_orderkey", "l_linenumber", "l_quantity").from_("lineitem").use_index("by_returned").where_(col("l_quantity").gt(48.0)), t)


# --- computed columns ----------------------------------------------------------------------------
_query("computed_add", S("l_orderkey", "l_linenumber").from_("lineitem").compute("v", col("l_linenumber") + 10), "SELECT l_orderkey, l_linenumber, l_linenumber + 10 AS v FROM lineitem")
_query("computed_sub", S("o_orderkey").from_("orders").compute("v", col("o_orderkey") - col("o_custkey")), "SELECT o_orderkey, o_orderkey - o_custkey AS v FROM orders")
_query("computed_mul", S("l_orderkey", "l_linenumber").from_("lineitem").compute("v", col("l_extendedprice") * (lit(1.0) - col("l_discount"))), "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS v FROM lineitem", lambda df: df.withColumn("v", F.round("v", 4)))
_query("computed_div_null_safe", S("l_orderkey", "l_linenumber").from_("lineitem").compute("v", col("l_quantity") / (col("l_linenumber") - 1)), "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity / (l_linenumber - 1) END, 2) AS v FROM lineitem", _rounded("v"))
_query("computed_overflow_null", S("o_orderkey").from_("orders").compute("v", col("o_orderkey") * (2**53)), "SELECT o_orderkey, CAST(CASE WHEN o_orderkey < 1024 THEN o_orderkey * 9007199254740992 END AS VARCHAR) AS v FROM orders", lambda df: df.withColumn("v", F.col("v").cast("string")))
_query("computed_null_operand", S("documents.doc_id").from_("documents").left_join("labels", "documents.doc_id", "labels.doc_id").compute("v", col("labels.quality") + 1), f"SELECT d.doc_id AS documents_doc_id, l.quality + 1 AS v {_DLQ}")
_query("computed_timestamp_micros", S("event_id").from_("events").compute("v", col("ts") - 1_700_000_000_000_000), "SELECT event_id, epoch_us(ts) - 1700000000000000 AS v FROM events")

# --- joins ----------------------------------------------------------------------------------------
_CN = "customer.c_custkey"
_query("join_inner_pk_probe", S(_CN, "nation.n_name").from_("customer").inner_join("nation", "customer.c_nationkey", "nation.n_nationkey"), "SELECT c_custkey AS customer_c_custkey, n_name AS nation_n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
_query("join_inner_hash", S("orders.o_orderkey", _CN).from_("orders").inner_join("customer", "orders.o_custkey", "customer.c_custkey").where_(col("customer.c_acctbal").gt(0.0)), "SELECT o_orderkey AS orders_o_orderkey, c_custkey AS customer_c_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0")
_query("join_left", S("orders.o_orderkey", "lineitem.l_partkey").from_("orders").left_join("lineitem", "orders.o_orderkey", "lineitem.l_orderkey"), "SELECT o_orderkey AS orders_o_orderkey, l_partkey AS lineitem_l_partkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
_query("join_right", S("labels.quality", "documents.doc_id").from_("labels").right_join("documents", "labels.doc_id", "documents.doc_id"), "SELECT l.quality AS labels_quality, d.doc_id AS documents_doc_id FROM labels l RIGHT JOIN documents d ON l.doc_id = d.doc_id")
_query("join_cross", S("region.r_name", "nation.n_name").from_("region").cross_join("nation").where_(col("nation.n_nationkey").lt(5)), "SELECT r_name AS region_r_name, n_name AS nation_n_name FROM region CROSS JOIN nation WHERE n_nationkey < 5")
_query(
    "join_composite_residual",
    S("l.l_orderkey", "l.l_partkey", "p.p_size").from_("lineitem").alias("l").inner_join_on("part", all_of(on("l.l_partkey", "p.p_partkey"), on("l.l_linenumber", "p.p_size", "<")), "p"),
    "SELECT l_orderkey AS l_l_orderkey, l_partkey AS l_l_partkey, p_size AS p_p_size FROM lineitem JOIN part ON l_partkey = p_partkey AND l_linenumber < p_size",
)
_query("join_theta_range", S("a.n_name", "b.r_name").from_("nation").alias("a").inner_join_on("region", on("a.n_regionkey", "b.r_regionkey", "<"), "b"), "SELECT n_name AS a_n_name, r_name AS b_r_name FROM nation JOIN region ON n_regionkey < r_regionkey")
_query("join_on_or", S("a.n_name", "b.r_name").from_("nation").alias("a").left_join_on("region", any_of(on("a.n_regionkey", "b.r_regionkey"), on("a.n_nationkey", "b.r_regionkey")), "b"), "SELECT n_name AS a_n_name, r_name AS b_r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey OR n_nationkey = r_regionkey")
_query("join_on_not", S("a.n_name", "b.r_name").from_("nation").alias("a").right_join_on("region", not_of(on("a.n_regionkey", "b.r_regionkey", "!=")), "b"), "SELECT n_name AS a_n_name, r_name AS b_r_name FROM nation RIGHT JOIN region ON NOT (n_regionkey <> r_regionkey)")
_query("join_cross_type_key", S("c.c_custkey", "s.s_suppkey").from_("customer").alias("c").inner_join("supplier", "c.c_nationkey", "s.s_suppkey", "s"), "SELECT c_custkey AS c_c_custkey, s_suppkey AS s_s_suppkey FROM customer JOIN supplier ON c_nationkey = s_suppkey")
_query("join_float_key", S("a.l_orderkey", "b.p_partkey").from_("lineitem").alias("a").inner_join("part", "a.l_quantity", "b.p_partkey", "b"), "SELECT l_orderkey AS a_l_orderkey, p_partkey AS b_p_partkey FROM lineitem JOIN part ON l_quantity = p_partkey")
_query(
    "join_chain_3way",
    S("orders.o_orderkey", "nation.n_name", "region.r_name").from_("orders").inner_join("customer", "orders.o_custkey", "customer.c_custkey").inner_join("nation", "customer.c_nationkey", "nation.n_nationkey").inner_join("region", "nation.n_regionkey", "region.r_regionkey"),
    "SELECT o_orderkey AS orders_o_orderkey, n_name AS nation_n_name, r_name AS region_r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
_query("self_join_alias", S("a.n_name", "b.n_name").from_("nation").alias("a").inner_join("nation", "a.n_regionkey", "b.n_regionkey").with_last_join_alias("b"), "SELECT a.n_name AS a_n_name, b.n_name AS b_n_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
_query("join_transitive_constant", S("orders.o_orderkey", "customer.c_name").from_("orders").inner_join("customer", "orders.o_custkey", "customer.c_custkey").where_(col("orders.o_custkey").eq(5)), "SELECT o_orderkey AS orders_o_orderkey, c_name AS customer_c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey = 5")
_query("join_computed", S("l.l_orderkey", "l.l_linenumber").from_("lineitem").alias("l").inner_join("part", "l.l_partkey", "p.p_partkey", "p").compute("gap", col("l.l_extendedprice") - col("p.p_retailprice")), "SELECT l_orderkey AS l_l_orderkey, l_linenumber AS l_l_linenumber, round(l_extendedprice - p_retailprice, 2) AS gap FROM lineitem JOIN part ON l_partkey = p_partkey", _rounded("gap"))
_query("join_distinct", S("nation.n_name").from_("supplier").inner_join("nation", "supplier.s_nationkey", "nation.n_nationkey").distinct(), "SELECT DISTINCT n_name AS nation_n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
_query(
    "join_aggregate_having",
    S().from_("customer").inner_join("nation", "customer.c_nationkey", "nation.n_nationkey").group_by("nation.n_name").aggregate(count()).having(col("count_star").gte(50)),
    "SELECT n_name AS nation_n_name, count(*) AS count_star FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) >= 50",
)

# --- aggregates -----------------------------------------------------------------------------------
_query("agg_count", S().from_("lineitem").aggregate(count()), "SELECT count(*) AS count_star FROM lineitem")
_query("agg_sum_int", S().from_("lineitem").aggregate(sum_("l_linenumber")), "SELECT CAST(sum(l_linenumber) AS BIGINT) AS sum_l_linenumber FROM lineitem")
_query("agg_sum_float", S().from_("lineitem").aggregate(sum_("l_quantity")), "SELECT round(sum(l_quantity), 2) AS sum_l_quantity FROM lineitem", _rounded("sum_l_quantity"))
_query("agg_min_max", S().from_("orders").aggregate(min_("o_totalprice"), max_("o_totalprice"), min_("o_orderpriority"), max_("o_orderdate")), "SELECT min(o_totalprice) AS min_o_totalprice, max(o_totalprice) AS max_o_totalprice, min(o_orderpriority) AS min_o_orderpriority, max(o_orderdate) AS max_o_orderdate FROM orders")
_query("agg_avg", S().from_("lineitem").aggregate(avg("l_quantity"), avg("l_linenumber")), "SELECT round(avg(l_quantity), 2) AS avg_l_quantity, round(avg(l_linenumber), 2) AS avg_l_linenumber FROM lineitem", _rounded("avg_l_quantity", "avg_l_linenumber"))
_query("agg_global_empty", S().from_("orders").where_(col("o_orderkey").lt(-5)).aggregate(count(), sum_("o_custkey")), "SELECT count(*) AS count_star, CAST(coalesce(sum(o_custkey), 0) AS BIGINT) AS sum_o_custkey FROM orders WHERE o_orderkey < -5 HAVING count(*) > 0")
_query("agg_sum_empty_zero", _DL.where_(col("labels.quality").is_null()).group_by("documents.lang").aggregate(sum_("labels.quality"), count()), f"SELECT d.lang AS documents_lang, CAST(coalesce(sum(l.quality), 0) AS BIGINT) AS \"sum_labels_quality\", count(*) AS count_star {_DLQ} WHERE l.quality IS NULL GROUP BY d.lang")
_query("group_by_multi", S().from_("lineitem").group_by("l_returnflag", "l_linestatus").aggregate(count(), sum_("l_quantity"), avg("l_discount")), "SELECT l_returnflag, l_linestatus, count(*) AS count_star, round(sum(l_quantity), 2) AS sum_l_quantity, round(avg(l_discount), 2) AS avg_l_discount FROM lineitem GROUP BY ALL", _rounded("sum_l_quantity", "avg_l_discount"))
_query("group_by_null_key", _DL.group_by("labels.quality").aggregate(count()), f"SELECT l.quality AS labels_quality, count(*) AS count_star {_DLQ} GROUP BY l.quality")
_query("having_filter", S().from_("orders").group_by("o_custkey").aggregate(count(), sum_("o_totalprice")).having(col("count_star").gte(12) & col("sum_o_totalprice").gt(100.0)), "SELECT o_custkey, count(*) AS count_star, round(sum(o_totalprice), 2) AS sum_o_totalprice FROM orders GROUP BY o_custkey HAVING count(*) >= 12 AND sum(o_totalprice) > 100", _rounded("sum_o_totalprice"))
_query("order_by_aggregate", S().from_("orders").group_by("o_orderpriority").aggregate(count()).order_by("count_star", False).order_by("o_orderpriority").limit(3), "SELECT o_orderpriority, count(*) AS count_star FROM orders GROUP BY o_orderpriority ORDER BY 2 DESC, 1 LIMIT 3")

# --- distinct, order, pages ---------------------------------------------------------------------------
_query("distinct_rows", S("l_returnflag", "l_linestatus").from_("lineitem").distinct(), "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
_query("distinct_offset_limit", S("l_quantity").from_("lineitem").distinct().order_by("l_quantity").offset(5).limit(10), "SELECT DISTINCT l_quantity FROM lineitem ORDER BY l_quantity OFFSET 5 LIMIT 10")
_query("distinct_computed", S("l_linenumber").from_("lineitem").distinct().compute("v", col("l_linenumber") * 2), "SELECT DISTINCT l_linenumber, l_linenumber * 2 AS v FROM lineitem")
_query("distinct_order_other", S("c_mktsegment").from_("customer").distinct().order_by("c_acctbal").limit(3), "SELECT c_mktsegment FROM customer GROUP BY c_mktsegment ORDER BY min(c_acctbal) LIMIT 3")
_query("sort_multi", S("o_orderkey", "o_orderpriority").from_("orders").order_by("o_orderpriority", False).order_by("o_orderkey").limit(50), "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC, o_orderkey LIMIT 50")
_query("topk", S("o_orderkey", "o_totalprice").from_("orders").order_by("o_totalprice", False).order_by("o_orderkey").limit(25), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
_query("sort_nulls_first", S("documents.doc_id", "labels.quality").from_("documents").left_join("labels", "documents.doc_id", "labels.doc_id").order_by("labels.quality").order_by("documents.doc_id").limit(40), f"SELECT d.doc_id AS documents_doc_id, l.quality AS labels_quality {_DLQ} ORDER BY l.quality NULLS FIRST, d.doc_id LIMIT 40")
_query("offset_limit", S("o_orderkey").from_("orders").order_by("o_orderkey").offset(100).limit(20), "SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 100 LIMIT 20")
_query("ordered_predicate_range", S("o_orderkey", "o_totalprice").from_("orders").where_(col("o_totalprice").gte(1000.0)).order_by("o_totalprice").order_by("o_orderkey").limit(15), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 1000 ORDER BY o_totalprice, o_orderkey LIMIT 15")
_query(
    "flagship_top_customers",
    S().from_("orders").inner_join("customer", "orders.o_custkey", "customer.c_custkey").inner_join("nation", "customer.c_nationkey", "nation.n_nationkey").where_(col("nation.n_name").eq("NATION_2") & col("orders.o_totalprice").gte(1000.0)).group_by("customer.c_custkey", "customer.c_name").aggregate(count(), sum_("orders.o_totalprice")).having(col("count_star").gte(2)).order_by("sum_orders.o_totalprice", False).order_by("customer.c_custkey").limit(10),
    "SELECT c_custkey AS customer_c_custkey, c_name AS customer_c_name, count(*) AS count_star, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_2' AND o_totalprice >= 1000 GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY revenue DESC, 1 LIMIT 10",
    lambda df: df.withColumn("revenue", F.round("sum_orders_o_totalprice", 2)).drop("sum_orders_o_totalprice"),
)


@_frame("keyset_page_2", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey OFFSET 50 LIMIT 50")
def _keyset(spark, d):
    t, q = _tables(spark, d), S("o_orderkey", "o_totalprice").from_("orders").order_by("o_totalprice", False).limit(50)
    two = paging.execute_page(q, t, cursor=paging.execute_page(q, t).cursor)
    return spark.createDataFrame([tuple(r) for r in two.rows], "o_orderkey long, o_totalprice double")


@_frame("list_with_total", "SELECT count(*) AS total FROM orders WHERE o_orderpriority = '1-URGENT'")
def _total(spark, d):
    return paging.total_rows(S("o_orderkey").from_("orders").where_(col("o_orderpriority").eq("1-URGENT")), _tables(spark, d)).withColumnRenamed("count_star", "total")


@_frame("index_rank", "SELECT count(*) AS rank FROM orders o, (SELECT * FROM orders WHERE o_orderkey = 42) m WHERE o.o_totalprice < m.o_totalprice OR (o.o_totalprice = m.o_totalprice AND o.o_orderkey < m.o_orderkey)")
def _rank(spark, d):
    return paging.index_rank(_tables(spark, d).table("orders"), ["o_totalprice"], ["o_orderkey"], [42])


@_frame("index_prefix_window", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderpriority = '2-HIGH' ORDER BY o_totalprice, o_orderkey OFFSET 10 LIMIT 20")
def _window(spark, d):
    return paging.index_window(_tables(spark, d).table("orders"), ["o_orderpriority", "o_totalprice"], ["2-HIGH"], ["o_orderkey"], 10, 20).select("o_orderkey", "o_orderpriority", "o_totalprice")


@_frame("lookup_then_hydrate", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 3000)")
def _hydrate(spark, d):
    t = _tables(spark, d)
    return paging.lookup_then_hydrate(S("o_custkey").from_("orders").where_(col("o_totalprice").gt(3000.0)), "o_custkey", S("c_custkey", "c_name").from_("customer"), "c_custkey", t)


_query("rls_policy_caller", S("c_custkey", "c_mktsegment").from_("customer").where_(col("c_acctbal").gt(0.0)), "SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING'", None, "BUILDING", customer=col("c_mktsegment").eq(CALLER))
_query("rls_policy_join", S("orders.o_orderkey", "customer.c_custkey").from_("orders").left_join("customer", "orders.o_custkey", "customer.c_custkey"), "SELECT o_orderkey AS orders_o_orderkey, c_custkey AS customer_c_custkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'", None, "BUILDING", customer=col("c_mktsegment").eq(CALLER))


@_frame("sql_read_only", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def _sql(spark, d):
    return spark.sql("SELECT n_regionkey, count(*) AS n FROM {nation} GROUP BY n_regionkey", nation=_tables(spark, d).table("nation"))


# --- change log -----------------------------------------------------------------------------------------
def _log(spark, d) -> DataFrame:
    """Three commits of orders: all rows, a price rise for every third, deletion of every seventh."""
    o = _tables(spark, d).table("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    raised = o.where(F.col("o_orderkey") % 3 == 0).withColumn("o_totalprice", F.col("o_totalprice") + 1000.0)
    gone = o.where(F.col("o_orderkey") % 7 == 0)
    return changelog.changes(o, 1).union(changelog.changes(raised, 2)).union(changelog.changes(gone, 3, "D"))


_S2 = "SELECT o_orderkey, o_custkey, round(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1000 ELSE o_totalprice END, 2) AS o_totalprice FROM orders"
_QUERIES["snapshot_at_seq"], _SQL["snapshot_at_seq"] = (lambda s, d: _rounded("o_totalprice")(changelog.snapshot(_log(s, d), ["o_orderkey"], 2))), _S2
_QUERIES["snapshot_latest"], _SQL["snapshot_latest"] = (lambda s, d: _rounded("o_totalprice")(changelog.snapshot(_log(s, d), ["o_orderkey"]))), _S2 + " WHERE o_orderkey % 7 <> 0"
_QUERIES["deltas_since"] = lambda s, d: changelog.deltas(_log(s, d), 1, 3).groupBy("_seq", "_op").agg(F.count(F.lit(1)).alias("n"))
_SQL["deltas_since"] = "SELECT 2::BIGINT AS _seq, 'U' AS _op, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 3, 'D', count(*) FROM orders WHERE o_orderkey % 7 = 0"
_QUERIES["row_changes"] = lambda s, d: changelog.row_changes(_log(s, d), ["o_orderkey"], 1, 3)
_SQL["row_changes"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'Delete' ELSE 'Update' END AS kind FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 7 = 0"


@_frame("upsert_merge", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT c_custkey + 1000000000, 'new' FROM customer WHERE c_custkey % 10 = 0")
def _upsert_merge(spark, d):
    c = _tables(spark, d).table("customer").select("c_custkey", "c_mktsegment")
    p = c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "x").alias("c_mktsegment"))
    p = p.union(c.where(F.col("c_custkey") % 10 == 0).select(F.col("c_custkey") + 1_000_000_000, F.lit("new")))
    return changelog.applied(c, changelog.upsert(c, p, ["c_custkey"], "merge"), ["c_custkey"])


@_frame("on_conflict_do_update", "SELECT c_custkey, round(CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END, 2) AS c_acctbal FROM customer")
def _on_conflict(spark, d):
    c = _tables(spark, d).table("customer").select("c_custkey", "c_acctbal")
    p = c.where(F.col("c_custkey") % 5 == 0).withColumn("c_acctbal", F.lit(1.0))
    return _rounded("c_acctbal")(changelog.applied(c, changelog.upsert(c, p, ["c_custkey"], "with", {"c_acctbal": lambda old, new: old + new}), ["c_custkey"]))


@_frame("delete_where_limit", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW' ORDER BY o_orderkey LIMIT 100)")
def _delete_where(spark, d):
    o = _tables(spark, d).table("orders").select("o_orderkey", "o_orderpriority")
    gone = changelog.first_matches(o, F.col("o_orderpriority") == "5-LOW", ["o_orderkey"], 100)
    return changelog.applied(o, o.limit(0), ["o_orderkey"], gone).select("o_orderkey")


@_frame("update_where_expr", "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey + 7 ELSE o_custkey END AS o_custkey FROM orders")
def _update_where(spark, d):
    o = _tables(spark, d).table("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    new = changelog.first_matches(o, F.col("o_orderpriority") == "1-URGENT", ["o_orderkey"], None).withColumn("o_custkey", F.col("o_custkey") + 7)
    return changelog.applied(o, new, ["o_orderkey"]).select("o_orderkey", "o_custkey")


# --- keyed primitives ---------------------------------------------------------------------------------------
_QUERIES["sharded_counter_sum"] = lambda s, d: keyed.counter_totals(_tables(s, d).table("events").select(F.col("event_type").alias("key"), F.col("user_id").alias("delta")))
_SQL["sharded_counter_sum"] = "SELECT event_type AS key, CAST(sum(user_id) AS BIGINT) AS total FROM events GROUP BY event_type"
_KV = lambda s, d: _tables(s, d).table("customer").select(F.encode("c_name", "utf-8").alias("key"), "c_custkey")
_QUERIES["kv_prefix_scan"] = lambda s, d: keyed.kv_prefix(_KV(s, d), b"Customer#00001").select(F.decode("key", "utf-8").alias("k"), "c_custkey")
_SQL["kv_prefix_scan"] = "SELECT c_name AS k, c_custkey FROM customer WHERE c_name LIKE 'Customer#00001%'"
_QUERIES["kv_range_scan"] = lambda s, d: keyed.kv_range(_KV(s, d), b"Customer#000000010", b"Customer#000000900", True).select(F.decode("key", "utf-8").alias("k"), "c_custkey")
_SQL["kv_range_scan"] = "SELECT c_name AS k, c_custkey FROM customer WHERE c_name > 'Customer#000000010' AND c_name < 'Customer#000000900'"
_QUERIES["kv_get_many"] = lambda s, d: keyed.kv_get_many(_KV(s, d), [b"Customer#000000007", b"Customer#000000011"]).select(F.decode("key", "utf-8").alias("k"), "c_custkey")
_SQL["kv_get_many"] = "SELECT c_name AS k, c_custkey FROM customer WHERE c_name IN ('Customer#000000007', 'Customer#000000011')"


@_frame("queue_claim_order", "SELECT event_id AS seq, CAST(user_id % 5 AS BIGINT) AS priority FROM events WHERE event_type = 'click' ORDER BY priority DESC, seq LIMIT 20")
def _claim(spark, d):
    e = _tables(spark, d).table("events")
    jobs = e.select(F.col("event_id").alias("seq"), (F.col("user_id") % 5).alias("priority"), F.when(F.col("event_type") == "click", "ready").otherwise("done").alias("state"), F.lit(0).alias("not_before"), F.lit(0).alias("lease_until"))
    return keyed.claimable(jobs, 10, 20).select("seq", "priority")


# --- event log ------------------------------------------------------------------------------------------------
def _events(spark, d) -> DataFrame:
    e = _tables(spark, d).table("events")
    return e.select(F.floor(F.col("event_id") / 4).cast("long").alias("commit_seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_micros"), F.col("event_type").alias("topic"), F.col("event_id").cast("string").alias("event_key"), F.col("props").alias("payload"), F.col("user_id").alias("user_id"))


_EV = "(SELECT event_id // 4 AS commit_seq, epoch_us(ts) AS ts_micros, event_type AS topic, CAST(event_id AS VARCHAR) AS event_key, props AS payload, user_id FROM events)"
EQ = eventlog.EventQuery
_QUERIES["event_filter_topic_time"] = lambda s, d: eventlog.filtered(_events(s, d), EQ().topic("click").time_range(1_704_500_000_000_000, 1_705_500_000_000_000)).select("commit_seq", "event_key")
_SQL["event_filter_topic_time"] = f"SELECT commit_seq, event_key FROM {_EV} WHERE topic = 'click' AND ts_micros BETWEEN 1704500000000000 AND 1705500000000000"
_QUERIES["event_payload_field"] = lambda s, d: eventlog.filtered(_events(s, d), EQ().where_field("k", "7")).select("event_key", "topic")
_SQL["event_payload_field"] = f"SELECT event_key, topic FROM {_EV} WHERE json_extract_string(payload, '$.k') = '7'"
_QUERIES["event_commit_atomic_page"] = lambda s, d: eventlog.page(_events(s, d), EQ().topic("click").after_commit_seq(10).limit(7))[0].select("commit_seq", "event_key")
_SQL["event_commit_atomic_page"] = f"WITH e AS (SELECT * FROM {_EV} WHERE topic = 'click' AND commit_seq > 10) SELECT commit_seq, event_key FROM e WHERE commit_seq <= (SELECT max(commit_seq) FROM (SELECT commit_seq FROM e ORDER BY commit_seq LIMIT 7))"
_QUERIES["event_latest_by_topic"] = lambda s, d: eventlog.latest_by_topic(_events(s, d), "view", 5).select("commit_seq", "event_key")
_SQL["event_latest_by_topic"] = f"WITH e AS (SELECT * FROM {_EV} WHERE topic = 'view') SELECT commit_seq, event_key FROM e WHERE commit_seq >= (SELECT min(commit_seq) FROM (SELECT commit_seq FROM e ORDER BY commit_seq DESC LIMIT 5))"
_QUERIES["event_inspect_commit"] = lambda s, d: eventlog.inspect_commit(_events(s, d), 12).select("event_key", "topic")
_SQL["event_inspect_commit"] = f"SELECT event_key, topic FROM {_EV} WHERE commit_seq = 12"
_QUERIES["event_find_by_key"] = lambda s, d: eventlog.find_by_key(_events(s, d), "33").select("commit_seq", "topic")
_SQL["event_find_by_key"] = f"SELECT commit_seq, topic FROM {_EV} WHERE event_key = '33'"
_QUERIES["event_retention_keep_last"] = lambda s, d: eventlog.compact(_events(s, d), eventlog.Retention(keep_last=200), 0)[0].select("event_key")
_SQL["event_retention_keep_last"] = f"SELECT event_key FROM {_EV} ORDER BY commit_seq DESC, topic DESC, event_key DESC LIMIT 200"
_QUERIES["event_retention_floor"] = lambda s, d: eventlog.compact(_events(s, d), eventlog.Retention(processors=True), 0, 20)[0].select("event_key")
_SQL["event_retention_floor"] = f"SELECT event_key FROM {_EV} WHERE commit_seq > 20"
_QUERIES["event_log_summary"] = lambda s, d: eventlog.summary(_events(s, d))
_SQL["event_log_summary"] = f"SELECT count(*) AS n_events, min(commit_seq) AS oldest_seq, max(commit_seq) AS newest_seq FROM {_EV}"
_QUERIES["latest_per_key"] = lambda s, d: eventlog.latest_per_key(_events(s, d).select("user_id", "commit_seq", "event_key"), "user_id", ["commit_seq", "event_key"])
_SQL["latest_per_key"] = f"SELECT user_id, commit_seq, event_key FROM {_EV} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY commit_seq DESC, event_key DESC) = 1"
_QUERIES["bounded_series"] = lambda s, d: eventlog.bounded_series(_events(s, d).select("user_id", "commit_seq", "event_key"), "user_id", ["commit_seq", "event_key"], 3)
_SQL["bounded_series"] = f"SELECT user_id, commit_seq, event_key FROM {_EV} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY commit_seq DESC, event_key DESC) <= 3"


@_frame("processor_lag", f"SELECT p.processor, p.c AS checkpoint_seq, h.m AS head_seq, h.m - p.c AS lag FROM (VALUES ('a', 10::BIGINT), ('b', 100::BIGINT)) p(processor, c), (SELECT max(commit_seq) AS m FROM {_EV}) h")
def _lag(spark, d):
    return eventlog.lag(_events(spark, d), spark.createDataFrame([("a", 10), ("b", 100)], "processor string, checkpoint_seq long"))


# --- assertions, order book reads ---------------------------------------------------------------------------------
@_frame("assertion_count_sum", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS s, sum(l_quantity) > 1000 AS holds FROM lineitem WHERE l_returnflag = 'R'")
def _assertion(spark, d):
    from cairn.functions.expr import compile_assertion_filter

    t = _tables(spark, d).table("lineitem")
    return t.where(compile_assertion_filter(col("l_returnflag").eq("R"), F.col)).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("s"), (F.sum("l_quantity") > 1000).alias("holds"))


def _book(spark, d) -> DataFrame:
    """Open orders: bids from orders, asks from lineitem, one instrument per priority or line number."""
    t = _tables(spark, d)
    bids = t.table("orders").select(F.lit("bid").alias("side"), F.substring("o_orderpriority", 1, 1).cast("int").alias("instrument"), F.floor(F.col("o_totalprice") / 100).cast("long").alias("price_ticks"), F.lit(1).cast("long").alias("remaining"))
    asks = t.table("lineitem").select(F.lit("ask"), F.col("l_linenumber"), F.floor(F.col("l_extendedprice") / 10).cast("long") + 10_000, F.col("l_quantity").cast("long"))
    return bids.union(asks)


_BOOK = "(SELECT 'bid' AS side, CAST(o_orderpriority[1:1] AS INT) AS instrument, CAST(floor(o_totalprice / 100) AS BIGINT) AS price_ticks, 1 AS remaining FROM orders UNION ALL SELECT 'ask', l_linenumber, CAST(floor(l_extendedprice / 10) AS BIGINT) + 10000, CAST(l_quantity AS BIGINT) FROM lineitem)"


def _book_reads():
    from cairn.operators import orderbook

    return orderbook


_QUERIES["orderbook_depth"] = lambda s, d: _book_reads().depth(_book(s, d), 5)
_SQL["orderbook_depth"] = f"SELECT * FROM (SELECT instrument, side, price_ticks, CAST(sum(remaining) AS BIGINT) AS qty, count(*) AS orders FROM {_BOOK} GROUP BY instrument, side, price_ticks) QUALIFY row_number() OVER (PARTITION BY instrument, side ORDER BY CASE WHEN side = 'bid' THEN -price_ticks ELSE price_ticks END) <= 5"
_QUERIES["orderbook_spread"] = lambda s, d: _book_reads().spread(_book(s, d))
_SQL["orderbook_spread"] = f"SELECT instrument, max(price_ticks) FILTER (side = 'bid') AS best_bid, min(price_ticks) FILTER (side = 'ask') AS best_ask, (max(price_ticks) FILTER (side = 'bid') + min(price_ticks) FILTER (side = 'ask')) / 2.0 AS mid FROM {_BOOK} GROUP BY instrument"
_QUERIES["orderbook_match"] = lambda s, d: _book_reads().match_commands(_book_reads().sample_commands(_tables(s, d)))
