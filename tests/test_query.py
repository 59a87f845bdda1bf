import itertools
import random

import pytest
from pyspark.sql import functions as F

from cairn.functions import expr as E
from cairn.functions.expr import CALLER, col, lit
from cairn.plans import diagnostics, errors, paging
from cairn.plans.query import Query, count, lower, max_, on, sum_
from cairn.sources.tables import ParquetTables

S = Query.select


@pytest.fixture(scope="module")
def source(spark):
    users = [(i, f"u{i}", 18 + i % 50, None if i == 0 else f"u{i}@gmail.com" if i % 2 == 0 else f"u{i}@example.com") for i in range(100)]
    t = ParquetTables(spark, "/nowhere", {"users": ("id",), "orders": ("id",)})
    t.add("users", spark.createDataFrame(users, "id long, name string, age long, email string"))
    orders = [(1, "books", 30, "open"), (2, "books", 90, "open"), (3, "books", 60, "closed"), (4, "games", 110, "open"), (5, "games", 20, "open"), (6, "music", 55, "open")]
    t.add("orders", spark.createDataFrame(orders, "id long, category string, amount long, status string"))
    t.add("f", spark.createDataFrame([(1, float("nan")), (2, 1.0), (3, None)], "id long, x double"))
    return t


def got(q, source, caller=None):
    return [tuple(r) for r in lower(q, source, caller).collect()]


def test_filter_order_limit(source):
    q = S("id", "amount").from_("orders").where_(col("status").eq("open")).order_by("amount", False).limit(2)
    assert got(q, source) == [(4, 110), (2, 90)]
    q = S().from_("orders").group_by("category").aggregate(count(), sum_("amount")).having(col("sum_amount").gt(100) & col("count_star").gte(2)).where_(col("status").eq("open"))
    assert sorted(got(q, source)) == [("books", 2, 120), ("games", 2, 130)]


def test_distinct(source):
    q = S("age").from_("users").distinct()
    assert len(got(q, source)) == 50
    assert got(q.order_by("age").offset(5).limit(10), source) == [(23 + i,) for i in range(10)]


def test_computed(source):
    q = S("id").from_("orders").where_(col("id").eq(2)).compute("a", lit(10) / 3).compute("b", lit(10) / 0).compute("c", col("amount") * (2**62)).compute("d", col("amount") - 5)
    row = got(q, source)[0]
    assert row[1] == pytest.approx(10 / 3) and row[2:] == (None, None, 85)


def test_empty_aggregates(source):
    none = S().from_("orders").where_(col("id").lt(0))
    assert got(none.aggregate(count(), sum_("amount")), source) == []
    assert got(S().from_("orders").where_(col("id").eq(1)).aggregate(sum_("amount"), max_("category")), source) == [(30, "books")]


def test_nan_joins_nothing(source):
    q = S("a.id", "b.id").from_("f").alias("a").inner_join("f", "a.x", "b.x", "b")
    assert got(q, source) == [(2, 2)]


@pytest.mark.parametrize(
    ("q", "error"),
    [
        (S().from_("users").where_(col("age").eq("x")), errors.TypeMismatch),
        (S().from_("users").where_(col("nope").eq(1)), errors.ColumnNotFound),
        (S().from_("nowhere_table"), errors.TableNotFound),
        (S().from_("users").group_by("age"), errors.InvalidQuery),
        (S().from_("users").having(col("age").eq(1)), errors.InvalidQuery),
        (S().from_("users").offset(3), errors.InvalidQuery),
        (S().from_("users").where_(col("age").in_([1, None])), errors.InvalidQuery),
        (S().from_("users").aggregate(count()).compute("x", lit(1)), errors.InvalidQuery),
        (S().from_("users").inner_join("users", "users.id", "users.id"), errors.InvalidQuery),
        (S("id").from_("users").alias("a").inner_join_on("users", on("a.id", "b.id"), "b"), errors.ColumnNotFound),
        (S().from_("users").aggregate(sum_("name")), errors.TypeMismatch),
        (S().from_("users").use_index("none"), errors.IndexNotFound),
    ],
)
def test_refused(source, q, error):
    with pytest.raises(error):
        lower(q, source).collect()


def test_depth(source):
    e = col("age").eq(1)
    for _ in range(40):
        e = e & col("age").eq(1)
    with pytest.raises(errors.InvalidQuery):
        lower(S().from_("users").where_(e), source)


def holds(e, row):
    """Two-valued logic in plain Python."""
    if isinstance(e, E.And):
        return holds(e.left, row) and holds(e.right, row)
    if isinstance(e, E.Or):
        return holds(e.left, row) or holds(e.right, row)
    if isinstance(e, E.Not):
        return not holds(e.inner, row)
    v = row[e.column]
    if isinstance(e, E.IsNull):
        return (v is not None) if e.negated else v is None
    if v is None:
        return False
    if isinstance(e, E.Compare):
        return E.OPS[e.op](v, e.value)
    return v in e.values if isinstance(e, E.In) else e.low <= v <= e.high


def test_two_valued_logic(spark):
    r = random.Random(5)
    data = [dict(zip("abc", v, strict=True)) for v in itertools.product([None, 0, 1, 2], repeat=3)]
    df = spark.createDataFrame([tuple(d.values()) for d in data], "a long, b long, c long").cache()

    def make(n):
        if n == 0 or r.random() < 0.2:
            c = col(r.choice("abc"))
            return r.choice([c.eq(1), c.neq(1), c.lt(1), c.gte(1), c.in_([0, 2]), c.between(0, 1), c.is_null(), c.is_not_null()])
        return r.choice([lambda: ~make(n - 1), lambda: make(n - 1) & make(n - 1), lambda: make(n - 1) | make(n - 1)])()

    exprs = [make(4) for _ in range(60)]
    kept = df.select("a", "b", "c", *(F.coalesce(E.compile_predicate(e, F.col), F.lit(False)).alias(f"e{i}") for i, e in enumerate(exprs))).collect()
    for row in kept:
        for i, e in enumerate(exprs):
            assert row[f"e{i}"] == holds(e, row.asDict()), e


def test_pages_cover_everything(source):
    for up in (True, False):
        q, seen, token = S("id", "email").from_("users").order_by("email", up).limit(7), [], None
        while True:
            page = paging.execute_page(q, source, cursor=token, policy=paging.Policy(key=b"k"))
            seen += [r["id"] for r in page.rows]
            token = page.cursor
            if token is None:
                break
        assert sorted(seen) == list(range(100)) and seen == [r["id"] for r in lower(S("id").from_("users").order_by("email", up).order_by("id"), source).collect()]


def test_cursor_is_checked(source):
    page = paging.execute_page(S("id").from_("users").limit(5), source, policy=paging.Policy(key=b"k"))
    for key, seq, token in ((b"other", 0, page.cursor), (b"k", 9, page.cursor), (b"k", 0, "zz")):
        with pytest.raises(errors.InvalidCursor):
            paging.execute_page(S("id").from_("users").limit(5), source, cursor=token, policy=paging.Policy(key=key), seq=seq)
    assert len(paging.execute_page(S("id").from_("users"), source).rows) == 100
    with pytest.raises(errors.ScanBoundExceeded):
        paging.execute_page(S("id").from_("users"), source, policy=paging.Policy(allow_full_scan=False))


def test_totals_exist_hydrate(source):
    page, total = paging.list_with_total(S("id").from_("users").where_(col("age").lt(20)).limit(2), source)
    assert len(page.rows) == 2 and total == 4 and page.truncated
    assert paging.exists(S().from_("users").where_(col("id").eq(3)), source) and not paging.exists(S().from_("users").where_(col("id").eq(300)), source)
    assert paging.index_rank(source.table("orders"), ["amount"], ["id"], [3]).first()[0] == 3


def test_policy(source):
    source.policies["orders"] = col("status").eq(CALLER)
    try:
        assert len(got(S().from_("orders"), source, "closed")) == 1
        with pytest.raises(errors.PermissionDenied):
            lower(S().from_("orders"), source)
    finally:
        source.policies.clear()


def test_diagnostics(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 7 as k", "cast(id as string) as s").write.parquet(str(tmp_path / "t.parquet"))
    t = ParquetTables(spark, str(tmp_path), {"t": ("id",)})
    d = diagnostics.explain(S("id").from_("t").where_(col("k").eq(3) & ~col("id").eq(5)), t)
    assert d.access_path == "filtered_scan" and "EqualTo(k,3)" in d.pushed_filters and d.columns_read == ["id", "k"] and d.exchanges == 0
    assert diagnostics.explain(S().from_("t").where_(col("id").eq(5)), t).access_path == "primary_key_lookup"
    assert "TakeOrderedAndProject" in diagnostics.explain(S("id").from_("t").order_by("k").limit(3), t).plan
