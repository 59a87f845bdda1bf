import pytest

from cairn.operators import orderbook as ob


def order(i, side, price, qty, **more):
    return {"action": "new", "order_id": i, "owner": f"o{i}", "client_id": None, "nonce": None, "side": side, "type": "limit", "tif": "gtc", "post_only": False, "stp": None, "price_ticks": price, "price_high": None, "qty": qty, "target": None, **more}


def run(book, *commands):
    return [r for c in commands for r in book.run(c)]


def test_price_time_priority():
    b = ob.Book()
    out = run(b, order(1, "ask", 101, 5), order(2, "ask", 100, 5), order(3, "ask", 100, 5), order(4, "bid", 101, 12))
    assert [(r[6], r[3], r[5]) for r in out if r[1] == "trade"] == [(2, 5, 100), (3, 5, 100), (1, 2, 101)]
    assert b.orders[1]["remaining"] == 3 and b.best("bid") is None and b.best("ask") == 101


@pytest.mark.parametrize(
    ("c", "why"),
    [
        (order(9, "bid", 100, 1, post_only=True), "would_cross"),
        (order(9, "bid", 100, 9, tif="fok"), "fill_or_kill"),
        (order(9, "bid", 100, 0), "quantity"),
        (order(9, "ask", None, 1, type="market"), "no_liquidity"),
        (order(9, "bid", None, 1, type="market", post_only=True), "post_only_market"),
        (order(9, "bid", 500, 1), "price"),
    ],
)
def test_refused(c, why):
    b = ob.Book(ob.Config(high=200))
    run(b, order(1, "ask", 100, 5))
    (r,) = run(b, c)
    assert r[1] == "rejected" and r[7] == why and b.orders[1]["remaining"] == 5


def test_self_trade():
    for stp, maker, taker in (("cancel_resting", "cancelled", "open"), ("cancel_aggressor", "open", "cancelled"), ("cancel_both", "cancelled", "cancelled")):
        b = ob.Book()
        run(b, order(1, "ask", 100, 5, owner="x"), order(2, "bid", 100, 5, owner="x", stp=stp))
        assert (b.orders[1]["status"], b.orders[2]["status"]) == (maker, taker)


def test_ioc_cancel_replace_reduce_mass():
    b = ob.Book()
    run(b, order(1, "ask", 100, 5), order(2, "bid", 100, 8, tif="ioc"))
    assert b.orders[2]["status"] == "cancelled" and b.orders[2]["remaining"] == 3
    run(b, order(3, "bid", 90, 5, owner="x"), order(4, "bid", 90, 5, owner="y"), order(3, "bid", 90, 4, action="replace", target=3, owner="x"))
    assert list(b.levels["bid"][90]) == [3, 4]  # smaller keeps its place
    run(b, order(3, "bid", 90, 9, action="replace", target=3, owner="x"))
    assert list(b.levels["bid"][90]) == [4, 3]
    (r,) = run(b, order(0, "bid", 90, 1, action="cancel", target=4, owner="x"))
    assert r[7] == "permission_denied"
    run(b, order(0, "bid", None, 9, action="reduce", target=3, owner="x"))
    assert b.orders[3]["status"] == "cancelled"
    run(b, order(0, None, None, None, action="mass_cancel", owner="y"))
    assert b.best("bid") is None


def test_replace_reduce_and_mass_cancel_keep_the_rules():
    b = ob.Book(ob.Config(lot=2, low=50, high=200))
    run(b, order(1, "bid", 100, 10), order(2, "bid", 120, 10), order(3, "ask", 150, 10))
    bad = [order(1, None, 100, -8, action="replace", target=1), order(1, None, 9999, 8, action="replace", target=1), order(1, None, None, 3, action="replace", target=1), order(1, None, None, -4, action="reduce", target=1), order(1, None, None, None, action="reduce", target=1), order(1, "bid", 100, 2)]
    assert [r[7] for r in run(b, *bad)] == ["quantity", "price", "quantity", "quantity", "quantity", "order_id"] and b.orders[1]["remaining"] == 10
    out = run(b, order(0, None, 100, None, action="mass_cancel", owner=None, price_high=110))
    assert [r[0] for r in out] == [1] and b.best("bid") == 120 and b.best("ask") == 150
    with pytest.raises(ValueError):
        run(b, order(0, None, None, None, action="price_allowed"))


def test_books_in_commits(spark, tmp_path):
    import random

    from cairn.plans import errors
    from cairn.sources import book as B
    from cairn.sources.store import Engine

    e = Engine(spark, str(tmp_path / "db"))
    with pytest.raises(errors.NotFound):
        e.commit({"kind": "order_book", "commands": [order(1, "bid", 100, 1) | {"instrument": "x"}]})
    e.commit({"kind": "book_instrument", "instrument": "x", "low": 50, "high": 200}, {"kind": "book_instrument", "instrument": "y", "lot": 2})
    r, plain = random.Random(8), {"x": ob.Book(ob.Config(low=50, high=200)), "y": ob.Book(ob.Config(lot=2))}
    want = {"x": [], "y": []}
    for batch in range(3):
        commands = []
        for i in range(batch * 12, batch * 12 + 12):
            c = order(i, r.choice(["bid", "ask"]), r.randrange(95, 105), r.randrange(1, 5) * 2, owner=f"o{i % 3}", client_id=f"c{i}" if i % 4 == 0 else None, nonce=i if i % 5 == 0 else None)
            if i % 6 == 5:
                c = order(i, None, 99, 4, action=r.choice(["cancel", "replace", "reduce"]), target=r.randrange(i), owner=f"o{r.randrange(3)}")
            commands.append({"instrument": r.choice("xy"), **c})
        e.commit({"kind": "order_book", "commands": commands}, {"kind": "kv_set", "key": b"batch", "value": b"%d" % batch})
        for c in commands:
            want[c["instrument"]] += plain[c["instrument"]].run(c)
    v = e.view()
    for name in "xy":
        got = v.table(B.REPORTS).where(f"instrument = '{name}'").orderBy("seq", "n").collect()
        assert [tuple(x)[3:] for x in got] == want[name]
        live = {x["order_id"]: (x["remaining"], x["price_ticks"]) for x in ob.open_orders(v.table(B.ORDERS)).where(f"instrument = '{name}'").collect()}
        assert live == {o["order_id"]: (o["remaining"], o["price_ticks"]) for s in plain[name].levels.values() for lv in s.values() for o in lv.values()}
    head, depth = e.head, ob.depth(ob.open_orders(v.table(B.ORDERS)), 3).count()
    with pytest.raises(errors.ValidationError):  # refused as a whole
        e.commit({"kind": "kv_del", "key": b"batch"}, {"kind": "order_book", "strict": True, "commands": [order(900, "bid", 100, 3) | {"instrument": "y"}]})
    with pytest.raises(errors.AssertionFailed):
        e.commit({"kind": "order_book", "commands": [order(901, "bid", 100, 2) | {"instrument": "y"}]}, assertions=[{"kind": "key_exists", "key": b"none"}])
    assert e.head == head and ob.depth(ob.open_orders(e.view().table(B.ORDERS)), 3).count() == depth
    e.commit({"kind": "order_book", "commands": [order(0, None, None, 1, action="halt") | {"instrument": "x"}]})
    e.commit({"kind": "order_book", "commands": [order(902, "bid", 100, 2) | {"instrument": "x"}]})
    assert ob.last_report(e.view().table(B.REPORTS), "x").first()["reason"] == "halted"
    e.commit({"kind": "book_instrument", "instrument": "x", "drop": True})
    assert e.view().table(B.ORDERS).where("instrument = 'x'").isEmpty() and not e.view().table(B.ORDERS).isEmpty()
    with pytest.raises(errors.ValidationError):
        e.commit({"kind": "upsert", "table": B.OWNERS, "rows": []})


def test_nonce_client_halt():
    b = ob.Book()
    run(b, order(1, "bid", 90, 1, nonce=5, owner="x", client_id="c"))
    out = run(b, order(2, "bid", 90, 1, nonce=5, owner="x"), order(3, "bid", 90, 1, owner="x", client_id="c"), order(0, None, None, 1, action="halt"), order(4, "bid", 90, 1))
    assert [r[7] for r in out] == ["nonce", "client_id", None, "halted"]


def test_distributed_equals_single(spark):
    import random

    r = random.Random(42)
    cmds = []
    for i in range(300):
        inst = f"i{r.randrange(3)}"
        c = order(i, r.choice(["bid", "ask"]), r.randrange(90, 110), r.randrange(1, 9)) if r.random() < 0.8 or not i else order(i, None, None, None, action="cancel", target=r.randrange(i), owner=f"o{r.randrange(i)}")
        cmds.append({"instrument": inst, "seq": i, **c})
    names = [x.split()[0] for x in ob.COMMANDS.split(", ")]
    df = spark.createDataFrame([tuple(c[n] for n in names) for c in cmds], ob.COMMANDS).repartition(4)
    got = sorted((tuple(x) for x in ob.match_commands(df).collect()), key=repr)
    books = {f"i{k}": ob.Book() for k in range(3)}
    want = sorted(((c["instrument"], c["seq"], *x) for c in cmds for x in books[c["instrument"]].run(c)), key=repr)
    assert got == want
    final = ob.match_commands(df, final_orders=True)
    assert ob.open_orders(final).count() == sum(len(lv) for b in books.values() for s in b.levels.values() for lv in s.values())
    for b in books.values():
        assert b.best("bid") is None or b.best("ask") is None or b.best("bid") < b.best("ask")


def test_a_spilled_book_does_what_a_book_in_memory_does(monkeypatch):
    import random

    monkeypatch.setattr(ob.SpilledBook, "CHUNK", 3)
    for seed in range(12):
        r = random.Random(seed)
        rules = {"low": 90, "band": r.choice([None, 2]), "lot": r.choice([1, 2])}
        plain, spilled = ob.Book(ob.Config(**rules)), ob.SpilledBook(ob.Config(**rules))
        for i in range(400):
            owner = r.choice(["o1", "o2", "0", "", None])
            c = order(r.randrange(250), r.choice(["bid", "ask"]), r.randrange(88, 112), r.randrange(0, 9), owner=owner, client_id=r.choice([None, "", "c", f"c{i}"]), nonce=r.choice([None, None, i, i // 2]), tif=r.choice(["gtc", "gtc", "ioc", "fok"]), type=r.choice(["limit"] * 5 + ["market"]), post_only=r.random() < 0.1, stp=r.choice([None, "none", "cancel_resting", "cancel_aggressor", "cancel_both"]))
            action = r.choice(["new"] * 12 + ["cancel", "replace", "reduce", "match", "mass_cancel", "halt"])
            if action in ("cancel", "replace", "reduce", "match"):
                known = r.choice(list(plain.orders.values())) if plain.orders and r.random() < 0.8 else None
                c |= {"action": action, "target": known["order_id"] if known and r.random() < 0.9 else None} | ({"owner": known["owner"], "client_id": known["client_id"]} if known else {})
            elif action == "mass_cancel":
                c |= {"action": action, "owner": r.choice([None, owner]), "side": r.choice([None, "bid"]), "price_ticks": r.choice([None, 99])}
            elif action == "halt":
                c |= {"action": action, "qty": int(r.random() < 0.2)}
            assert list(plain.run(c)) == list(spilled.run(c)), c
            assert (plain.best("bid"), plain.best("ask")) == (spilled.best("bid"), spilled.best("ask"))
        assert list(spilled.states()) == [{k: o[k] for k in ob.SpilledBook._COLUMNS} for o in plain.orders.values()]
        spilled.close()


def test_a_spilled_book_holds_no_orders_in_python():
    import tracemalloc

    def held(book):
        tracemalloc.start()
        for i in range(20_000):
            list(book.run(order(i, "bid", 90 + i % 50, 5, nonce=i)))
        size = tracemalloc.get_traced_memory()[0]
        tracemalloc.stop()
        return size

    assert held(ob.Book()) > 5_000_000 and held(ob.SpilledBook()) < 500_000


def test_instruments_that_share_a_task(spark):
    rows = [(f"i{k % 5}" if k % 5 else None, k) for k in range(60)]
    names = [x.split()[0] for x in ob.COMMANDS.split(", ")]
    cmds = [{"instrument": i, "seq": k if k < 55 else None, **order((1 << 60) + k, "bid" if k % 2 else "ask", 100, 3)} for i, k in rows]
    df = spark.createDataFrame([tuple(c[n] for n in names) for c in cmds], ob.COMMANDS).coalesce(1)
    got = sorted((tuple(x) for x in ob.match_commands(df).where("seq is not null").collect()), key=repr)
    books: dict = {}
    want = sorted(((c["instrument"], c["seq"], *x) for c in cmds if c["seq"] is not None for x in books.setdefault(c["instrument"], ob.Book()).run(c)), key=repr)
    assert got == want and ob.match_commands(df, final_orders=True).count() == 60
