"""A limit order book: sequential matching per instrument, and reads of open orders."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def depth(open_orders: DataFrame, levels: int) -> DataFrame:
    """The best price levels of each side, with quantity and number of orders."""
    at = open_orders.groupBy("instrument", "side", "price_ticks").agg(F.sum("remaining").alias("qty"), F.count(F.lit(1)).alias("orders"))
    best = F.when(F.col("side") == "bid", -F.col("price_ticks")).otherwise(F.col("price_ticks"))
    w = Window.partitionBy("instrument", "side").orderBy(best)
    return at.withColumn("_level", F.row_number().over(w)).where(F.col("_level") <= levels).drop("_level")


def spread(open_orders: DataFrame) -> DataFrame:
    bid, ask = F.max(F.when(F.col("side") == "bid", F.col("price_ticks"))), F.min(F.when(F.col("side") == "ask", F.col("price_ticks")))
    return open_orders.groupBy("instrument").agg(bid.alias("best_bid"), ask.alias("best_ask")).withColumn("mid", (F.col("best_bid") + F.col("best_ask")).cast("double") / 2)


# --- matching ------------------------------------------------------------------------------------

COMMANDS = "instrument string, seq long, action string, order_id long, owner string, client_id string, nonce long, side string, type string, tif string, post_only boolean, stp string, price_ticks long, price_high long, qty long, target long"
REPORTS = "instrument string, seq long, order_id long, kind string, status string, filled long, remaining long, price_ticks long, maker_id long, reason string"
BATCH = 10_000  # rows that go back to Spark at once
STATE = "instrument string, order_id long, owner string, client_id string, side string, price_ticks long, remaining long, placed_seq long, status string"


class Config:
    """Trading rules of an instrument."""

    def __init__(self, lot: int = 1, low: int | None = None, high: int | None = None, band: int | None = None, halted: bool = False):
        self.lot, self.low, self.high, self.band, self.halted = lot, low, high, band, halted


class Book:
    """Price-time priority for one instrument. Commands come in order; every one yields reports."""

    ACTIONS = ("new", "cancel", "replace", "reduce", "mass_cancel", "match", "halt")

    def __init__(self, config: Config | None = None):
        self.config = config or Config()
        self.orders: dict[int, dict] = {}
        self.levels: dict[str, dict[int, dict[int, dict]]] = {"bid": {}, "ask": {}}
        # Prices by rank, best first; those whose level has gone are dropped when they come up.
        self.ranked: dict[str, list[int]] = {"bid": [], "ask": []}
        self.nonces: dict[str, int] = {}
        self.clients: dict[tuple[str, str], int] = {}
        self.placed = 0

    # What is held, and how it changes: SpilledBook keeps the same in a database.
    def best(self, side: str) -> int | None:
        level, ranked, sign = self.levels[side], self.ranked[side], -1 if side == "bid" else 1
        while ranked and sign * ranked[0] not in level:
            heappop(ranked)
        return sign * ranked[0] if ranked else None

    def _at_level(self, o: dict) -> None:
        level = self.levels[o["side"]]
        if o["price_ticks"] not in level:
            heappush(self.ranked[o["side"]], (-1 if o["side"] == "bid" else 1) * o["price_ticks"])
        level.setdefault(o["price_ticks"], {})[o["order_id"]] = o

    def _first(self, side: str, price: int) -> dict:
        return next(iter(self.levels[side][price].values()))

    def _known(self, order_id: int) -> bool:
        return order_id in self.orders

    def _client(self, owner: str, client_id: str) -> int | None:
        return self.clients.get((owner, client_id))

    def _nonce(self, owner: str) -> int:
        return self.nonces.get(owner, -1)

    def _accept(self, o: dict, nonce: int | None) -> None:
        if nonce is not None:
            self.nonces[o["owner"]] = nonce
        self.orders[o["order_id"]] = o
        if o["client_id"]:
            self.clients[o["owner"], o["client_id"]] = o["order_id"]

    def _keep(self, o: dict) -> None:
        """Called when an order's price, quantity or status has changed."""

    def _all_open(self) -> Iterable[dict]:
        """In the order in which they came."""
        return [x for x in self.orders.values() if self._open(x["order_id"])]

    def _remaining(self, side: str, price: int | None) -> Iterable[int]:
        """Of the orders of a side that an order of the other side at that price would meet."""
        return (o["remaining"] for p, level in self.levels[side].items() if self.crosses("ask" if side == "bid" else "bid", price, p) for o in level.values())

    def _rest(self, o: dict) -> None:
        self.placed += 1
        o["placed_seq"] = self.placed
        self._at_level(o)

    def restore(self, o: dict) -> None:
        """Takes over an order from an earlier state; open ones must come in order of placed_seq."""
        self.orders[o["order_id"]] = o
        if o["client_id"]:
            self.clients[o["owner"], o["client_id"]] = o["order_id"]
        if self._open(o["order_id"]):
            self._at_level(o)

    def _take_off(self, o: dict) -> None:
        level = self.levels[o["side"]].get(o["price_ticks"], {})
        level.pop(o["order_id"], None)
        if not level:
            self.levels[o["side"]].pop(o["price_ticks"], None)

    def _open(self, order_id) -> dict | None:
        o = self.orders.get(order_id)
        return o if o and o["status"] in ("open", "partially_filled") else None

    @staticmethod
    def crosses(side: str, price: int | None, other: int) -> bool:
        return price is None or (other <= price if side == "bid" else other >= price)

    def price_allowed(self, price: int | None) -> bool:
        low, high = self.config.low, self.config.high
        return price is not None and price > 0 and (low is None or price >= low) and (high is None or price <= high)

    def _refusal(self, c: dict) -> str | None:
        cfg, other = self.config, "ask" if c["side"] == "bid" else "bid"
        price = None if c["type"] == "market" else c["price_ticks"]
        if cfg.halted:
            return "halted"
        if not c["qty"] or c["qty"] <= 0 or c["qty"] % cfg.lot:
            return "quantity"
        if c["type"] == "market" and c["post_only"]:
            return "post_only_market"
        if c["type"] != "market" and not self.price_allowed(price):
            return "price"
        if c["order_id"] is None or self._known(c["order_id"]):
            return "order_id"
        if c["nonce"] is not None and c["nonce"] <= self._nonce(c["owner"]):
            return "nonce"
        if c["client_id"] and self._client(c["owner"], c["client_id"]) is not None:
            return "client_id"
        best = self.best(other)
        if c["post_only"] and best is not None and self.crosses(c["side"], price, best):
            return "would_cross"
        if c["type"] == "market" and best is None:
            return "no_liquidity"
        if c["tif"] == "fok" and self._liquidity(c["side"], price) < c["qty"]:
            return "fill_or_kill"
        return None

    def _limit(self, side: str, price: int | None) -> int | None:
        """A market order goes no further than the band around the best price."""
        best = self.best("ask" if side == "bid" else "bid")
        if price is None and self.config.band is not None and best is not None:
            return best + self.config.band if side == "bid" else best - self.config.band
        return price

    def _liquidity(self, side: str, price: int | None) -> int:
        price, other = self._limit(side, price), "ask" if side == "bid" else "bid"
        return sum(self._remaining(other, price))

    def new(self, c: dict):
        why = self._refusal(c)
        if why:
            yield c["order_id"], "rejected", "rejected", 0, c["qty"] or 0, c["price_ticks"], None, why
            return
        o = {k: c[k] for k in ("order_id", "owner", "client_id", "side", "price_ticks")} | {"remaining": c["qty"], "status": "open", "placed_seq": None}
        self._accept(o, c["nonce"])
        other, price, filled = "ask" if c["side"] == "bid" else "bid", self._limit(c["side"], None if c["type"] == "market" else c["price_ticks"]), 0
        killed = False
        while o["remaining"] and not killed:
            best = self.best(other)
            if best is None or not self.crosses(c["side"], price, best):
                break
            maker = self._first(other, best)
            if maker["owner"] == o["owner"] and c["stp"] not in (None, "none"):
                if c["stp"] in ("cancel_resting", "cancel_both"):
                    self._take_off(maker)
                    maker["status"] = "cancelled"
                    self._keep(maker)
                    yield maker["order_id"], "cancelled", "cancelled", 0, maker["remaining"], best, None, "self_trade"
                killed = c["stp"] in ("cancel_aggressor", "cancel_both")
                continue
            n = min(o["remaining"], maker["remaining"])
            o["remaining"] -= n
            maker["remaining"] -= n
            filled += n
            maker["status"] = "partially_filled" if maker["remaining"] else "filled"
            if not maker["remaining"]:
                self._take_off(maker)
            self._keep(maker)
            yield o["order_id"], "trade", maker["status"], n, maker["remaining"], best, maker["order_id"], None
        if not o["remaining"]:
            o["status"] = "filled"
        elif killed or c["type"] == "market" or c["tif"] in ("ioc", "fok"):
            o["status"] = "cancelled"
        else:
            o["status"] = "partially_filled" if filled else "open"
            self._rest(o)
        self._keep(o)
        yield o["order_id"], "done", o["status"], filled, o["remaining"], c["price_ticks"], None, "self_trade" if killed else None

    def _own(self, c: dict):
        target = c["target"] if c["target"] is not None else self._client(c["owner"], c["client_id"])
        o = self._open(target)
        if o is None:
            return None, "unknown"
        return (o, None) if o["owner"] == c["owner"] else (None, "permission_denied")

    def cancel(self, c: dict):
        o, why = self._own(c)
        if o is None:
            yield c["target"], "ignored" if why == "unknown" else "rejected", "none", 0, 0, None, None, why
            return
        self._take_off(o)
        o["status"] = "cancelled"
        self._keep(o)
        yield o["order_id"], "cancelled", "cancelled", 0, o["remaining"], o["price_ticks"], None, None

    def replace(self, c: dict):
        """A new price or a larger quantity loses priority; it does not match again."""
        o, why = self._own(c)
        if o is not None and (not c["qty"] or c["qty"] < 0 or c["qty"] % self.config.lot):
            why = "quantity"
        elif o is not None and c["price_ticks"] is not None and not self.price_allowed(c["price_ticks"]):
            why = "price"
        elif o is not None and self.config.halted:
            why = "halted"
        if why:
            yield c["target"], "rejected", "none", 0, 0, None, None, why
            return
        if c["tif"] in ("ioc", "fok"):
            yield from self.cancel(c)
            return
        price = c["price_ticks"] if c["price_ticks"] is not None else o["price_ticks"]
        if price != o["price_ticks"] or c["qty"] > o["remaining"]:
            self._take_off(o)
            o["price_ticks"], o["remaining"] = price, c["qty"]
            self._rest(o)
        else:
            o["remaining"] = c["qty"]
        self._keep(o)
        yield o["order_id"], "replaced", o["status"], 0, o["remaining"], price, None, None

    def reduce(self, c: dict):
        o, why = self._own(c)
        if o is not None and (not c["qty"] or c["qty"] < 0 or c["qty"] % self.config.lot):
            why = "quantity"
        if why:
            yield c["target"], "rejected", "none", 0, 0, None, None, why
            return
        o["remaining"] = max(0, o["remaining"] - c["qty"])
        if not o["remaining"]:
            self._take_off(o)
            o["status"] = "cancelled"
        self._keep(o)
        yield o["order_id"], "reduced", o["status"], 0, o["remaining"], o["price_ticks"], None, None

    def mass_cancel(self, c: dict):
        """Open orders of an owner, a side and prices from price_ticks to price_high, each if given."""
        for o in self._all_open():
            if (c["owner"] is None or o["owner"] == c["owner"]) and (c["side"] is None or o["side"] == c["side"]) and (c["price_ticks"] is None or o["price_ticks"] >= c["price_ticks"]) and (c["price_high"] is None or o["price_ticks"] <= c["price_high"]):
                self._take_off(o)
                o["status"] = "cancelled"
                self._keep(o)
                yield o["order_id"], "cancelled", "cancelled", 0, o["remaining"], o["price_ticks"], None, "mass"

    def match(self, c: dict):
        """A fill decided elsewhere, between two open orders of opposite sides."""
        a, b = self._open(c["order_id"]), self._open(c["target"])
        if a is None or b is None or a["side"] == b["side"] or not c["qty"] or c["qty"] <= 0 or c["qty"] > min(a["remaining"], b["remaining"]):
            yield c["order_id"], "rejected", "none", 0, 0, c["price_ticks"], c["target"], "match"
            return
        for o in (a, b):
            o["remaining"] -= c["qty"]
            o["status"] = "partially_filled" if o["remaining"] else "filled"
            if not o["remaining"]:
                self._take_off(o)
            self._keep(o)
        yield a["order_id"], "trade", b["status"], c["qty"], b["remaining"], c["price_ticks"], b["order_id"], None

    def halt(self, c: dict):
        self.config.halted = bool(c["qty"])
        yield None, "halted" if self.config.halted else "resumed", "none", 0, 0, None, None, None

    def run(self, c: dict):
        if c["action"] not in self.ACTIONS:
            raise ValueError(f"no order action {c['action']}")
        yield from getattr(self, c["action"])(c)


class SpilledBook(Book):
    """The same with what it holds in a temporary database of SQLite: up to CACHE_KB in memory, the rest in a file without a name
    that goes with the book. Every order is remembered, since its id and its client's are not taken again."""

    CACHE_KB, CHUNK = 32_768, 1_000
    _COLUMNS = ("order_id", "owner", "client_id", "side", "price_ticks", "remaining", "placed_seq", "status")

    def __init__(self, config: Config | None = None):
        super().__init__(config)
        self.db = sqlite3.connect("", isolation_level=None)
        for text in (
            f"PRAGMA cache_size = -{self.CACHE_KB}",
            "PRAGMA journal_mode = OFF",
            "PRAGMA synchronous = OFF",
            "CREATE TABLE orders (order_id INTEGER PRIMARY KEY, owner, client_id, side, price_ticks, remaining, placed_seq, status, arrived INTEGER)",
            # rank: the price, negative for bids, so that the best comes first.
            "CREATE TABLE queue (side, rank INTEGER, placed_seq INTEGER, order_id INTEGER, PRIMARY KEY (side, rank, placed_seq)) WITHOUT ROWID",
            "CREATE TABLE arrivals (arrived INTEGER PRIMARY KEY, order_id INTEGER)",
            "CREATE TABLE clients (owner, client_id, order_id INTEGER, PRIMARY KEY (owner, client_id)) WITHOUT ROWID",
            "CREATE TABLE nonces (owner PRIMARY KEY, nonce INTEGER) WITHOUT ROWID",
        ):
            self.db.execute(text)
        # Never committed, so that pages go to the file only when the cache is full.
        self.db.execute("BEGIN")
        self.arrived, self.top = 0, {}

    @staticmethod
    def _rank(o: dict) -> int:
        return -o["price_ticks"] if o["side"] == "bid" else o["price_ticks"]

    @staticmethod
    def _owner(owner: str | None) -> str | int:
        return 0 if owner is None else owner  # a key column takes no null; 0 equals no text

    def _one(self, text: str, *values):
        return self.db.execute(text, values).fetchone()

    def _order(self, row) -> dict:
        return dict(zip(self._COLUMNS, row, strict=True))

    def best(self, side: str) -> int | None:
        if side not in self.top:
            row = self._one("SELECT rank FROM queue WHERE side = ? ORDER BY rank, placed_seq LIMIT 1", side)
            self.top[side] = None if row is None else -row[0] if side == "bid" else row[0]
        return self.top[side]

    def _first(self, side: str, price: int) -> dict:
        (i,) = self._one("SELECT order_id FROM queue WHERE side = ? AND rank = ? ORDER BY placed_seq LIMIT 1", side, -price if side == "bid" else price)
        return self._open(i)

    def _at_level(self, o: dict) -> None:
        side, price = o["side"], o["price_ticks"]
        if side in self.top and (self.top[side] is None or (price > self.top[side] if side == "bid" else price < self.top[side])):
            self.top[side] = price
        self.db.execute("INSERT INTO queue VALUES (?, ?, ?, ?)", (o["side"], self._rank(o), o["placed_seq"], o["order_id"]))

    def _take_off(self, o: dict) -> None:
        if self.top.get(o["side"]) == o["price_ticks"]:
            del self.top[o["side"]]
        self.db.execute("DELETE FROM queue WHERE side = ? AND rank = ? AND placed_seq = ?", (o["side"], self._rank(o), o["placed_seq"]))

    def _known(self, order_id: int) -> bool:
        return self._one("SELECT 1 FROM orders WHERE order_id = ?", order_id) is not None

    def _client(self, owner: str, client_id: str) -> int | None:
        row = self._one("SELECT order_id FROM clients WHERE owner = ? AND client_id = ?", self._owner(owner), client_id)
        return None if row is None else row[0]

    def _nonce(self, owner: str) -> int:
        row = self._one("SELECT nonce FROM nonces WHERE owner = ?", self._owner(owner))
        return -1 if row is None else row[0]

    def _accept(self, o: dict, nonce: int | None) -> None:
        self.arrived += 1
        if nonce is not None:
            self.db.execute("INSERT OR REPLACE INTO nonces VALUES (?, ?)", (self._owner(o["owner"]), nonce))
        self.db.execute("INSERT INTO orders VALUES (?, ?, ?, ?, ?, ?, ?, ?, ?)", (*(o[c] for c in self._COLUMNS), self.arrived))
        self.db.execute("INSERT INTO arrivals VALUES (?, ?)", (self.arrived, o["order_id"]))
        if o["client_id"]:
            self.db.execute("INSERT INTO clients VALUES (?, ?, ?)", (self._owner(o["owner"]), o["client_id"], o["order_id"]))

    def _keep(self, o: dict) -> None:
        self.db.execute("UPDATE orders SET price_ticks = ?, remaining = ?, placed_seq = ?, status = ? WHERE order_id = ?", (o["price_ticks"], o["remaining"], o["placed_seq"], o["status"], o["order_id"]))

    def _open(self, order_id) -> dict | None:
        row = self._one(f"SELECT {', '.join(self._COLUMNS)} FROM orders WHERE order_id = ?", order_id)
        return self._order(row) if row and row[-1] in ("open", "partially_filled") else None

    def states(self) -> Iterator[dict]:
        """Every order, in the order in which they came; may be changed meanwhile."""
        for at in range(0, self.arrived, self.CHUNK):
            yield from map(self._order, self.db.execute(f"SELECT {', '.join('o.' + c for c in self._COLUMNS)} FROM arrivals a JOIN orders o USING (order_id) WHERE a.arrived > ? AND a.arrived <= ? ORDER BY a.arrived", (at, at + self.CHUNK)).fetchall())

    def _all_open(self) -> Iterable[dict]:
        return (o for o in self.states() if o["status"] in ("open", "partially_filled"))

    def _remaining(self, side: str, price: int | None) -> Iterable[int]:
        rank = (1 << 63) - 1 if price is None else -price if side == "bid" else price
        return (r for (r,) in self.db.execute("SELECT o.remaining FROM queue q JOIN orders o USING (order_id) WHERE q.side = ? AND q.rank <= ?", (side, rank)))

    def close(self) -> None:
        self.db.close()


def _schema(text: str):
    import pyarrow as pa

    return pa.schema([(n, {"string": pa.string(), "long": pa.int64()}[t]) for n, t in (x.split() for x in text.split(", "))])


def match_commands(commands: DataFrame, configs: dict[str, dict] | None = None, final_orders: bool = False, book: type[SpilledBook] = SpilledBook) -> DataFrame:
    """Runs each instrument's commands in order of seq. An instrument is sequential by nature; instruments run in parallel.

    Commands are sorted by Spark and stream through their book, which holds no more than its cache in memory."""
    configs, text = configs or {}, STATE if final_orders else REPORTS

    def run(batches):
        import pyarrow as pa

        schema, open_book, out = _schema(text), [], []
        width = len(schema)

        def full(least: int):
            while len(out) >= least:
                part = out[:BATCH]
                del out[:BATCH]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], schema.field(i).type) for i in range(width)], schema=schema)

        def end():
            if open_book:
                name, b = open_book.pop()
                if final_orders:
                    for o in b.states():
                        out.append((name, *(o[k] for k in ("order_id", "owner", "client_id", "side", "price_ticks", "remaining", "placed_seq", "status"))))
                        yield from full(BATCH)
                b.close()

        for batch in batches:
            for c in batch.to_pylist():
                name = c["instrument"]
                if not open_book or open_book[0][0] != name:
                    yield from end()
                    open_book.append((name, book(Config(**configs.get(name, {})))))
                for r in open_book[0][1].run(c):
                    if not final_orders:
                        out.append((name, c["seq"], *r))
                        yield from full(BATCH)
        yield from end()
        yield from full(1)

    return commands.repartition("instrument").sortWithinPartitions("instrument", F.col("seq").asc_nulls_last()).mapInArrow(run, text)


def open_orders(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("status").isin("open", "partially_filled"))


def recent_trades(reports: DataFrame, instrument: str, n: int) -> DataFrame:
    """The last n trades, oldest first."""
    return reports.where((F.col("instrument") == instrument) & (F.col("kind") == "trade")).orderBy(F.col("seq").desc()).limit(n).orderBy("seq")


def order_status(orders: DataFrame, order_id: int) -> DataFrame:
    return orders.where(F.col("order_id") == order_id)


def last_report(reports: DataFrame, instrument: str) -> DataFrame:
    return reports.where(F.col("instrument") == instrument).orderBy(F.col("seq").desc()).limit(1)


def sample_commands(tables) -> DataFrame:
    """Every order as a bid, and an ask derived from it: a stream of new orders per instrument (part of the key)."""
    text, long = (lambda v: F.lit(v).cast("string")), (lambda v: F.lit(v).cast("long"))
    bids = tables.table("orders").select(F.concat(F.lit("i"), (F.col("o_orderkey") % 16).cast("string")).alias("instrument"), (F.col("o_orderkey") * 2).alias("seq"), F.col("o_orderkey").alias("order_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("owner"), F.lit("bid").alias("side"), (F.col("o_custkey") % 50 + 80).alias("price_ticks"), (F.col("o_custkey") % 9 + 1).alias("qty"))
    asks = bids.select("instrument", F.col("seq") + 1, F.col("order_id") + 1_000_000_000, F.concat(F.lit("m"), F.col("owner")), F.lit("ask"), F.col("price_ticks") % 41 + 90, "qty")
    both = bids.union(asks)
    return both.select("instrument", "seq", F.lit("new").alias("action"), "order_id", "owner", text(None).alias("client_id"), long(None).alias("nonce"), "side", F.lit("limit").alias("type"), F.lit("gtc").alias("tif"), F.lit(False).alias("post_only"), text(None).alias("stp"), "price_ticks", long(None).alias("price_high"), "qty", long(None).alias("target"))
