import json

import pytest

from cairn.functions.expr import col
from cairn.operators import eventlog, tasks
from cairn.plans import errors
from cairn.sources.store import Engine
from cairn.streaming import processors as P


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    return Engine(spark, str(tmp_path_factory.mktemp("tasks") / "db"))


def test_queue(engine):
    q = tasks.Queue(engine, "q", max_attempts=2)
    a, b = q.enqueue("low", now=0), q.enqueue("high", priority=5, now=0)
    assert q.enqueue("again", job_id=a, now=0) == a and q.get(a)["payload"] == "low"
    late = q.enqueue("late", priority=9, delay_ms=1000, now=0)
    one, two = q.claim(3, "w", 100, now=10)
    assert [one["payload"], two["payload"]] == ["high", "low"]
    q.complete(one["id"], one["token"], [{"kind": "kv_set", "key": b"done", "value": b"1"}])
    assert engine.view().kv_get(b"done") == b"1" and q.get(b)["state"] == "done"
    (back,) = q.claim(1, "w2", 100, now=500)  # the lease ran out
    with pytest.raises(errors.FencingLost):
        q.complete(two["id"], two["token"])
    assert q.fail(back["id"], back["token"], "boom", now=500) == "dead"
    assert q.claim(1, "w", 100, now=2000)[0]["id"] == late and q.cancel(a) is False


def test_lease_and_monitor(engine):
    m = tasks.Monitor(engine, "m")
    t = m.acquire("a", 100, now=0)
    assert m.acquire("b", 100, now=50) is None and m.acquire("a", 100, now=50) == t
    m.advance("a", t, 5, {"kind": "kv_set", "key": b"m", "value": b"5"}, now=60)
    with pytest.raises(errors.ValidationError):
        m.advance("a", t, 4, now=60)
    t2 = m.acquire("b", 100, now=500)
    assert t2 == t + 1 and m.status()["checkpoint"] == 5
    with pytest.raises(errors.FencingLost):
        m.renew("a", t, 100, now=510)
    with pytest.raises(errors.FencingLost):
        m.guarded_commit("a", t, {"kind": "kv_set", "key": b"m", "value": b"9"}, now=510)
    assert engine.view().kv_get(b"m") == b"5" and m.release("b", t2) and not m.release("b", 77)
    with pytest.raises(errors.ValidationError):
        tasks.Lease(engine, "")


def test_effects_projection_series(engine):
    e = tasks.Effects(engine)
    assert e.begin("x") == ("fresh", 1) and e.begin("x") == ("in_progress", 2)
    assert e.complete("x", {"r": 1}) and not e.complete("x", {"r": 2}) and e.begin("x") == ("already_committed", {"r": 1})
    assert e.by_status().collect()[0].asDict() == {"status": "done", "count": 1}
    p = tasks.Projection(engine, "v")
    p.put("b", 1)
    p.put("a", 2)
    p.put("b", 3)
    assert p.list() == [("a", 2), ("b", 3)] and p.get("b") == 3
    p.remove("a")
    assert p.list() == [("b", 3)]
    s = tasks.Series(engine, "s", 2)
    for i in range(3):
        s.append(i)
    assert s.read() == [1, 2] and s.read(1, newest_first=True) == [2]


def test_keyed_state_and_returning(engine):
    engine.ddl({"op": "create_table", "table": "main/app/jobs", "columns": [{"name": "id", "type": "integer"}, {"name": "status", "type": "text"}, {"name": "n", "type": "integer", "nullable": False}], "primary_key": ["id"]})
    k = tasks.KeyedState(engine, "jobs")
    k.write(2, {"status": "new", "n": 0})
    k.write(1, {"status": "new", "n": 0})
    k.update(1, lambda r: {**r, "n": r["n"] + 4})
    assert k.read_field(1, "n") == 4 and k.read(9) is None
    before, after = tasks.mutate_returning(engine, "jobs", col("status").eq("new"), {"status": "taken", "n": ("add", 1)})
    assert (before["id"], before["status"], after["status"], after["n"]) == (1, "new", "taken", 5)
    assert tasks.mutate_returning(engine, "jobs", col("status").eq("none"), {"n": 1}) is None
    with pytest.raises(errors.ValidationError):
        k.write(1, {"id": 3, "status": "x", "n": 1})


def test_processor(engine):
    seen, fail = [], [2]

    def handler(rows):
        if fail[0]:
            fail[0] -= 1
            raise RuntimeError("not yet")
        keys = [r["event_key"] for r in rows.collect()]
        seen.extend(keys)
        return [{"kind": "kv_set", "key": b"seen", "value": json.dumps(seen).encode()}]

    for i in range(3):
        engine.commit(*({"kind": "emit", "topic": "t", "key": f"{i}{x}", "payload": {}} for x in "ab"))
    p = P.Processor(engine, "p", handler, P.Options(topic="t", max_events=3, retry_backoff_ms=1))
    waits = []
    assert p.run_once(waits.append) == 4 and seen == ["0a", "0b", "1a", "1b"] and waits == [0.001, 0.002]
    at = p.checkpoint()
    assert P.Processor(engine, "p", handler).checkpoint() == at  # registering anew moves nothing
    p.pause()
    assert p.run_once() == 0
    p.resume()
    assert p.run_until_idle() == 2 and json.loads(engine.view().kv_get(b"seen")) == seen
    fail[0] = 99
    engine.commit({"kind": "emit", "topic": "t", "key": "z", "payload": {}})
    assert p.lag() > 0 and p.run_once(lambda s: None) == 0 and p.lag() == 0 and len(p.dead_letters()) == 1
    assert p.slo()["status"] == "healthy" and [x["processor"] for x in P.list_processors(engine)] == ["p"]
    with pytest.raises(errors.ValidationError):
        p.acknowledge(0)


def test_streams(engine, tmp_path):
    got = []
    P.for_each_batch(P.stream_events(engine, "t"), lambda b, n: got.extend(r["event_key"] for r in b.collect()), str(tmp_path / "c")).awaitTermination(60)
    assert sorted(got) == ["0a", "0b", "1a", "1b", "2a", "2b", "z"]
    P.materialise_latest(P.stream_changes(engine, "jobs"), ["id"], str(tmp_path / "v"), str(tmp_path / "c2")).awaitTermination(60)
    latest = {r["id"]: r["n"] for r in engine.spark.read.parquet(str(tmp_path / "v" / "v0")).collect()}
    assert latest == {1: 5, 2: 0}


def test_streams_give_each_change_once(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    e.ddl({"op": "create_table", "table": "main/app/t", "columns": [{"name": "id", "type": "integer"}, {"name": "b", "type": "blob"}, {"name": "u", "type": "u64"}], "primary_key": ["id"]})
    for i in range(3):
        e.commit({"kind": "insert", "table": "t", "rows": [{"id": i, "b": b"x", "u": 2**64 - 1}]}, {"kind": "emit", "topic": "t", "key": str(i), "payload": {}})
    got, keys = [], []
    take = lambda: P.for_each_batch(P.stream_changes(e, "t"), lambda b, n: got.extend(map(tuple, b.collect())), str(tmp_path / "c")).awaitTermination(60)
    hear = lambda: P.for_each_batch(P.stream_events(e), lambda b, n: keys.extend(r["event_key"] for r in b.collect()), str(tmp_path / "c2")).awaitTermination(60)
    take()
    hear()
    e.write(spark.createDataFrame([(9, None, None, 9, "U")], "c0 long, c1 binary, c2 decimal(20,0), _seq long, _op string"), "main/app/t")  # a lost attempt
    e.commit({"kind": "upsert", "table": "t", "rows": [{"id": 1, "b": None, "u": None}]})
    e.checkpoint()
    e.compact_events(eventlog.Retention(keep_last=1))
    e.commit({"kind": "emit", "topic": "t", "key": "last", "payload": {}})
    take()
    hear()
    assert sorted((r[0], r[3], r[4]) for r in got) == [(0, 2, "U"), (1, 3, "U"), (1, 5, "U"), (2, 4, "U")] and sorted(keys) == ["0", "1", "2", "last"]
    assert int(got[0][2]) == 2**64 - 1 and bytes(got[0][1]) == b"x"
