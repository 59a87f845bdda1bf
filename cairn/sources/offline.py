"""Work on stores that nobody writes to: dumps, their restoring, backups, invariants.

A dump is a catalog (`catalog.json`, with a digest of every table) and one Parquet table per table of
a snapshot, so any reader of Parquet can use it. Everything runs as Spark jobs; only counts and
digests reach the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cairn.functions import expr as E
from cairn.plans.errors import NotFound, ValidationError
from cairn.sources import catalog as C
from cairn.sources.files import LogFiles
from cairn.sources.store import EVENTS, KV_TABLE, Engine, _all, _any

_KV_DIR, _EVENT_DIR = "kv", "events"


def _digest(df) -> list:
    r = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("d")).first()
    return [r["n"], r["d"]]


def export(engine: Engine, to: str, seq: int | None = None) -> dict:
    """Writes a dump of a snapshot; returns {table: [rows, digest]}."""
    seq = engine.refresh() if seq is None else seq
    cat, sums, spark = engine.catalog(seq), {}, engine.spark
    for table in [*cat["tables"], KV_TABLE]:
        path = f"{to}/tables/{_KV_DIR if table == KV_TABLE else table}"
        engine.table_at(table, seq).write.parquet(path)
        sums[table] = _digest(spark.read.parquet(path))
    engine.events(seq).write.parquet(f"{to}/{_EVENT_DIR}")
    sums[EVENTS] = _digest(spark.read.parquet(f"{to}/{_EVENT_DIR}"))
    if not LogFiles(spark, to).create("catalog.json", json.dumps({"seq": seq, "catalog": cat, "sums": sums})):
        raise ValidationError(f"{to} holds a dump already")
    return sums


def _dump(spark: SparkSession, path: str) -> dict:
    return json.loads(LogFiles(spark, path).read("catalog.json"))


def parity(engine: Engine, dump: str, seq: int | None = None) -> list[str]:
    """Tables whose rows differ between a snapshot and a dump."""
    held, seq = _dump(engine.spark, dump)["sums"], engine.refresh() if seq is None else seq
    tables = {*engine.catalog(seq)["tables"], KV_TABLE}
    out = sorted(tables ^ (set(held) - {EVENTS}))
    return out + [t for t in sorted(tables & set(held)) if _digest(engine.table_at(t, seq)) != held[t]]


def restore(spark: SparkSession, dump: str, root: str) -> Engine:
    """A new store with the dump's catalog, rows and KV in its first commit. Events keep their place in the dump's log."""
    d, engine = _dump(spark, dump), Engine(spark, root)
    if engine.refresh():
        raise ValidationError(f"{root} holds a store already")
    cat = d["catalog"]
    ops = [{"op": "create_project", "project": p, "owner": x["owner"]} for p, x in cat["projects"].items()]
    ops += [{"op": "create_scope", "project": p, "scope": s} for p, x in cat["projects"].items() for s in x["scopes"] if s != "app"]
    ops += C.remake(cat["tables"])
    ops += [{"op": "grant", "caller": who, "permission": p, "on": on} for who, held in cat["permissions"].items() for p, on in held]
    ops += [{"op": "enable_kv_projection", "namespace": n} for n in cat["kv_projections"]]
    ops += [{"op": "record_migration", "version": v, **m} for v, m in cat["migrations"].items()]
    catalog, files = C.empty(), {}
    for op in ops:
        catalog, _ = C.apply_ddl(catalog, op)
    for t, x in catalog["tables"].items():
        rows = spark.read.parquet(f"{dump}/tables/{t}")
        files[t] = engine.write(rows.select(*(F.col(c["name"]).alias(f"c{c['id']}") for c in x["columns"]), F.lit(1).cast("long").alias("_seq"), F.lit("U").alias("_op")), t)
    kv = spark.read.parquet(f"{dump}/tables/{_KV_DIR}")
    files[KV_TABLE] = engine.write(kv.select("ns", "key", "value", "created_at", F.lit(1).cast("long").alias("_seq"), F.lit("U").alias("_op")), KV_TABLE)
    files[EVENTS] = engine.write(spark.read.parquet(f"{dump}/{_EVENT_DIR}"), EVENTS)
    engine.publish({"ddl": ops, "files": files})
    return engine


def invariants(engine: Engine, seq: int | None = None) -> list[str]:
    """What a snapshot breaks of its own rules: the log's chain, keys, NOT NULL, CHECK, UNIQUE, foreign keys."""
    seq = engine.refresh() if seq is None else seq
    cat, out = engine.catalog(seq), engine.verify()
    for name, t in cat["tables"].items():
        rows = engine.table_at(name, seq)
        if not rows.groupBy(*t["primary_key"]).count().where("count > 1").isEmpty():
            out.append(f"{name}: a key twice")
        needed = [c["name"] for c in t["columns"] if not c["nullable"]]
        if needed and not rows.where(_any([F.col(c).isNull() for c in needed])).isEmpty():
            out.append(f"{name}: null in {needed}")
        for j in t["checks"]:
            if not rows.where(~F.coalesce(E.compile_predicate(E.from_json(j), F.col), F.lit(False))).isEmpty():
                out.append(f"{name}: check {j}")
        for u in t["unique"]:
            if not rows.where(_all([F.col(c).isNotNull() for c in u])).groupBy(*u).count().where("count > 1").isEmpty():
                out.append(f"{name}: not unique {u}")
        for fk in t["fks"]:
            parent = engine.table_at(fk["table"], seq).select(*(F.col(c).alias(f"_p{i}") for i, c in enumerate(fk["references"])))
            mine = rows.where(_all([F.col(c).isNotNull() for c in fk["columns"]]))
            if not mine.join(parent, _all([F.col(c) == F.col(f"_p{i}") for i, c in enumerate(fk["columns"])]), "left_anti").isEmpty():
                out.append(f"{name}: foreign key {fk['columns']}")
    return out


def backups(spark: SparkSession, folder: str) -> list[dict]:
    """The backups under a folder: path, last commit and its time, oldest commit first."""
    files = LogFiles(spark, folder)
    out = []
    for s in files.fs.listStatus(files.path):
        path = s.getPath().toString()
        if s.isDirectory() and files.fs.exists(files.jvm.org.apache.hadoop.fs.Path(path, "log")):
            e = Engine(spark, path)
            out.append({"path": path, "seq": e.refresh(), "ts_micros": e.entries[-1]["ts_micros"] if e.entries else None})
    return sorted(out, key=lambda b: (b["seq"], b["path"]))


def verify_backup(spark: SparkSession, path: str) -> list[str]:
    """Broken links of a backup's log, and files that it names and does not hold."""
    e = Engine(spark, path)
    if not e.refresh():
        raise NotFound(f"no backup in {path}")
    out, at = e.verify(), e.log.jvm.org.apache.hadoop.fs.Path
    for x in e.entries:
        named = [p for f in (*x["files"].values(), *x["checkpoints"].values(), x.get("events_rewritten", ()), *(y["files"] for y in x.get("projections", {}).values())) for p in f]
        out += [f"commit {x['seq']}: no {p}" for p in named if not e.log.fs.exists(at(f"{e.root}/{p}"))]
    return out
