"""Operations on a store: `python -m cairn ROOT COMMAND ...`."""

from __future__ import annotations

import argparse
import json


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="cairn", description=__doc__)
    p.add_argument("root")
    sub = p.add_subparsers(dest="command", required=True)
    for name, more in {"projects": [], "tables": [], "describe": ["table"], "scan": ["table"], "scan-kv": ["prefix"], "verify": [], "checkpoint": [], "parity": ["table"], "backup": ["to"], "events": [], "invariants": [], "export": ["to"], "restore": ["dump"], "dump-parity": ["dump"], "backups": [], "verify-backup": []}.items():
        c = sub.add_parser(name)
        for m in more:
            c.add_argument(m)
        c.add_argument("--seq", type=int)
        c.add_argument("--limit", type=int, default=20)
    a = p.parse_args(args)

    from pyspark.sql import SparkSession

    from cairn.sources import offline
    from cairn.sources.store import Engine

    spark = SparkSession.builder.getOrCreate()
    if a.command in ("backups", "verify-backup"):  # ROOT is a folder of backups, or one of them
        out = offline.backups(spark, a.root) if a.command == "backups" else offline.verify_backup(spark, a.root)
        print(json.dumps(out, default=str))
        return int(a.command == "verify-backup" and bool(out))
    if a.command == "restore":
        print(json.dumps(offline.restore(spark, a.dump, a.root).refresh()))
        return 0
    engine = Engine(spark, a.root)
    view = engine.view(a.seq)
    if a.command in ("projects", "tables"):
        out = getattr(view, a.command)()
    elif a.command == "describe":
        out = view.describe(a.table)
    elif a.command == "scan":
        out = [r.asDict() for r in view.table(a.table).orderBy(*view.primary_key(a.table)).limit(a.limit).collect()]
    elif a.command == "scan-kv":
        out = [[bytes(r["key"]).hex(), bytes(r["value"]).hex()] for r in view.kv_scan(a.prefix.encode(), a.limit).collect()]
    elif a.command == "events":
        out = [r.asDict() for r in view.events().orderBy("commit_seq", "topic", "event_key").limit(a.limit).collect()]
    elif a.command == "verify":
        out = engine.verify()
    elif a.command == "checkpoint":
        out = engine.checkpoint()
    elif a.command == "invariants":
        out = offline.invariants(engine, a.seq)
    elif a.command == "export":
        out = offline.export(engine, a.to, a.seq)
    elif a.command == "dump-parity":
        out = offline.parity(engine, a.dump, a.seq)
    elif a.command == "parity":
        out = engine.parity(a.table, a.seq).first().asDict()
    else:
        out = engine.backup(a.to, a.seq)
    print(json.dumps(out, default=str))
    return int(a.command in ("verify", "invariants", "dump-parity") and bool(out))


if __name__ == "__main__":
    raise SystemExit(main())
