"""A change-log table store on Parquet: atomic commits over many tables, snapshots by commit, constraints, assertions.

Layout: `root/log/{seq:020d}.json` names the files of a commit (that file's exclusive creation is the
commit) and holds its KV rows if they are small, `root/data/...` holds the files: table columns by id, `_seq` and `_op`. Whole snapshots stand
apart, in `root/checkpoint/...`, rewritten events in `root/compacted/...` and async indexes in
`root/projection/...`. Readers see files of commits up to theirs only; files of lost attempts are
never named. Every mutation is lowered to DataFrames, so a bulk upsert of any size takes the same
path as one row.
"""

from __future__ import annotations

import decimal
import hashlib
import json
import time
import uuid
from bisect import bisect_right
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions import expr as E
from cairn.functions.types import SPARK, check_value, literal_fits
from cairn.functions.wideint import MAX_U256, from_limbs, from_u256, limb_sums, u256
from cairn.operators import changelog, eventlog, keyed
from cairn.plans.errors import AssertionFailed, Conflict, ConstraintViolation, DuplicateKey, IndexNotFound, InvalidQuery, NotFound, Overflow, PermissionDenied, TableNotFound, TypeMismatch, Underflow, ValidationError
from cairn.sources import book
from cairn.sources import catalog as C
from cairn.sources.files import LogFiles

RETRIES, CASCADE, KV_TABLE, EVENTS = 16, 8, "_system/app/kv", "_system/app/event_outbox"
_KV = T.StructType([T.StructField("ns", T.StringType()), T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType()), T.StructField("created_at", T.LongType()), T.StructField("_seq", T.LongType()), T.StructField("_op", T.StringType())])
_EVENT = T.StructType([T.StructField(n, t) for n, t in (("commit_seq", T.LongType()), ("ts_micros", T.LongType()), ("project_id", T.StringType()), ("scope_id", T.StringType()), ("topic", T.StringType()), ("event_key", T.StringType()), ("payload", T.StringType()))])


@dataclass(frozen=True)
class CommitResult:
    seq: int
    duplicate: bool = False


WRITE_CLASSES = ("economic", "standard", "volatile")
#: An idempotency key is remembered for so many seconds and commits; the largest text, JSON or blob value.
IDEMPOTENCY_SECONDS, IDEMPOTENCY_COMMITS, MAX_VALUE = 300, 100_000, 1 << 20
#: A commit's KV rows of so many bytes in all stand in its log entry, more in a file.
INLINE = 1 << 12


@dataclass
class Envelope:
    """What one commit does, and what must hold for it: assertions on the state, and a read set nobody has changed since."""

    mutations: list[dict]
    assertions: list[dict] = field(default_factory=list)
    caller: str | None = None
    idempotency_key: str | None = None
    read_set: object | None = None  # plans.readset.ReadSet
    write_class: str = "standard"


@dataclass(frozen=True)
class Plan:
    """What a commit would do: errors that refuse it, the commit it builds on, what it reads and how many rows it writes."""

    errors: list[str]
    base: int
    read_set: object
    writes: dict[str, int]


class Engine:
    """Opens or makes a store under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, checkpoint_every: int = 0):
        """checkpoint_every: a checkpoint is made when so many commits have been added since the last; 0 makes none."""
        self.spark, self.root, self.checkpoint_every = spark, root.rstrip("/"), checkpoint_every
        self.log = LogFiles(spark, f"{self.root}/log")
        self.entries: list[dict] = []
        #: The catalog at first and after each commit with DDL, and those commits.
        self._catalogs: list[dict] = [C.empty()]
        self._changed: list[int] = []
        #: (commit, value, created_at) of the KV rows in log entries, by namespace and key; commits with KV rows in files.
        self._kv: dict[tuple[str, bytes], list[tuple]] = {}
        self._kv_filed: list[int] = []
        #: Called with each commit's log entry; and with (table, commit, caller, seconds or None) of each query.
        self.hooks: list = []
        self.query_hooks: list = []
        self.idempotency_seconds, self.idempotency_commits = IDEMPOTENCY_SECONDS, IDEMPOTENCY_COMMITS
        self.refresh()

    # --- log ------------------------------------------------------------------------------------
    def refresh(self) -> int:
        """Reads what others have committed. A store that is open asks for the next entry by name; only opening lists the log."""
        for name in self._new():
            text = self.log.read(name)
            entry = json.loads(text)
            entry["hash"] = hashlib.sha256(text.encode()).hexdigest()
            self.entries.append(entry)
            if entry["ddl"]:
                self._changed.append(entry["seq"])
            if entry["files"].get(KV_TABLE):
                self._kv_filed.append(entry["seq"])
            for ns, key, value, created in entry.get("kv", ()):
                self._kv.setdefault((ns, bytes.fromhex(key)), []).append((entry["seq"], None if value is None else bytes.fromhex(value), created))
        return len(self.entries)

    def _new(self):
        if not self.entries:
            yield from self.log.names()
            return
        while self.log.exists(name := f"{len(self.entries) + 1:020d}.json"):
            yield name

    head = property(lambda self: self.refresh())

    def catalog(self, seq: int | None = None) -> dict:
        seq = len(self.entries) if seq is None else seq
        n = bisect_right(self._changed, seq)
        while len(self._catalogs) <= n:
            cat = self._catalogs[-1]
            for op in self.entries[self._changed[len(self._catalogs) - 1] - 1]["ddl"]:
                cat, _ = C.apply_ddl(cat, op)
            self._catalogs.append(cat)
        return self._catalogs[n]

    def verify(self) -> list[str]:
        """Broken links of the log's hash chain."""
        return [f"commit {e['seq']} does not follow its predecessor" for p, e in zip(self.entries, self.entries[1:], strict=False) if e["prev"] != p["hash"]]

    # --- reading ----------------------------------------------------------------------------------
    def _files(self, table: str, seq: int, after: int = 0) -> list[str]:
        return [f"{self.root}/{p}" for e in self.entries[after:seq] for p in e["files"].get(table, [])]

    def _base(self, table: str, seq: int) -> int:
        """The last checkpoint of the table at or before a commit."""
        return max([e["seq"] for e in self.entries[:seq] if table in e["checkpoints"]], default=0)

    def change_log(self, table: str, seq: int | None = None, after: int = 0) -> DataFrame:
        """Changes of a table in (after, seq], under today's column names of that snapshot."""
        seq = len(self.entries) if seq is None else seq
        stored, names = self._stored(table, seq)
        files = self._files(table, seq, after)
        df = self.spark.read.schema(stored).parquet(*files) if files else self.spark.createDataFrame([], stored)
        if table == KV_TABLE and (inline := [(ns, k, v, created, at, "D" if v is None else "U") for (ns, k), past in self._kv.items() for at, v, created in past if after < at <= seq]):
            df = df.union(self.spark.createDataFrame(inline, stored)) if files else self.spark.createDataFrame(inline, stored)
        return df.select(*(F.col(a).alias(b) for a, b in names), "_seq", "_op")

    def kv_at(self, ns: str, keys: list[bytes], seq: int) -> dict[bytes, tuple[bytes, int]]:
        """(value, created_at) of those keys that are there at a commit. Files are read only for what log entries leave open."""
        filed, out, need = self._kv_filed[: bisect_right(self._kv_filed, seq)], {}, []
        for k in keys:
            past = self._kv.get((ns, k), [])
            i = bisect_right(past, seq, key=lambda x: x[0])
            if filed and (not i or past[i - 1][0] < filed[-1]):
                need.append(k)
            elif i and past[i - 1][1] is not None:
                out[k] = past[i - 1][1:]
        if need:
            for r in self.table_at(KV_TABLE, seq).where((F.col("ns") == ns) & F.col("key").isin(*need)).collect():
                out[bytes(r["key"])] = (bytes(r["value"]), r["created_at"])
        return out

    def _stored(self, table: str, seq: int):
        if table == KV_TABLE:
            return _KV, [(n, n) for n in ("ns", "key", "value", "created_at")]
        cat = self.catalog(seq)
        if table not in cat["tables"]:
            raise TableNotFound(table)
        t = cat["tables"][table]
        return C.stored_schema(t), [(f"c{c['id']}", c["name"]) for c in t["columns"]]

    def _key(self, table: str, seq: int) -> list[str]:
        return ["ns", "key"] if table == KV_TABLE else self.catalog(seq)["tables"][table]["primary_key"]

    def _created(self, table: str, seq: int) -> int:
        """The commit that made the table last: a dropped table's rows do not come back."""
        return max([e["seq"] - 1 for e in self.entries[:seq] for op in e["ddl"] if op["op"] == "create_table" and op["table"] == table], default=0)

    def _since_checkpoint(self, table: str, seq: int) -> DataFrame:
        """Changes that make up the table at a commit: those of its last checkpoint, as one change per row, and later ones."""
        base, made = self._base(table, seq), self._created(table, seq)
        if base <= made:
            return self.change_log(table, seq, made)
        stored, names = self._stored(table, seq)
        done = self.spark.read.schema(stored).parquet(*[f"{self.root}/{p}" for p in self.entries[base - 1]["checkpoints"][table]])
        return done.select(*(F.col(a).alias(b) for a, b in names), "_seq", "_op").union(self.change_log(table, seq, base))

    def table_at(self, table: str, seq: int) -> DataFrame:
        log = self._since_checkpoint(table, seq)
        out = changelog.snapshot(log, self._key(table, seq))
        if table == KV_TABLE:
            return out
        t = self.catalog(seq)["tables"][table]
        defaults = {c["name"]: t["defaults"][c["name"]] for c in t["columns"] if c["name"] in t["defaults"] and not c["nullable"]}
        return out.select(*(F.coalesce(F.col(c["name"]), F.lit(defaults[c["name"]])).alias(c["name"], metadata={"logical": c["type"]}) if c["name"] in defaults else F.col(c["name"]).alias(c["name"], metadata={"logical": c["type"]}) for c in t["columns"]))

    def view(self, seq: int | str | None = None, caller: str | None = None, project: str = "main", scope: str = "app") -> View:
        """A snapshot: the latest, of a commit, or "checkpoint" for the last one made."""
        head = self.refresh()
        if seq == "checkpoint":
            seq = max([e["seq"] for e in self.entries if e["checkpoints"]], default=0)
        if seq is not None and not 0 <= seq <= head:
            raise NotFound(f"commit {seq}")
        return View(self, head if seq is None else seq, caller, project, scope)

    def events(self, seq: int | None = None) -> DataFrame:
        seq = self.refresh() if seq is None else seq
        gone = max([e["pruned_to"] for e in self.entries[:seq] if e.get("pruned_to")], default=0)
        files = self._files(EVENTS, seq, 0)
        last = max((i for i, e in enumerate(self.entries[:seq]) if e.get("events_rewritten")), default=None)
        if last is not None:
            files = [f"{self.root}/{p}" for p in self.entries[last]["events_rewritten"]] + self._files(EVENTS, seq, last + 1) + [f"{self.root}/{p}" for p in self.entries[last]["files"].get(EVENTS, [])]
        df = self.spark.read.schema(_EVENT).parquet(*files) if files else self.spark.createDataFrame([], _EVENT)
        return df.where(F.col("commit_seq") > gone) if gone else df

    def lifecycle(self) -> DataFrame:
        """(commit_seq, ts_micros, event) of every catalog change."""
        self.refresh()
        rows = [(e["seq"], e["ts_micros"], json.dumps(op, sort_keys=True)) for e in self.entries for op in e["ddl"]]
        return self.spark.createDataFrame(rows, "commit_seq long, ts_micros long, event string")

    def deltas(self, table: str, after: int, until: int) -> DataFrame:
        return self.change_log(table, until, after)

    # --- committing ---------------------------------------------------------------------------------
    def commit(self, *mutations: dict, assertions: list[dict] | None = None, caller: str | None = None, idempotency_key: str | None = None, read_set=None, write_class: str = "standard") -> CommitResult:
        return self.commit_envelope(Envelope(list(mutations), assertions or [], caller, idempotency_key, read_set, write_class))

    def _earlier(self, key: str, print_: str) -> CommitResult | None:
        """The commit that used the key, within the window."""
        since = time.time() * 1e6 - self.idempotency_seconds * 1e6
        for e in reversed(self.entries[-self.idempotency_commits :]):
            if e["ts_micros"] < since:
                return None
            if e.get("idempotency", {}).get("key") == key:
                if e["idempotency"]["print"] != print_:
                    raise ValidationError("the idempotency key was used for something else")
                return CommitResult(e["seq"], True)
        return None

    def commit_envelope(self, env: Envelope) -> CommitResult:
        if env.write_class not in WRITE_CLASSES:
            raise ValidationError(f"no write class {env.write_class}")
        key = f"{env.caller or ''}:{env.idempotency_key}" if env.idempotency_key else None
        print_ = hashlib.sha256(repr([{k: v for k, v in m.items() if k != "rows" or isinstance(v, list)} for m in env.mutations]).encode()).hexdigest()
        for _ in range(RETRIES):
            base = self.refresh()
            if key and (done := self._earlier(key, print_)):
                return done
            work = Work(self, base, env.caller)
            try:
                work.check(env.assertions)
            except AssertionFailed as e:
                self.audit = [*getattr(self, "audit", []), {"seq": base, "error": str(e), "caller": env.caller, "ts_micros": int(time.time() * 1e6)}]
                raise
            if env.read_set is not None and env.read_set.changed(self, base):
                raise Conflict("what was read has changed")
            for m in env.mutations:
                work.apply(m)
            if work.publish({"key": key, "print": print_} if key else None, env.write_class):
                for h in self.hooks:
                    h(self.entries[-1])
                self._keep_up()
                return CommitResult(base + 1)
        raise Conflict("other commits came first every time")

    def preflight_plan(self, *mutations: dict, assertions: list[dict] | None = None, caller: str | None = None, read_set=None) -> Plan:
        """A dry run: what would refuse the mutations now, what they read and how much they would write; nothing is written.

        Committed with the plan's read set, they are refused if anything that they read has changed meanwhile."""
        from cairn.plans.readset import Read, ReadSet

        work, errors = Work(self, self.refresh(), caller), []
        try:
            work.check(assertions or [])
            if read_set is not None and read_set.changed(self, work.base):
                raise Conflict("what was read has changed")
            for m in mutations:
                work.apply(m)
        except ValueError as e:
            errors.append(f"{type(e).__name__}: {e}")
        reads = [Read(t, work.base) for t in sorted(work.now) if t in self.catalog(work.base)["tables"]]
        reads += [Read(KV_TABLE, work.base, (("ns", ns), ("key", k))) for ns, k in sorted(work._kv_state())]
        writes = {} if errors else {t: sum(p.count() for p in parts) for t, parts in work.changes.items()}
        if not errors and (dirty := sum(v[3] for v in work._kv_state().values())):
            writes[KV_TABLE] = dirty
        if not errors and work.out:
            writes[EVENTS] = len(work.out)
        return Plan(errors, work.base, ReadSet(reads), writes)

    def preflight(self, *mutations: dict, assertions: list[dict] | None = None, caller: str | None = None) -> list[str]:
        """What would refuse the mutations now; nothing is written."""
        work = Work(self, self.refresh(), caller)
        try:
            work.check(assertions or [])
            for m in mutations:
                work.apply(m)
        except ValueError as e:
            return [f"{type(e).__name__}: {e}"]
        return []

    def ddl(self, *ops: dict, by_dependency: bool = False) -> list[bool]:
        """Applies DDL in one commit; tells for each whether it changed anything."""
        ops = [{**o, "table": C.full_name(o["table"])} if "table" in o else o for o in ops]
        ops = C.order_by_dependency(ops) if by_dependency else ops
        cat, out = self.catalog(self.refresh()), []
        for op in ops:
            cat, changed = C.apply_ddl(cat, op)
            out.append(changed)
        if any(out):
            self.commit(*({"kind": "ddl", "op": o} for o, c in zip(ops, out, strict=True) if c))
        return out

    def migrate(self, migrations: list[dict]) -> list[int]:
        """Runs those of {version, name, up, down} not yet applied, in order of version; a changed one is refused."""
        ran = []
        for m in sorted(migrations, key=lambda m: m["version"]):
            sum_ = hashlib.sha256(json.dumps([m["name"], m["up"]], sort_keys=True).encode()).hexdigest()
            held = self.catalog(self.refresh())["migrations"].get(str(m["version"]))
            if held:
                if held["checksum"] != sum_:
                    raise ValidationError(f"migration {m['version']} changed after it ran")
                continue
            self.commit(*({"kind": "ddl", "op": o} for o in [*m["up"], {"op": "record_migration", "version": m["version"], "name": m["name"], "checksum": sum_}]))
            ran.append(m["version"])
        return ran

    def rollback(self, migrations: list[dict], to: int) -> list[int]:
        back = sorted((m for m in migrations if m["version"] > to and str(m["version"]) in self.catalog(self.refresh())["migrations"]), key=lambda m: -m["version"])
        for m in back:
            self.commit(*({"kind": "ddl", "op": o} for o in [*m.get("down", []), {"op": "forget_migration", "version": m["version"]}]))
        return [m["version"] for m in back]

    def backfill(self, table: str, transform, batch: int | None = None, name: str | None = None, caller: str | None = None) -> list[CommitResult]:
        """Rewrites a table's rows by a DataFrame function, in key order, `batch` rows a commit (None: all in one).

        With a name, each commit also records the last key done, so a run that was broken off goes on where it stopped,
        and a finished one does nothing more."""
        full, out = C.full_name(table), []
        key, mark = self._key(full, self.refresh()), b"backfill\0" + name.encode() if name else None
        raw = self.view().kv_get(mark, "_system/app") if mark else None
        done = json.loads(raw) if raw else {"after": None, "over": False}
        while not done["over"]:
            rows = self.view().table(full)
            if done["after"] is not None:
                rows = rows.where(_after([F.col(k) for k in key], [_from_json(v) for v in done["after"]]))
            last = None
            if batch is not None:
                rows = rows.orderBy(*key).limit(batch)
                ends = rows.select(*key).collect()  # at most `batch` keys
                last = max((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in ends), default=None)
            over = batch is None or last is None or len(ends) < batch
            done = {"after": [_to_json(v) for v in last] if last is not None else done["after"], "over": over}
            some = batch is None or last is not None
            changes = [{"kind": "upsert", "table": full, "rows": transform(rows)}] if some else []
            if mark:
                changes.append({"kind": "kv_set", "ns": "_system/app", "key": mark, "value": json.dumps(done).encode()})
            if changes:
                out.append(self.commit(*changes, caller=caller))
        return out

    # --- upkeep -------------------------------------------------------------------------------------
    def _keep_up(self) -> None:
        n = self.checkpoint_every
        if n and len(self.entries) >= n and not any(e["checkpoints"] for e in self.entries[-n:]):
            try:
                self.checkpoint()
            except Conflict:  # another writer was first, and will make one
                pass

    def write(self, df: DataFrame, table: str, kind: str = "data") -> list[str]:
        path = f"{kind}/{table}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{path}")
        return [path]

    def publish(self, entry: dict) -> bool:
        entry = {"ddl": [], "files": {}, "checkpoints": {}, **entry, "seq": len(self.entries) + 1, "ts_micros": int(time.time() * 1e6), "prev": self.entries[-1]["hash"] if self.entries else ""}
        done = self.log.create(f"{entry['seq']:020d}.json", json.dumps(entry, sort_keys=True))
        self.refresh()
        return done

    def checkpoint(self) -> int:
        """Writes whole snapshots, from which later reads start."""
        seq = self.refresh()
        made = {}
        for table in [*self.catalog(seq)["tables"], KV_TABLE]:
            if table != KV_TABLE or self._kv or self._kv_filed:
                names = self._stored(table, seq)[1]
                stamped = changelog.snapshot(self._versions(table, seq), self._key(table, seq))
                rows = stamped.select(*(F.col(b).alias(a) for a, b in names), F.col("_version").alias("_seq"), F.lit("U").alias("_op"))
                made[table] = self.write(rows, table, "checkpoint")
        if not self.publish({"checkpoints": made}):
            raise Conflict("another commit came first")
        return len(self.entries)

    def _versions(self, table: str, seq: int) -> DataFrame:
        return self._since_checkpoint(table, seq).withColumn("_version", F.col("_seq"))

    def compact_events(self, policy: eventlog.Retention, now_micros: int | None = None, floor: int | None = None) -> int:
        """Drops the oldest events that the policy lets go; returns how many."""
        self.refresh()
        now = now_micros if now_micros is not None else int(time.time() * 1e6)
        kept, gone = eventlog.compact(self.events(), policy, now, floor)
        n = gone.count()
        if n and not self.publish({"events_rewritten": self.write(kept, EVENTS, "compacted")}):
            raise Conflict("another commit came first")
        return n

    def refresh_projection(self, table: str, index: str) -> int:
        """Brings an async index up to the head from the changes since its last refresh; returns its commit."""
        seq, name = self.refresh(), f"{table}#{index}"
        spec = self.catalog(seq)["tables"][table]["async_indexes"].get(index)
        if spec is None:
            raise IndexNotFound(f"async index {index} not found")
        key = self._key(table, seq)
        wanted = list(dict.fromkeys([*key, *spec["columns"]]))
        partial = E.from_json(spec["partial"]) if spec.get("partial") else None
        held = lambda df: df if partial is None else df.where(E.compile_predicate(partial, F.col))
        last = next((e for e in reversed(self.entries) if name in e.get("projections", {})), None)
        fresh = held(self.view(seq).table(table)).select(*wanted)
        if last is not None:
            done = last["projections"][name]
            moved = self.change_log(table, seq, done["seq"])
            old = self.spark.read.parquet(*[f"{self.root}/{p}" for p in done["files"]])
            rest = list(dict.fromkeys([*wanted, *(E.columns_of(partial) if partial is not None else ())]))
            new = moved.groupBy(*key).agg(F.max_by(F.struct("_op", *[c for c in rest if c not in key]), "_seq").alias("v"))
            live = new.where("v._op = 'U'").select(*(F.col(c) if c in key else F.col(f"v.{c}").alias(c) for c in rest))
            fresh = old.join(new.select(*key), key, "left_anti").unionByName(held(live).select(*wanted))
        self.publish({"projections": {name: {"seq": seq, "files": self.write(fresh, name.replace("#", "."), "projection")}}})
        return seq

    def projection(self, table: str, index: str, seq: int) -> tuple[DataFrame, int]:
        name = f"{table}#{index}"
        last = next((e for e in reversed(self.entries[:seq]) if name in e.get("projections", {})), None)
        if last is None:
            raise IndexNotFound(f"async index {index} not found")
        done = last["projections"][name]
        return self.spark.read.parquet(*[f"{self.root}/{p}" for p in done["files"]]), done["seq"]

    def backup(self, to: str, until_seq: int | None = None, until_micros: int | None = None, since: int = 0) -> int:
        """Copies commits (since, until] with their files; a chain of such copies restores to any point. Returns the last."""
        seq = self.refresh() if until_seq is None else until_seq
        if until_micros is not None:
            seq = max([e["seq"] for e in self.entries[:seq] if e["ts_micros"] <= until_micros], default=0)
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        target = path(to).getFileSystem(conf)
        for e in self.entries[since:seq]:
            named = [*(p for f in e["files"].values() for p in f), *(p for f in e["checkpoints"].values() for p in f), *e.get("events_rewritten", []), *(p for x in e.get("projections", {}).values() for p in x["files"])]
            for p in [*named, f"log/{e['seq']:020d}.json"]:
                target.mkdirs(path(f"{to}/{p}").getParent())
                jvm.org.apache.hadoop.fs.FileUtil.copy(self.log.fs, path(f"{self.root}/{p}"), target, path(f"{to}/{p}"), False, True, conf)
        return seq

    def restore_namespace(self, source: Engine, namespace: str, seq: int | None = None) -> list[str]:
        """Brings the tables and KV of `project` or `project/scope` to their state in another store (a backup) at a commit; others stay.

        All of it is one commit: tables that the namespace has here are dropped and made anew."""
        seq = source.refresh() if seq is None else seq
        inside = lambda name: name.startswith(f"{namespace}/")
        there, here = source.catalog(seq)["tables"], self.catalog(self.refresh())["tables"]
        drops = [{"op": "drop_table", "table": t} for t in _children_first({t: x for t, x in here.items() if inside(t)})]
        names = [t for t in there if inside(t)]
        makes = C.remake({t: there[t] for t in names})
        rows = [{"kind": "upsert", "table": o["table"], "rows": source.table_at(o["table"], seq)} for o in makes if o["op"] == "create_table"]
        under = F.col("ns").startswith(f"{namespace}/") | (F.col("ns") == namespace)
        old = {(r["ns"], bytes(r["key"])) for r in self.table_at(KV_TABLE, len(self.entries)).where(under).select("ns", "key").toLocalIterator()}
        kv = [{"kind": "kv_set", "ns": r["ns"], "key": bytes(r["key"]), "value": bytes(r["value"])} for r in source.table_at(KV_TABLE, seq).where(under).toLocalIterator()]
        gone = [{"kind": "kv_del", "ns": ns, "key": k} for ns, k in sorted(old - {(m["ns"], m["key"]) for m in kv})]
        self.commit(*({"kind": "ddl", "op": o} for o in [*drops, *makes]), *rows, *gone, *kv)
        return names

    def parity(self, table: str, seq: int | None = None) -> DataFrame:
        """(n_rows, digest) of a snapshot, whatever the order of its rows."""
        df = self.view(seq).table(table)
        return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))


class View:
    """A pinned snapshot: source of queries, with policies and permissions of its caller."""

    def __init__(self, engine: Engine, seq: int, caller: str | None, project: str, scope: str):
        self.engine, self.seq, self.caller, self.project, self.scope = engine, seq, caller, project, scope
        self.materialized_seq: int | None = None
        self.ahead: dict[tuple, object] = {}  # what pages may go on from, of plans.paging
        self.read: list[tuple] = []

    def name(self, table: str) -> str:
        return C.full_name(table, self.project, self.scope)

    def table(self, table: str, index: str | None = None) -> DataFrame:
        full = self.name(table)
        cat = self.engine.catalog(self.seq)
        if full not in cat["tables"]:
            raise TableNotFound(table)
        if not C.allowed(cat, self.caller, "index_read" if index else "table_read", full):
            raise PermissionDenied(f"{self.caller} may not read {table}")
        self.read.append((full, self.seq))
        if index:
            df, self.materialized_seq = self.engine.projection(full, index, self.seq)
            return df
        return self.engine.table_at(full, self.seq)

    def primary_key(self, table: str) -> list[str]:
        return self.engine._key(self.name(table), self.seq)

    def policy(self, table: str, caller: str | None):
        full, caller = self.name(table), caller or self.caller
        cat = self.engine.catalog(self.seq)
        p = cat["tables"][full]["policy"]
        if p is None or caller is None or C.allowed(cat, caller, "policy_bypass", full) and cat["tables"][full]["owner"] != caller:
            return None
        return E.bind_caller(E.from_json(p), caller)

    def _tell(self, q, seconds: float | None) -> None:
        for h in self.engine.query_hooks:
            h({"table": self.name(q.table), "seq": self.seq, "caller": self.caller, "seconds": seconds})

    def query(self, q) -> DataFrame:
        """The query's rows; lazy, so hooks hear of it without a time."""
        from cairn.plans.query import lower

        self._tell(q, None)
        return lower(q, self, self.caller)

    def page(self, q, **options):
        from cairn.plans.paging import execute_page

        began = time.perf_counter()
        out = execute_page(q, self, self.caller, seq=self.seq, **options)
        self._tell(q, time.perf_counter() - began)
        return out

    def sql(self, text: str, *tables: str) -> DataFrame:
        """Spark SQL over snapshot tables, named {table} in the text."""
        return self.engine.spark.sql(text, **{t: self.table(t) for t in tables})

    def _may_read_kv(self, ns: str) -> None:
        if not C.allowed(self.engine.catalog(self.seq), self.caller, "kv_read", ns):
            raise PermissionDenied(f"{self.caller} may not read {ns}")

    def kv(self, ns: str = "main/app") -> DataFrame:
        """(key, value, created_at) of a namespace."""
        self._may_read_kv(ns)
        return self.engine.table_at(KV_TABLE, self.seq).where(F.col("ns") == ns).drop("ns")

    def kv_get(self, key: bytes, ns: str = "main/app") -> bytes | None:
        self._may_read_kv(ns)
        return self.engine.kv_at(ns, [key], self.seq).get(key, (None,))[0]

    def kv_scan(self, prefix: bytes, limit: int | None = None, after: bytes | None = None, ns: str = "main/app") -> DataFrame:
        return keyed.kv_prefix(self.kv(ns), prefix, limit, after)

    def events(self) -> DataFrame:
        return self.engine.events(self.seq)

    def counter(self, key: bytes, ns: str = "main/app") -> int:
        """The checked sum of a counter's shards."""
        rows = self.kv_scan(b"ctr:" + key + b":", ns=ns).select(F.conv(F.hex("value"), 16, 10).cast("decimal(20,0)").alias("v")).agg(F.sum("v")).first()
        total = int(rows[0] or 0)
        if total >= 1 << 64:
            raise Overflow("counter over 64 bits")
        return total

    def kv_project(self, project: str) -> DataFrame:
        """(ns, key, value, created_at) of every scope of a project."""
        if not C.allowed(self.engine.catalog(self.seq), self.caller, "kv_read", project):
            raise PermissionDenied(f"{self.caller} may not read {project}")
        return self.engine.table_at(KV_TABLE, self.seq).where(F.col("ns").startswith(f"{project}/")).orderBy("ns", "key")

    def kv_projection(self, ns: str = "main/app") -> DataFrame:
        """The namespace as a table (project_id, scope_id, key, value, commit_seq), where enabled."""
        if ns not in self.engine.catalog(self.seq)["kv_projections"]:
            raise NotFound(f"no KV projection of {ns}")
        log = self.engine.change_log(KV_TABLE, self.seq).where(F.col("ns") == ns)
        last = log.groupBy("key").agg(F.max_by(F.struct("_op", "value", "_seq"), "_seq").alias("v")).where("v._op = 'U'")
        project, scope = ns.split("/")
        return last.select(F.lit(project).alias("project_id"), F.lit(scope).alias("scope_id"), "key", F.col("v.value").alias("value"), F.col("v._seq").alias("commit_seq"))

    def projects(self) -> list[dict]:
        cat = self.engine.catalog(self.seq)
        return [{"project": p, "owner": x["owner"], "scopes": list(x["scopes"]), "tables": sum(t.startswith(f"{p}/") for t in cat["tables"])} for p, x in sorted(cat["projects"].items())]

    def describe(self, table: str) -> dict:
        full = self.name(table)
        cat = self.engine.catalog(self.seq)
        if full not in cat["tables"]:
            raise TableNotFound(table)
        return {k: v for k, v in cat["tables"][full].items() if k != "next_id"}

    def exists(self, table: str) -> bool:
        return self.name(table) in self.engine.catalog(self.seq)["tables"]

    def tables(self) -> list[dict]:
        cat = self.engine.catalog(self.seq)
        return [{"table": n, "columns": [c["name"] for c in t["columns"]], "primary_key": t["primary_key"], "indexes": sorted(t["indexes"]), "async_indexes": sorted(t["async_indexes"]), "rows": self.engine.table_at(n, self.seq).count()} for n, t in cat["tables"].items() if n.startswith(f"{self.project}/{self.scope}/")]


class Work:
    """The working state of one commit: each mutation sees those before it."""

    def __init__(self, engine: Engine, base: int, caller: str | None):
        self.engine, self.base, self.caller = engine, base, caller
        self.cat = engine.catalog(base)
        self.ddl: list[dict] = []
        self.now: dict[str, DataFrame] = {}
        self.changes: dict[str, list[DataFrame]] = {}
        self.made: set[str] = set()
        self.out: list[tuple] = []

    # --- state ------------------------------------------------------------------------------------
    def spec(self, table: str) -> dict:
        if table not in self.cat["tables"]:
            raise TableNotFound(table)
        return self.cat["tables"][table]

    def rows(self, table: str) -> DataFrame:
        if table not in self.now:
            if table in self.engine.catalog(self.base)["tables"] and table not in self.made:
                known = self.engine.table_at(table, self.base)
                have = set(known.columns)
                self.now[table] = known.select(*(F.col(c["name"]) if c["name"] in have else F.lit(None).cast(SPARK[c["type"]]).alias(c["name"]) for c in self.spec(table)["columns"]))
            else:
                self.now[table] = self.engine.spark.createDataFrame([], C.schema(self.spec(table)))
        return self.now[table]

    def incoming(self, table: str, rows) -> DataFrame:
        """Rows to write: a list of dicts, each checked, or a DataFrame with the table's column types."""
        t = self.spec(table)
        cols = C.columns(t)
        if isinstance(rows, DataFrame):
            have = {f.name: f.dataType for f in rows.schema.fields}
            for c in cols:
                if c.name in have and have[c.name] != SPARK[c.type]:
                    raise TypeMismatch(f"{c.name} is {have[c.name].simpleString()}, not {SPARK[c.type].simpleString()}")
            df = rows.select(*((F.col(c.name) if c.name in have else F.lit(t["defaults"].get(c.name)).cast(SPARK[c.type])).alias(c.name) for c in cols))
            long = [F.octet_length(c.name) > MAX_VALUE for c in cols if c.type in ("text", "json", "blob")]
            if long and not df.where(_any(long)).isEmpty():
                raise ValidationError(f"a value over {MAX_VALUE} bytes")
            bad = [F.col(c.name).isNull() for c in cols if not c.nullable] + [F.isnan(c.name) | F.col(c.name).isin(float("inf"), float("-inf")) for c in cols if c.type == "float"]
            if bad and not df.where(_any(bad)).isEmpty():
                raise TypeMismatch("null in a non-null column, or a float that is not finite")
            return df
        unknown = {k for r in rows for k in r} - {c.name for c in cols}
        if unknown:
            raise ValidationError(f"unknown columns {sorted(unknown)}")
        out = []
        for r in rows:
            r = {**t["defaults"], **r}
            out.append(tuple(check_value(c, r.get(c.name)) for c in cols))
            if any(len(v.encode() if isinstance(v, str) else v) > MAX_VALUE for v in out[-1] if isinstance(v, (str, bytes, bytearray))):
                raise ValidationError(f"a value over {MAX_VALUE} bytes")
        plain = [tuple(decimal.Decimal(v) if c.type == "u64" and v is not None else v for c, v in zip(cols, row, strict=True)) for row in out]
        return self.engine.spark.createDataFrame(plain, T.StructType([T.StructField(c.name, SPARK[c.type]) for c in cols]))

    # --- constraints ---------------------------------------------------------------------------------
    def put(self, table: str, df: DataFrame, check_fk: bool = True, deep: int = 0) -> None:
        """Upserts rows after checks of CHECK, UNIQUE and foreign keys; rows that refer to changed values follow."""
        t = self.spec(table)
        key = t["primary_key"]
        for j in t["checks"]:
            ok = E.compile_predicate(E.from_json(j), F.col)
            if not df.where(~F.coalesce(ok, F.lit(False))).isEmpty():
                raise ConstraintViolation("check fails")
        after = changelog.applied(self.rows(table), df, key)
        for u in t["unique"]:
            shared = after.where(~_any([F.col(c).isNull() for c in u])) if not table.startswith("_global/") else after
            if not shared.groupBy(*u).count().where("count > 1").isEmpty():
                raise ConstraintViolation(f"unique {u}")
        if check_fk:
            for fk in t["fks"]:
                other = after if fk["table"] == table else self.rows(fk["table"])
                parent = other.select(*(F.col(c).alias(f"_p{i}") for i, c in enumerate(fk["references"])))
                mine = df.where(~_any([F.col(c).isNull() for c in fk["columns"]]))
                cond = _all([F.col(c) == F.col(f"_p{i}") for i, c in enumerate(fk["columns"])])
                if not mine.join(parent, cond, "left_anti").isEmpty():
                    raise ConstraintViolation(f"foreign key {fk['columns']}")
        moved = self._moved_references(table, df, key)
        self.now[table] = after
        self.changes.setdefault(table, []).append(df.withColumn("_op", F.lit("U")))
        for name, fk, pairs in moved:
            self._follow(name, fk, pairs, deep)

    def _moved_references(self, table: str, df: DataFrame, key: list[str]) -> list[tuple]:
        """(table, foreign key, old and new values) of the keys that refer to columns which the rows to write change."""
        out = []
        for name, other in self.cat["tables"].items():
            for fk in other["fks"]:
                if fk["table"] != table or set(fk["references"]) <= set(key):
                    continue
                old = self.rows(table).select(*key, *(F.col(c).alias(f"_o{i}") for i, c in enumerate(fk["references"])))
                new = df.select(*key, *(F.col(c).alias(f"_n{i}") for i, c in enumerate(fk["references"])))
                n = range(len(fk["references"]))
                pairs = old.join(new, key).where(_any([~F.col(f"_o{i}").eqNullSafe(F.col(f"_n{i}")) for i in n])).select(*(f"_o{i}" for i in n), *(f"_n{i}" for i in n))
                if not pairs.isEmpty():
                    out.append((name, fk, pairs))
        return out

    def _follow(self, name: str, fk: dict, pairs: DataFrame, deep: int) -> None:
        """What fk's on_update does with rows whose referenced values have changed: restrict (the default), cascade, set_null, set_default."""
        if deep >= CASCADE:
            raise ConstraintViolation(f"cascade deeper than {CASCADE}")
        rows, act = self.rows(name), fk.get("on_update", "restrict")
        hit = rows.join(pairs, _all([F.col(c) == F.col(f"_o{i}") for i, c in enumerate(fk["columns"])]))
        if hit.isEmpty():
            return
        if act == "restrict":
            raise ConstraintViolation(f"{name} refers to the row")
        fill = {c: F.col(f"_n{i}") if act == "cascade" else F.lit(None if act == "set_null" else self.spec(name)["defaults"].get(c)).cast(rows.schema[c].dataType) for i, c in enumerate(fk["columns"])}
        self.put(name, hit.withColumns(fill).select(*rows.columns), act == "set_default", deep + 1)

    def remove(self, table: str, df: DataFrame, deep: int = 0) -> None:
        """Deletes rows, acting on those that refer to them."""
        if deep > CASCADE:
            raise ConstraintViolation(f"cascade deeper than {CASCADE}")
        t = self.spec(table)
        for name, other in self.cat["tables"].items():
            for fk in other["fks"]:
                if fk["table"] != table:
                    continue
                gone = df.select(*(F.col(c).alias(f"_p{i}") for i, c in enumerate(fk["references"])))
                hit = self.rows(name).join(gone, _all([F.col(c) == F.col(f"_p{i}") for i, c in enumerate(fk["columns"])]), "left_semi")
                act = fk.get("on_delete", "restrict")
                if act == "cascade":
                    if not hit.isEmpty():
                        self.remove(name, hit, deep + 1)
                elif act in ("set_null", "set_default"):
                    fill = {c: F.lit(None if act == "set_null" else other["defaults"].get(c)).cast(hit.schema[c].dataType) for c in fk["columns"]}
                    if not hit.isEmpty():
                        self.put(name, hit.withColumns(fill), act == "set_default")
                elif not hit.isEmpty():
                    raise ConstraintViolation(f"{name} refers to the row")
        key = t["primary_key"]
        self.now[table] = self.rows(table).join(df.select(*key), key, "left_anti")
        self.changes.setdefault(table, []).append(df.withColumn("_op", F.lit("D")))

    # --- mutations -----------------------------------------------------------------------------------
    def apply(self, m: dict) -> None:
        kind = m["kind"]
        if "table" in m:
            m = {**m, "table": C.full_name(m["table"])}
            if not C.allowed(self.cat, self.caller, "table_write", m["table"]):
                raise PermissionDenied(f"{self.caller} may not write {m['table']}")
            if m["table"].startswith("_system/"):
                raise ValidationError("the table is managed by the engine")
        getattr(self, f"_{kind}")(m)

    def _insert(self, m: dict) -> None:
        df, key = self.incoming(m["table"], m["rows"]), self.spec(m["table"])["primary_key"]
        if not df.groupBy(*key).count().where("count > 1").isEmpty() or not df.join(self.rows(m["table"]), key, "left_semi").isEmpty():
            raise DuplicateKey(m["table"])
        self.put(m["table"], df)

    def _upsert(self, m: dict) -> None:
        df, key = self.incoming(m["table"], m["rows"]), self.spec(m["table"])["primary_key"]
        if not df.groupBy(*key).count().where("count > 1").isEmpty():
            raise DuplicateKey("a key twice in one batch")
        self.put(m["table"], df)

    def _upsert_on_conflict(self, m: dict) -> None:
        """target: columns of the conflict (the key by default); action nothing, merge, update, or with {column: update expression}."""
        t, df = self.spec(m["table"]), self.incoming(m["table"], m["rows"])
        key, target = t["primary_key"], m.get("target") or t["primary_key"]
        if list(target) != key:
            # On a unique target the row keeps the key that is there.
            old = self.rows(m["table"]).select(*target, *(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)))
            df = df.join(old, list(target), "left").select(*((F.coalesce(F.col(f"_k{key.index(c)}"), F.col(c)) if c in key else F.col(c)).alias(c) for c in df.columns))
        given = {k: _update_fn(v, k) for k, v in m.get("updates", {}).items()}
        self.put(m["table"], changelog.upsert(self.rows(m["table"]), df, key, m.get("action", "update"), given))

    def _delete(self, m: dict) -> None:
        key = self.spec(m["table"])["primary_key"]
        rows = self.rows(m["table"])
        keys = self.engine.spark.createDataFrame([tuple(k) for k in m["keys"]], T.StructType([T.StructField(c, rows.schema[c].dataType) for c in key]))
        hit = rows.join(keys, key, "left_semi")
        if not hit.isEmpty():
            self.remove(m["table"], hit)

    def _matching(self, m: dict) -> DataFrame:
        from cairn.plans.query import Scope, check_predicate

        if m.get("limit") == 0:
            raise ValidationError("limit 0")
        t, rows = self.spec(m["table"]), self.rows(m["table"])
        p = m["where"]
        if t["policy"] and self.caller:
            p = E.And(p, E.bind_caller(E.from_json(t["policy"]), self.caller))
        check_predicate(p, Scope({f.name: f for f in C.schema(t).fields}))
        hit = changelog.first_matches(rows, E.compile_predicate(p, F.col), t["primary_key"], m.get("limit"))
        if "expected" in m and hit.count() < m["expected"]:
            raise Conflict("fewer rows match")
        return hit

    def _delete_where(self, m: dict) -> None:
        hit = self._matching(m)
        if not hit.isEmpty():
            self.remove(m["table"], hit)

    def _update_where(self, m: dict) -> None:
        t, updates = self.spec(m["table"]), m["updates"]
        if not updates:
            raise ValidationError("no updates")
        hit, cols = self._matching(m), {c.name: c for c in C.columns(t)}
        for name, u in updates.items():
            if name in t["primary_key"]:
                raise ValidationError("key columns do not change")
            if name not in cols:
                raise NotFound(f"column {name}")
            hit = hit.withColumn(name, _update(u, cols[name], cols))
        try:
            nulls = [F.col(n).isNull() for n in updates if not cols[n].nullable]
            if nulls and not hit.where(_any(nulls)).isEmpty():
                raise TypeMismatch("null in a non-null column")
            if not hit.isEmpty():
                self.put(m["table"], hit)
        except Exception as e:
            if "ARITHMETIC_OVERFLOW" in str(e):
                raise Overflow(str(e)[:80]) from None
            raise

    _update_where_expr = _update_where

    def _update_fields(self, m: dict) -> None:
        key = self.spec(m["table"])["primary_key"]
        p = None
        for k, v in zip(key, m["key"], strict=True):
            leaf = E.Compare("=", k, v)
            p = leaf if p is None else E.And(p, leaf)
        if self.rows(m["table"]).where(E.compile_predicate(p, F.col)).isEmpty():
            raise NotFound("row")
        self._update_where({**m, "where": p})

    def _table_add_u256(self, m: dict) -> None:
        """Adds a (possibly negative) amount to a U256 column of one row, checked."""
        key = self.spec(m["table"])["primary_key"]
        hit = self.rows(m["table"]).where(_all([F.col(k) == F.lit(v) for k, v in zip(key, m["key"], strict=True)]))
        row = hit.first()
        if row is None:
            raise NotFound("row")
        new = u256(from_u256(bytes(row[m["column"]])) + m["amount"])
        self.put(m["table"], hit.withColumn(m["column"], F.lit(new)))

    # KV: values are read once per key from the working state.
    def _kv_state(self) -> dict:
        if not hasattr(self, "kv"):
            self.kv: dict = {}
        return self.kv

    def kv_read(self, ns: str, keys: list[bytes]) -> dict:
        state = self._kv_state()
        need = [k for k in keys if (ns, k) not in state]
        if need:
            for k in need:
                state[ns, k] = (None, None, 0, False)
            for k, (value, created) in self.engine.kv_at(ns, need, self.base).items():
                state[ns, k] = (value, created, 0, False)
        return {k: state[ns, k][0] for k in keys}

    def _kv_write(self, ns: str, key: bytes, value: bytes | None) -> None:
        if not C.allowed(self.cat, self.caller, "kv_write", ns):
            raise PermissionDenied(f"{self.caller} may not write {ns}")
        self.kv_read(ns, [key])
        old = self._kv_state()[ns, key]
        self.kv[ns, key] = (value, old[1] if old[0] is not None else self.base + 1, 0, True)

    def _kv_set(self, m: dict) -> None:
        self._kv_write(m.get("ns", "main/app"), m["key"], m["value"])

    def _kv_del(self, m: dict) -> None:
        self._kv_write(m.get("ns", "main/app"), m["key"], None)

    def _kv_number(self, m: dict) -> None:
        """op: add, sub, max, min, set, on big-endian unsigned numbers of `width` 8 or 32 bytes, or signed 8 with bounds.

        missing: zero or reject; overflow: reject or saturate; underflow: reject or noop."""
        ns, key, width, op, n = m.get("ns", "main/app"), m["key"], m.get("width", 8), m["op"], m["amount"]
        signed, top = m.get("signed", False), MAX_U256 if m.get("width", 8) == 32 else (1 << 64) - 1
        low, high = (m.get("low", -(1 << 63)), m.get("high", (1 << 63) - 1)) if signed else (0, top)
        raw = self.kv_read(ns, [key])[key]
        if raw is None and m.get("missing", "zero") == "reject":
            raise NotFound("key")
        if raw is not None and len(raw) != width:
            raise TypeMismatch("the value is no number of that width")
        old = int.from_bytes(raw, "big", signed=signed) if raw is not None else 0
        if "expected" in m and (None if raw is None else old) != m["expected"]:
            raise Conflict("another value")
        new = {"add": old + n, "sub": old - n, "max": max(old, n), "min": n if raw is None else min(old, n), "set": n}[op]
        if new > high:
            if m.get("overflow", "reject") == "reject":
                raise Overflow("over the bound")
            new = high
        if new < low:
            if m.get("underflow", "reject") == "reject":
                raise Underflow("under the bound")
            return
        if op in ("max", "min") and raw is not None and new == old:
            return
        self._kv_write(ns, key, new.to_bytes(width, "big", signed=signed))

    def _counter_add(self, m: dict) -> None:
        """Adds to one shard of a counter, chosen by the hint."""
        shards = m.get("shards", 16)
        if not 1 <= shards <= 4096:
            raise ValidationError("1 to 4096 shards")
        shard = int.from_bytes(hashlib.sha256(str(m.get("hint", "")).encode()).digest()[:4], "big") % shards
        self._kv_number({"ns": m.get("ns", "main/app"), "key": b"ctr:" + m["key"] + b":%04d" % shard, "op": "add", "amount": m["amount"]})

    def _emit(self, m: dict) -> None:
        if not isinstance(m["payload"], str):
            m = {**m, "payload": json.dumps(m["payload"])}
        json.loads(m["payload"])
        self.out = [e for e in self.out if (e[4], e[5]) != (m["topic"], m["key"])]
        self.out.append((self.base + 1, m.get("ts_micros", int(time.time() * 1e6)), m.get("project", "main"), m.get("scope", "app"), m["topic"], m["key"], m["payload"]))

    def _ddl(self, m: dict) -> None:
        op = m["op"]
        for name in ("table",):
            if name in op:
                op = {**op, name: C.full_name(op[name])}
        if not C.allowed(self.cat, self.caller, "table_ddl", op.get("table", op.get("project", "*"))):
            raise PermissionDenied(f"{self.caller} may not change the catalog")
        if op["op"] == "alter_table" and op["change"] in ("add_unique", "add_check"):
            rows = self.rows(op["table"])
            if op["change"] == "add_unique" and not rows.where(~_any([F.col(c).isNull() for c in op["columns"]])).groupBy(*op["columns"]).count().where("count > 1").isEmpty():
                raise ConstraintViolation("rows are not unique")
            if op["change"] == "add_check" and not rows.where(~F.coalesce(E.compile_predicate(E.from_json(op["check"]), F.col), F.lit(False))).isEmpty():
                raise ConstraintViolation("rows fail the check")
        self.change_catalog(op)

    def change_catalog(self, op: dict) -> None:
        self.cat, changed = C.apply_ddl(self.cat, op)
        if changed:
            self.ddl.append(op)
            if op["op"] == "create_table":
                self.made.add(op["table"])
            self.now.pop(op.get("table"), None)

    # Order books (sources.book).
    def _book_instrument(self, m: dict) -> None:
        if not C.allowed(self.cat, self.caller, "table_ddl", book.INSTRUMENTS):
            raise PermissionDenied(f"{self.caller} may not define instruments")
        book.define(self, m)

    def _order_book(self, m: dict) -> None:
        if not C.allowed(self.cat, self.caller, "table_write", book.ORDERS):
            raise PermissionDenied(f"{self.caller} may not send orders")
        book.run(self, m)

    def _postflight(self, m: dict) -> None:
        self.check(m["assertions"])

    # --- assertions -----------------------------------------------------------------------------------
    def check(self, assertions: list[dict]) -> None:
        for a in assertions:
            if not self.holds(a):
                raise AssertionFailed(json.dumps({k: repr(v) for k, v in a.items()}))

    def holds(self, a: dict, deep: int = 0) -> bool:
        if deep > 16:
            raise ValidationError("assertions deeper than 16")
        kind = a["kind"]
        if kind == "all":
            return all(self.holds(x, deep + 1) for x in a["of"])
        if kind == "any":
            return any(self.holds(x, deep + 1) for x in a["of"])
        if kind == "not":
            return not self.holds(a["of"], deep + 1)
        if kind.startswith("key_"):
            ns, key = a.get("ns", "main/app"), a["key"]
            value = self.kv_read(ns, [key])[key]
            if kind == "key_exists":
                return (value is not None) == a.get("expected", True)
            if kind == "key_equals":
                return value == a["value"]
            if kind == "key_version":
                log = self.engine.change_log(KV_TABLE, self.base).where((F.col("ns") == ns) & (F.col("key") == F.lit(key)))
                return (log.agg(F.max("_seq")).first()[0] or 0) == a["version"]
            return value is not None and E.OPS[a["op"]](value, a["value"])  # equal widths compare as numbers
        table = C.full_name(a["table"])
        if kind.startswith("row_"):
            key = self.spec(table)["primary_key"]
            mine = _all([F.col(k) == F.lit(v) for k, v in zip(key, a["key"], strict=True)])
            if kind == "row_version":
                return (self.engine.change_log(table, self.base).where(mine).agg(F.max("_seq")).first()[0] or 0) == a["version"]
            row = self.rows(table).where(mine).first()
            if kind == "row_exists":
                return (row is not None) == a.get("expected", True)
            return row is not None and row[a["column"]] is not None and E.OPS[a["op"]](row[a["column"]] if not isinstance(row[a["column"]], bytearray) else bytes(row[a["column"]]), a["value"])
        rows = self.rows(table)
        if a.get("where") is not None:
            rows = rows.where(E.compile_assertion_filter(a["where"], F.col))
        if kind == "count_compare":
            return E.OPS[a["op"]](rows.count(), a["threshold"])
        if kind == "sum_compare":
            col = next(c for c in C.columns(self.spec(table)) if c.name == a["column"])
            if col.type == "u256":
                return E.OPS[a["op"]](from_limbs(rows.agg(*limb_sums(F.col(col.name))).first()), a["threshold"])
            try:
                total = rows.agg(F.sum(a["column"])).first()[0] or 0
            except Exception as e:
                if "ARITHMETIC_OVERFLOW" in str(e):
                    raise Overflow("sum over 64 bits") from None
                raise
            return E.OPS[a["op"]](total, a["threshold"])
        raise ValidationError(f"no assertion {kind}")

    # --- publishing --------------------------------------------------------------------------------------
    def publish(self, idempotency: dict | None, write_class: str = "standard") -> bool:
        seq, files = self.base + 1, {}
        for table, parts in self.changes.items():
            if table not in self.cat["tables"]:
                continue
            t = self.spec(table)
            names = [c["name"] for c in t["columns"]]
            steps = None
            for i, p in enumerate(parts):
                have = set(p.columns)
                p = p.select(*(F.col(n) if n in have else F.lit(None).cast(SPARK[c["type"]]).alias(n) for n, c in zip(names, t["columns"], strict=True)), "_op", F.lit(i).alias("_ord"))
                steps = p if steps is None else steps.union(p)
            key = t["primary_key"]
            if len(parts) > 1:
                rest = [n for n in names if n not in key]
                steps = steps.groupBy(*key).agg(F.max_by(F.struct("_op", *rest), "_ord").alias("v")).select(*key, *(F.col(f"v.{n}").alias(n) for n in rest), F.col("v._op").alias("_op"))
            out = steps.select(*(F.col(c["name"]).alias(f"c{c['id']}") for c in t["columns"]), F.lit(seq).cast("long").alias("_seq"), F.col("_op"))
            files[table] = self.engine.write(out, table)
        kv = [(ns, k, v, created, seq, "D" if v is None else "U") for (ns, k), (v, created, _, dirty) in self._kv_state().items() if dirty]
        inline = sum(len(ns.encode()) + len(k) + len(v or b"") for ns, k, v, *_ in kv) <= INLINE
        if kv and not inline:
            files[KV_TABLE] = self.engine.write(self.engine.spark.createDataFrame(kv, _KV).coalesce(1), KV_TABLE)
        if self.out:
            files[EVENTS] = self.engine.write(self.engine.spark.createDataFrame(self.out, _EVENT).coalesce(1), EVENTS)
        return self.engine.publish({"ddl": self.ddl, "files": files, "write_class": write_class} | ({"kv": [[ns, k.hex(), None if v is None else v.hex(), created] for ns, k, v, created, *_ in kv]} if kv and inline else {}) | ({"idempotency": idempotency} if idempotency else {}))


def _children_first(tables: dict) -> list[str]:
    """Tables in an order in which each goes before those that it refers to."""
    out: list[str] = []
    while len(out) < len(tables):
        left = {t: x for t, x in tables.items() if t not in out}
        referred = {fk["table"] for t, x in left.items() for fk in x["fks"] if fk["table"] != t}
        out += [t for t in left if t not in referred]
    return out


def _any(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def _all(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def _after(columns: list, values: list):
    """Rows whose key comes after `values`."""
    out, same = F.lit(False), F.lit(True)
    for c, v in zip(columns, values, strict=True):
        out, same = out | (same & (c > F.lit(v))), same & (c == F.lit(v))
    return out


def _to_json(v):
    return {"b": v.hex()} if isinstance(v, bytes) else {"d": str(v)} if isinstance(v, decimal.Decimal) else v


def _from_json(v):
    return (bytes.fromhex(v["b"]) if "b" in v else decimal.Decimal(v["d"])) if isinstance(v, dict) else v


def _update(u, column, columns):
    """value, ("copy", column), ("add", n) or ("coalesce", value), of a row in progress."""
    if isinstance(u, tuple):
        kind, v = u
        if kind == "copy":
            if columns[v].type != column.type:
                raise TypeMismatch("copy between types")
            return F.col(v)
        if kind == "add":
            if column.type != "integer" or column.nullable:
                raise TypeMismatch("add needs a non-null integer column")
            return F.col(column.name) + F.lit(v).cast("long")
        if kind == "coalesce":
            return F.coalesce(F.col(column.name), F.lit(check_value(column, v)))
        raise InvalidQuery(f"no update {kind}")
    if not literal_fits(u, column.type):
        raise TypeMismatch(f"{column.name} is {column.type}")
    return F.lit(check_value(column, u)).cast(SPARK[column.type])


def _update_fn(u, name: str):
    """Of an existing and a proposed value: "existing", "proposed", ("add", n) saturating, or a value."""
    if u == "existing":
        return lambda old, new: old
    if u == "proposed":
        return lambda old, new: new
    if isinstance(u, tuple) and u[0] == "add":
        top = F.lit((1 << 63) - 1 if u[1] >= 0 else -(1 << 63))
        return lambda old, new: F.coalesce(F.try_add(old, F.lit(u[1]).cast("long")), top)
    return lambda old, new: F.lit(u)
