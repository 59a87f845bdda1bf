"""Reactive processors: checkpointed micro-batch consumers of the event log, and change streams of tables.

`Processor.run_once` pulls whole commits after its checkpoint, calls the handler, and commits what the
handler returns together with the new checkpoint: effects and progress are one commit. A failing batch
is tried again with exponential backoff and then becomes a dead letter. `stream_events` and
`stream_changes` expose the same log to Structured Streaming.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cairn.operators import eventlog
from cairn.operators.tasks import Records
from cairn.plans.errors import ValidationError
from cairn.sources.catalog import full_name, stored_schema
from cairn.sources.store import _EVENT, EVENTS, Engine


@dataclass(frozen=True)
class Options:
    """A batch ends with the first commit that brings it to max_events or max_bytes of payload; a run, after max_duration_ms.

    The checkpoint is written with the effects that bring it watermark_commits on. With more than one, effects of batches in
    between are committed at once and the checkpoint later, so after a crash they are delivered again."""

    topic: str | None = None
    max_events: int = 256
    max_bytes: int = 2 << 20
    max_duration_ms: float | None = None
    watermark_commits: int = 1
    max_retries: int = 3
    retry_backoff_ms: int = 100
    run_on_interval: bool = False
    max_lag_commits: int = 10_000
    max_idle_ms: float = 60_000


class Processor:
    def __init__(self, engine: Engine, name: str, handler, options: Options = Options()):
        """handler(rows DataFrame) -> list of mutations or None."""
        self.engine, self.name, self.handler, self.options = engine, name, handler, options
        self.checkpoints, self.registry, self.dead = (Records(engine, p) for p in ("processor", "processor_registry", "processor_dead"))
        self.failures = 0
        self.position: int | None = None  # handled, beyond the checkpoint
        # Registering anew never moves the checkpoint.
        self.registry.change((name,), lambda old: ({"topic": options.topic, "state": "running"} if old is None else ..., None))
        self.last_progress = time.monotonic()

    def checkpoint(self) -> int:
        return (self.checkpoints.get(self.name) or {"seq": 0})["seq"]

    def acknowledge(self, seq: int, mutations: list[dict] = ()) -> None:
        def on(old):
            if old is not None and seq < old["seq"]:
                raise ValidationError("the checkpoint would go back")
            return {"seq": seq}, None

        self.checkpoints.change((self.name,), on, list(mutations))

    def state(self) -> str:
        return (self.registry.get(self.name) or {"state": "stopped"})["state"]

    def _set(self, state: str) -> None:
        self.registry.change((self.name,), lambda old: ({**(old or {}), "state": state}, None))

    def pause(self) -> None:
        self._set("paused")

    def resume(self) -> None:
        self._set("running")

    def stop(self) -> None:
        self._set("stopped")

    def pull(self) -> tuple[DataFrame, int | None]:
        """(events after the checkpoint, up to a commit boundary; last commit of them)."""
        rows, _ = eventlog.read_stream(self.engine.events(), self.options.topic, max(self.checkpoint(), self.position or 0), self.options.max_events)
        # At most max_events rows and the rest of their last commit.
        sizes = rows.groupBy("commit_seq").agg(F.sum(F.octet_length("payload")).alias("n")).orderBy("commit_seq").collect()
        last, total = None, 0
        for r in sizes:
            if last is not None and total + (r["n"] or 0) > self.options.max_bytes:
                return rows.where(F.col("commit_seq") <= last), last
            last, total = r["commit_seq"], total + (r["n"] or 0)
        return rows, last

    def _done(self, last: int, mutations: list[dict]) -> None:
        if last - self.checkpoint() >= self.options.watermark_commits:
            self.acknowledge(last, mutations)
            self.position = None
            return
        if mutations:
            self.engine.commit(*mutations)
        self.position = last

    def flush(self) -> None:
        """Writes the checkpoint of what was handled."""
        if self.position is not None:
            self.acknowledge(self.position)
            self.position = None

    def context(self) -> Context:
        return Context(self)

    def run_once(self, sleep=time.sleep) -> int:
        """Handles one batch; returns how many events it had. Retries, then dead-letters and moves on."""
        if self.state() != "running":
            return 0
        rows, last = self.pull()
        if last is None:
            if self.options.run_on_interval:
                self.handler(rows)
            return 0
        for attempt in range(1, self.options.max_retries + 2):
            try:
                self._done(last, self.handler(rows) or [])
                self.failures, self.last_progress = 0, time.monotonic()
                return rows.count()
            except Exception as e:  # the handler's fault, whatever it is
                self.failures += 1
                if attempt > self.options.max_retries:
                    letter = {"error": str(e)[:500], "from": self.checkpoint(), "to": last, "events": rows.count()}
                    self.acknowledge(last, [self.dead._write((self.name, f"{last:020d}"), letter)])
                    self.position = None
                    return 0
                sleep(eventlog.backoff(self.options.retry_backoff_ms, attempt) / 1000)
        return 0

    def run_until_idle(self, most: int = 1000) -> int:
        """Batch after batch until nothing is left, most batches were run or max_duration_ms is over; then writes the checkpoint."""
        total, began, limit = 0, time.monotonic(), self.options.max_duration_ms
        for _ in range(most):
            before = (self.checkpoint(), self.position)
            total += self.run_once()
            if (self.checkpoint(), self.position) == before or limit is not None and (time.monotonic() - began) * 1000 >= limit:
                break
        self.flush()
        return total

    def dead_letters(self) -> list[dict]:
        return [v for _, v in self.dead.list(self.name)]

    def lag(self) -> int:
        head = self.engine.events().agg(F.max("commit_seq")).first()[0] or 0
        return max(0, head - self.checkpoint())

    def slo(self) -> dict:
        behind, idle = self.lag(), (time.monotonic() - self.last_progress) * 1000
        return {"processor": self.name, "lag": behind, "idle_ms": idle, "status": eventlog.health(behind, self.options.max_lag_commits, idle, self.options.max_idle_ms), "failures": self.failures}


class Context:
    """One batch by hand: pull it, read and write with one's own pending writes in sight, and commit those with the checkpoint."""

    def __init__(self, processor: Processor):
        self.processor, self.engine = processor, processor.engine
        self.events, self.last = processor.pull()
        self.view = self.engine.view()
        self.rows: dict[tuple, dict | None] = {}
        self.kv: dict[tuple[str, bytes], bytes | None] = {}
        self.emitted: list[dict] = []

    def _key(self, table: str) -> list[str]:
        return self.view.primary_key(table)

    def read(self, table: str, *key) -> dict | None:
        at = (full_name(table), key)
        if at in self.rows:
            return None if self.rows[at] is None else dict(self.rows[at])
        rows = self.view.table(table)
        for c, v in zip(self._key(table), key, strict=True):
            rows = rows.where(F.col(c) == F.lit(v))
        r = rows.first()
        return None if r is None else r.asDict()

    def write(self, table: str, row: dict) -> None:
        self.rows[full_name(table), tuple(row[c] for c in self._key(table))] = dict(row)

    def delete(self, table: str, *key) -> None:
        self.rows[full_name(table), key] = None

    def kv_get(self, key: bytes, ns: str = "main/app") -> bytes | None:
        return self.kv[ns, key] if (ns, key) in self.kv else self.view.kv_get(key, ns)

    def kv_set(self, key: bytes, value: bytes | None, ns: str = "main/app") -> None:
        self.kv[ns, key] = value

    def emit(self, topic: str, key: str, payload) -> None:
        self.emitted.append({"kind": "emit", "topic": topic, "key": key, "payload": payload})

    def mutations(self) -> list[dict]:
        out: list[dict] = []
        for table in dict.fromkeys(t for t, _ in self.rows):
            mine = {k: r for (t, k), r in self.rows.items() if t == table}
            if gone := [k for k, r in mine.items() if r is None]:
                out.append({"kind": "delete", "table": table, "keys": gone})
            if kept := [r for r in mine.values() if r is not None]:
                out.append({"kind": "upsert", "table": table, "rows": kept})
        out += [{"kind": "kv_del", "ns": ns, "key": k} if v is None else {"kind": "kv_set", "ns": ns, "key": k, "value": v} for (ns, k), v in self.kv.items()]
        return out + self.emitted

    def commit(self) -> None:
        """Pending writes and the checkpoint of the batch, in one commit."""
        if self.last is not None:
            self.processor.acknowledge(self.last, self.mutations())
            self.processor.position = None
        elif pending := self.mutations():
            self.engine.commit(*pending)
        self.rows, self.kv, self.emitted = {}, {}, []


def list_processors(engine: Engine) -> list[dict]:
    rows = engine.view().kv_scan(b"processor_registry\0", ns="_system/app").collect()
    return [{"processor": bytes(r["key"]).decode().split("\0")[1], **json.loads(bytes(r["value"]))} for r in rows]


def enforce(processors: list[Processor]) -> None:
    bad = [s for s in (p.slo() for p in processors) if s["status"] != "healthy"]
    if bad:
        raise ValidationError(f"behind: {', '.join(s['processor'] for s in bad)}")


def _file_system(uri: str):
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return (fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")) if uri.startswith("file:") else fs.FileSystem.from_uri(uri)


def _committed(engine: Engine, table: str, schema: T.StructType) -> DataFrame:
    """The rows that commits added to a table, as a stream of the log itself.

    The log's entries are the stream's files: each appears once and whole, and names the data files of its commit. Data files
    of lost attempts, checkpoints and compacted events are named by no entry's `files`, so they are never read. Reading is
    dealt by file, so a large commit spreads over many tasks."""
    spark, root = engine.spark, engine.root
    folders = T.MapType(T.StringType(), T.ArrayType(T.StringType()))
    log = spark.readStream.schema("value string").option("wholetext", "true").option("pathGlobFilter", "*.json").text(f"{root}/log")
    named = log.select(F.explode(F.from_json("value", T.StructType([T.StructField("files", folders)]))["files"][table]).alias("folder"))

    def parts(batches):
        import pyarrow as pa
        from pyarrow import fs

        for b in batches:
            found = []
            for folder in b.column(0).to_pylist():
                system, path = _file_system(f"{root}/{folder}")
                found += [x.path for x in system.get_file_info(fs.FileSelector(path)) if x.is_file and not x.base_name.startswith(("_", "."))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["path"])

    def read(batches):
        import pyarrow.dataset as ds
        from pyspark.sql.pandas.types import to_arrow_schema

        system, wanted = _file_system(root)[0], to_arrow_schema(schema)
        for b in batches:
            for path in b.column(0).to_pylist():
                yield from ds.dataset(path, schema=wanted, format="parquet", filesystem=system).to_batches()

    return named.mapInArrow(parts, "path string").repartition("path").mapInArrow(read, schema)


def stream_events(engine: Engine, topic: str | None = None) -> DataFrame:
    """The event log as a stream; each commit is one set of files."""
    df = _committed(engine, EVENTS, _EVENT)
    return df if topic is None else df.where(F.col("topic") == topic)


def stream_changes(engine: Engine, table: str) -> DataFrame:
    """A table's changes as a stream, each once, with _seq and _op."""
    full = full_name(table)
    t = engine.catalog(engine.refresh())["tables"][full]
    df = _committed(engine, full, stored_schema(t))
    return df.select(*(F.col(f"c{c['id']}").alias(c["name"]) for c in t["columns"]), "_seq", "_op")


def for_each_batch(stream: DataFrame, handler, checkpoint: str, available_now: bool = True, interval: str = "1 second") -> StreamingQuery:
    """Runs handler(batch, batch id) per micro-batch; offsets live under `checkpoint`, the batch id makes a repeat recognisable."""
    w = stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)).start()


def materialise_latest(stream: DataFrame, key: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the latest row per key of a change stream as Parquet versions under `path`; version n is written whole before n + 1 begins."""
    values = [c for c in stream.columns if c not in key]

    def fold(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        if n:
            batch = spark.read.schema(batch.schema).parquet(f"{path}/v{n - 1}").unionByName(batch)
        latest = batch.groupBy(*key).agg(F.max_by(F.struct(*values), "_seq").alias("v")).select(*key, *(F.col(f"v.{c}").alias(c) for c in values))
        latest.write.mode("overwrite").parquet(f"{path}/v{n}")

    return for_each_batch(stream, fold, checkpoint)


def windowed_counts(stream: DataFrame, time_column: str, key: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Event-time counts per key, with a watermark (beyond what the other parts need)."""
    return stream.withWatermark(time_column, late).groupBy(F.window(time_column, width), key).agg(F.count(F.lit(1)).alias("n"))
