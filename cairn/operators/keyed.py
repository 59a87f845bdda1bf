"""Queries of the keyed primitives: KV scans, sharded counters, queue order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def next_prefix(prefix: bytes) -> bytes | None:
    """The least key above all keys with the prefix; None if there is none."""
    p = bytearray(prefix)
    while p and p[-1] == 0xFF:
        p.pop()
    if not p:
        return None
    p[-1] += 1
    return bytes(p)


def kv_range(kv: DataFrame, low: bytes | None = None, high: bytes | None = None, low_open: bool = False, high_open: bool = True) -> DataFrame:
    """kv(key BINARY, ...) between bounds, in key order; binary order is unsigned."""
    if low is not None:
        kv = kv.where(F.col("key") > F.lit(low) if low_open else F.col("key") >= F.lit(low))
    if high is not None:
        kv = kv.where(F.col("key") < F.lit(high) if high_open else F.col("key") <= F.lit(high))
    return kv.orderBy("key")


def kv_prefix(kv: DataFrame, prefix: bytes, limit: int | None = None, after: bytes | None = None) -> DataFrame:
    out = kv_range(kv, prefix, next_prefix(prefix))
    if after is not None:
        out = out.where(F.col("key") > F.lit(after))
    return out if limit is None else out.limit(limit)


def kv_get_many(kv: DataFrame, keys: list[bytes]) -> DataFrame:
    return kv.where(F.col("key").isin(*keys))


def counter_totals(deltas: DataFrame) -> DataFrame:
    """(key, total) of deltas(key, delta): shards are added by partial aggregation."""
    return deltas.groupBy("key").agg(F.sum("delta").alias("total"))


def claimable(jobs: DataFrame, now: int, n: int) -> DataFrame:
    """The next n jobs: ready or delayed and due, or leased and expired; highest priority first, then first in."""
    due = ((F.col("state") == "ready") & (F.col("not_before") <= now)) | ((F.col("state") == "leased") & (F.col("lease_until") <= now))
    return jobs.where(due).orderBy(F.col("priority").desc(), F.col("seq").asc()).limit(n)
