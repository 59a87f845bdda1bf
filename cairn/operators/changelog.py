"""Change logs as DataFrames: rows of a table plus _seq (commit) and _op ('U' or 'D').

A snapshot is the last change of each key up to a commit; max_by combines map-side, so only one
row per key and task is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQ, OP = "_seq", "_op"


def snapshot(log: DataFrame, key: list[str], seq: int | None = None) -> DataFrame:
    """The table at a commit (all of the log if None)."""
    if seq is not None:
        log = log.where(F.col(SEQ) <= seq)
    values = [c for c in log.columns if c not in (*key, SEQ, OP)]
    last = log.groupBy(*key).agg(F.max_by(F.struct(OP, *values), SEQ).alias("_last")).where(F.col(f"_last.{OP}") == "U")
    return last.select(*[F.col(c) if c in key else F.col(f"_last.{c}").alias(c) for c in log.columns if c not in (SEQ, OP)])


def deltas(log: DataFrame, after: int, until: int) -> DataFrame:
    """Changes of commits in (after, until]."""
    return log.where((F.col(SEQ) > after) & (F.col(SEQ) <= until))


def row_changes(log: DataFrame, key: list[str], after: int, until: int) -> DataFrame:
    """(key, kind) per key changed in (after, until]: Insert, Update or Delete, against the snapshot at `after`."""
    old = snapshot(log, key, after).select(*key, F.lit(True).alias("_was"))
    new = deltas(log, after, until).groupBy(*key).agg(F.max_by(OP, SEQ).alias(OP))
    both = new.join(old, key, "left")
    was = F.col("_was").isNotNull()
    kind = F.when((F.col(OP) == "D") & was, "Delete").when(F.col(OP) == "D", None).when(was, "Update").otherwise("Insert")
    return both.select(*key, kind.alias("kind")).where("kind is not null")


def changes(df: DataFrame, seq: int, op: str = "U") -> DataFrame:
    return df.withColumn(SEQ, F.lit(seq).cast("long")).withColumn(OP, F.lit(op))


def first_matches(df: DataFrame, predicate, key: list[str], limit: int | None) -> DataFrame:
    """Matching rows in key order, the first `limit` of them."""
    hit = df.where(predicate)
    return hit if limit is None else hit.orderBy(*key).limit(limit)


def upsert(current: DataFrame, proposed: DataFrame, key: list[str], action: str = "update", expressions: dict | None = None) -> DataFrame:
    """Rows to write when `proposed` meets existing keys.

    action: "nothing" keeps the old row, "update" takes the proposed one, "merge" takes proposed
    values that are not null, "with" applies `expressions` (column -> f(existing, proposed))."""
    values = [c for c in current.columns if c not in key]
    old = current.select(*key, F.struct(*values).alias("_old")) if values else current.select(*key, F.lit(1).alias("_old"))
    both = proposed.select(*key, *(F.col(c).alias(f"_new_{c}") for c in values)).join(old, key, "left")
    is_new = F.col("_old").isNull()
    if action == "nothing":
        both = both.where(is_new)

    def value(c: str):
        new, was = F.col(f"_new_{c}"), F.col(f"_old.{c}")
        if action == "merge":
            return F.when(is_new, new).otherwise(F.coalesce(new, was))
        if action == "with":
            e = (expressions or {}).get(c)
            return F.when(is_new, new).otherwise(e(was, new) if e else was)
        return new

    return both.select(*(F.col(c) if c in key else value(c).alias(c) for c in current.columns))


def applied(current: DataFrame, written: DataFrame, key: list[str], deleted: DataFrame | None = None) -> DataFrame:
    """The table after writing rows and deleting keys."""
    gone = written.select(*key)
    if deleted is not None:
        gone = gone.union(deleted.select(*key))
    return current.join(gone.distinct(), key, "left_anti").unionByName(written)
