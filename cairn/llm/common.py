"""What the operators of this subpackage share: cut lineage, shared folder, text access."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one Python step works on at a time.
CHUNK_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session, where driver and executors are one process, may do without: it gets a temporary
    folder. On a cluster an unset folder is an error, since executors share no local disk."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="cairn-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/cairn-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: survives lost executors, cleaned by Spark when no longer referenced."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder (columnar and compressed, for wider rows)."""
    spark = df.sparkSession
    path = path or shared_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(column: str = "text") -> Column:
    """The whole text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def sliced(column: pa.Array, limit: int = CHUNK_BYTES):
    """Index ranges of consecutive values of a text or binary column, of about `limit` bytes each and one value at least; nothing is copied into Python."""
    end = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo, done = 0, 0
    while lo < len(end):
        hi = max(lo + 1, int(np.searchsorted(end, done + limit, "right")))
        yield lo, hi
        lo, done = hi, int(end[hi - 1])


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, made longer until none is a column already (Spark ignores case)."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out
