"""SimHash near-duplicates by anchor-point covering.

Each text gets a 64-bit SimHash over word shingles. Two fingerprints that differ in at most
three bits differ in at most one bit of one 32-bit half. The perfect [31,26] Hamming code
covers 31 bits of a half with radius one, so every fingerprint is replicated to all code words
("anchors") within radius 1 + 1 of each half: 16 anchors, or 1 if it is a code word. Both
fingerprints of a close pair then meet at the anchor nearest to either; fingerprints are
compared per anchor only. Links go into distributed connected components.

Exact copies collapse to one fingerprint before anything is replicated. An anchor with more
than HOT_ANCHOR fingerprints is dealt anew by the bytes of its other half (of four bytes with
three differences one is equal), so it spreads over many tasks and no link is lost.

Defined cases: a null text is an empty one; a text without words has fingerprint zero and is
linked like any other; repeated rows and equal texts share a component; a null doc_id stays in
the result and counts for no component_id unless all of its component are null; a bit that exactly
half of the hashes have is 0; texts are taken whole, one in memory at a time; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_bytes
from .components import components

SHINGLE, BITS, HOT_ANCHOR = 3, 3, 4096
SEED = 42
_SLICE = 1 << 16


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    words = text.lower().split()  # bytes: lower-cases A-Z only and splits at 09-0D and 20 only
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, max(1, len(words) - k + 1))


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """Unsigned 64 bits; a bit is set if set in over half of the shingle hashes."""
    h = shingle_hashes(text, k)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), _SLICE):
        part = np.ascontiguousarray(h[i : i + _SLICE])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, th) of every row; fp is the fingerprint as a signed long, th a hash of the text."""

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), b.column(2)], names=["doc_id", "fp", "th"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("t"), F.xxhash64("text").alias("th")).mapInArrow(run, "doc_id long, fp long, th long")


def _flips() -> np.ndarray:
    """By syndrome, the masks that lead from a 31-bit word to its anchors. Row 0 has one anchor, padded with itself."""
    table = np.zeros((32, 16), np.uint64)
    for s in range(1, 32):
        masks = [1 << (s - 1)] + [1 << (i - 1) | 1 << ((i ^ s) - 1) for i in range(1, 32) if i < i ^ s]
        table[s] = masks
    return table


def anchors_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor key, index of the fingerprint) for every replica."""
    flips, keys, index = _flips(), [], []
    for half in (0, 1):
        x = (fps >> np.uint64(32 * half)) & np.uint64(0x7FFFFFFF)
        syndrome = np.zeros(len(x), np.uint64)
        for i in range(1, 32):
            syndrome ^= ((x >> np.uint64(i - 1)) & np.uint64(1)) * np.uint64(i)
        a = (x[:, None] ^ flips[syndrome.astype(np.int64)]) | np.uint64(half << 31)
        real = np.ones(a.shape, bool)
        real[syndrome == 0, 1:] = False
        keys.append(a[real])
        index.append(np.broadcast_to(np.arange(len(x))[:, None], a.shape)[real])
    return np.concatenate(keys).view(np.int64), np.concatenate(index)


def star_links(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within `bits` among distinct fingerprints: each member with its group's first."""
    rest, a, b = np.sort(fps), [], []
    while len(rest) > 1:
        seed, frontier, rest = rest[0], rest[:1], rest[1:]
        while len(frontier) and len(rest):
            near = np.zeros(len(rest), bool)
            step = max(1, 4_000_000 // len(rest))
            for i in range(0, len(frontier), step):
                near |= (np.bitwise_count(frontier[i : i + step, None] ^ rest[None, :]) <= bits).any(axis=0)
            frontier, rest = rest[near], rest[~near]
            a.append(frontier)
            b.append(np.full(len(frontier), seed))
    return (np.concatenate(a), np.concatenate(b)) if a else (rest[:0], rest[:0])


def _runs(batches, bits: int, hot: int | None):
    """Streams rows (key, fp) sorted by key. Yields links; a key of more than `hot` rows goes out unlinked for a second deal."""
    keys, fps, hot_key = np.zeros(0, np.int64), np.zeros(0, np.uint64), None

    def close(k, f, out):
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        ends = np.r_[starts[1:], len(k)]
        length = ends - starts
        small = np.flatnonzero((length > 1) & (length <= 12))
        for d in range(1, 12):
            i = np.concatenate([starts[small][length[small] > d + j] + j for j in range(12 - d)]) if len(small) else starts[:0]
            if not len(i):
                break
            i = i[np.bitwise_count(f[i] ^ f[i + d]) <= bits]
            out.append((f[i], f[i + d]))
        for r in np.flatnonzero(length > 12):
            out.append(star_links(np.unique(f[starts[r] : ends[r]]), bits))

    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
        fps = np.concatenate([fps, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        out: list = []
        if hot_key is not None:
            n = int(np.searchsorted(keys, hot_key, side="right"))
            yield from _deferred(keys[:n], fps[:n])
            keys, fps, hot_key = keys[n:], fps[n:], hot_key if n == len(keys) else None
        if not len(keys):
            continue
        done = int(np.searchsorted(keys, keys[-1], side="left"))
        if done:
            head_k, head_f = keys[:done], fps[:done]
            if hot is not None:
                starts = np.flatnonzero(np.r_[True, head_k[1:] != head_k[:-1]])
                over = np.repeat(np.diff(np.r_[starts, done]) > hot, np.diff(np.r_[starts, done]))
                if over.any():
                    yield from _deferred(head_k[over], head_f[over])
                    head_k, head_f = head_k[~over], head_f[~over]
            if len(head_k):
                close(head_k, head_f, out)
            keys, fps = keys[done:], fps[done:]
        if hot is not None and len(keys) > hot:
            hot_key = keys[0]
            yield from _deferred(keys, fps)
            keys, fps = keys[:0], fps[:0]
        yield from _links(out)
    if len(keys):
        out = []
        close(keys, fps, out)
        yield from _links(out)


def _links(out):
    if out:
        a, b = np.concatenate([x for x, _ in out]).view(np.int64), np.concatenate([x for _, x in out]).view(np.int64)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a), np.int64)), pa.array(a), pa.array(b)], names=["key", "a", "b"])


def _deferred(keys: np.ndarray, fps: np.ndarray):
    """Rows of a hot anchor under four sub-keys each: the bytes of the other half. Sub-keys are never zero."""
    other = np.where(keys >> 31 & 1, 0, 32).astype(np.uint64)
    rest = fps >> other
    for j in range(4):
        byte = (rest >> np.uint64(8 * j)) & np.uint64(255)
        sub = (keys.view(np.uint64) << np.uint64(10)) | np.uint64(j << 8) | byte | np.uint64(1 << 62)
        yield pa.RecordBatch.from_arrays([pa.array(sub.view(np.int64)), pa.array(fps.view(np.int64)), pa.array(fps.view(np.int64))], names=["key", "a", "b"])


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """fps(fp), distinct -> links(a, b) whose closure is that of all pairs within `bits` (at most 3)."""
    if not 0 <= bits <= 3:
        raise ValueError("anchors of radius two cover at most three differing bits")

    def replicate(batches):
        for b in batches:
            f = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(f), 20_000):
                key, at = anchors_of(f[i : i + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(f[i : i + 20_000][at].view(np.int64))], names=["key", "fp"])

    at_anchor = fps.select("fp").mapInArrow(replicate, "key long, fp long").repartition("key").sortWithinPartitions("key")
    first = cut(at_anchor.mapInArrow(lambda it: _runs(it, bits, HOT_ANCHOR), "key long, a long, b long"))
    again = first.where("key != 0").select("key", F.col("a").alias("fp")).repartition("key").sortWithinPartitions("key")
    second = again.mapInArrow(lambda it: _runs(it, bits, None), "key long, a long, b long")
    return first.where("key = 0").select("a", "b").union(second.select("a", "b"))


def _grouped(docs: DataFrame, shingle: int, bits: int) -> DataFrame:
    """(doc_id, fp, th, label, component_id) for every row; label is the least fingerprint of the component."""
    fp = cut(fingerprints(docs, shingle))
    reps = fp.groupBy("fp").agg(F.min("doc_id").alias("least"))
    label = components(links(reps, bits)).withColumnRenamed("node", "fp")
    known = reps.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = known.groupBy("label").agg(F.min("least").alias("component_id"))
    of = known.join(least, "label").select(F.col("fp").alias("f"), "label", "component_id")
    return fp.join(of, F.col("fp") == F.col("f")).drop("f")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs(doc_id, text, ...)."""
    return _grouped(docs, shingle, bits).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
