"""Exact substring deduplication by super-k-mers.

A window is `window` consecutive words. Its minimiser is the least hash of the word grams inside
it; consecutive windows that share one minimiser form a super-k-mer. Equal windows have equal
minimisers, so a minimiser that belongs to one super-k-mer only, and stands at one place in it,
cannot hide a repeat: those never travel. The others are cut out of the text as one packed string, go to the
bucket of their minimiser, and there the windows of the distinct strings are sorted and counted
byte for byte; those of an overfull bucket are counted by their 128-bit BLAKE2b digests. Words under a
repeated window are removed.

Steps: (1) minimiser runs of every text; least and greatest place by minimiser, combined before they
are dealt, tell which minimisers have company, and a join that Spark may split keeps their runs;
(2) one copy of each distinct text cuts the strings; (3) strings are collapsed, then counted per
bucket; a minimiser whose strings weigh more than HOT (one each and one for every UNIT bytes of their
windows) has no bucket: its strings are unpacked into digests of windows, which are counted by
themselves, combined before they are dealt; (4) verdicts return to the texts.
Exact copies of whole texts are recognised by SHA-256 and take part once, so a group of copies is
never gathered in one task.

Defined cases: null text has no words; texts shorter than a window lose nothing; of repeated rows
every long enough one is removed in full (each is "anywhere else" for the other); ties need no
order since all occurrences go; a very long text is scanned in pieces with an overlap; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, cut, sliced, text_bytes, written

WINDOW, GRAM = 35, 8
#: A longer text is scanned in pieces of so many words, with an overlap.
PIECE = 1 << 20
#: Weight of the strings of a minimiser that are counted in one task; beyond, their windows are counted one by one. One in HOT_MOST of all weight
#: always may, so there are never more than HOT_MOST hot minimisers, and these (eight bytes each) can be broadcast.
HOT, HOT_MOST = 2048, 1_000_000
#: A string weighs one, and one more for every UNIT bytes that its windows take in Python: their words and WINDOW_BYTES each. So a bucket takes
#: HOT * UNIT bytes (16 MB) at most, however long its strings are.
UNIT, WINDOW_BYTES = 8192, 160
#: Windows in an Arrow batch.
BATCH = 1 << 16
_POS = np.uint64(22)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _window_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive values, by doubling."""
    size, out = 1, x
    while size * 2 <= n:
        out, size = np.minimum(out[:-size], out[size:]), size * 2
    return np.minimum(out[: len(x) - n + 1], out[n - size : n - size + len(x) - n + 1])


def minimiser_runs(texts: list[bytes], window: int = WINDOW, gram: int = GRAM):
    """(index of text, first word, windows, minimiser) of each super-k-mer, as arrays; windows is negative if the minimiser moves inside."""
    owner, base, sizes, hashes = [], [], [], []
    for i, t in enumerate(texts):
        words = t.split()
        for lo in range(0, max(1, len(words) - window + 1), PIECE):
            part = words[lo : lo + PIECE + window - 1]
            if len(part) >= window:
                owner.append(i)
                base.append(lo)
                sizes.append(len(part))
                hashes.append(np.fromiter(map(crc32, part), np.uint64, len(part)))
    out = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]
    if not sizes:
        return out
    parts, lo = [], 0
    while lo < len(sizes):  # so that positions fit their bits
        hi, n = lo, 0
        while hi < len(sizes) and (hi == lo or n + sizes[hi] < 1 << 21):
            n += sizes[hi]
            hi += 1
        h = _mixed(np.concatenate(hashes[lo:hi]) + np.uint64(0x9E3779B97F4A7C15))
        g = h[: len(h) - gram + 1].copy()
        for j in range(1, gram):
            g = g * np.uint64(0x100000001B3) + h[j : len(h) - gram + 1 + j]
        g = _mixed(g)
        key = (g >> _POS << _POS) | np.arange(len(g), dtype=np.uint64)
        least = _window_min(key, window - gram + 1)
        first = np.r_[0, np.cumsum(sizes[lo:hi])[:-1]]
        size = np.array(sizes[lo:hi])
        at = np.arange(len(least))
        piece = np.searchsorted(first, at, side="right") - 1
        fits = at + window <= (first + size)[piece]
        at, piece, least = at[fits], piece[fits], least[fits]
        place = (least & np.uint64((1 << 22) - 1)).astype(np.int64)
        value = g[place]
        new = np.r_[True, (value[1:] != value[:-1]) | (piece[1:] != piece[:-1])]
        start = np.flatnonzero(new)
        count = np.diff(np.r_[start, len(at)])
        if len(start):  # the same gram at several places, as in periodic text: such a run may repeat itself
            moved = np.r_[False, place[1:] != place[:-1]] & ~new
            count = np.where(np.add.reduceat(moved, start), -count, count)
        p = piece[start]
        parts.append((np.array(owner[lo:hi])[p], at[start] - first[p] + np.array(base[lo:hi])[p], count, value[start]))
        lo = hi
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _key(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()[:16]


def _short(key: bytes) -> int:
    return int.from_bytes(key[:8], "big", signed=True)


def _heads(window: int, gram: int):
    def run(batches):
        for b in batches:
            for lo, hi in sliced(b.column(0)):
                part = b.column(0).slice(lo, hi - lo).to_pylist()
                own, start, count, g = minimiser_runs(part, window, gram)
                th = np.array([_short(_key(t)) for t in part], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(th[own]), pa.array(start.astype(np.int64)), pa.array(count.astype(np.int32))], names=["g", "th", "start", "n"])

    return run


def _cut_strings(window: int):
    def run(batches):
        for b in batches:
            texts, runs, cols, size = b.column(1), b.column(2), [], 0
            for i in range(b.num_rows):
                key, t = b.column(0)[i].as_py(), texts[i].as_py()
                v = runs[i].values
                g, start, n = (v.field(k).to_numpy(zero_copy_only=False) for k in ("g", "start", "n"))
                n = np.abs(n)
                words = t.split()
                joined = b" ".join(words)
                at = np.r_[0, np.fromiter(accumulate(len(w) + 1 for w in words), np.int64, len(words))] if words else np.zeros(1, np.int64)
                ok = start + n + window - 1 <= len(words)  # two texts may share the short hash
                g, start, n = g[ok], start[ok], n[ok]
                cost = np.r_[0, np.cumsum(at[window:] - at[:-window] + WINDOW_BYTES)]
                weight = 1 + (cost[start + n] - cost[start]) // UNIT
                lo, hi = at[start].tolist(), (at[start + n + window - 1] - 1).tolist()
                cols.append((key, g, start, weight, [joined[x:y] for x, y in zip(lo, hi, strict=True)]))
                size += sum(hi) - sum(lo)
                if size >= CHUNK_BYTES:
                    yield _strings(cols)
                    cols, size = [], 0
            if cols:
                yield _strings(cols)

    return run


def _strings(cols):
    s = [x for c in cols for x in c[4]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([c[1] for c in cols])),
            pa.array([hashlib.md5(x, usedforsecurity=False).digest() for x in s], pa.binary()),
            pa.array([c[0] for c in cols for _ in c[4]], pa.binary()),
            pa.array(np.concatenate([c[2] for c in cols])),
            pa.array(s, pa.binary()),
            pa.array(np.concatenate([c[3] for c in cols])),
        ],
        names=["g", "sid", "key", "start", "packed", "weight"],
    )


def _windows_of(packed: bytes, window: int):
    """The windows of a string, one at a time: together they are `window` times its size."""
    at = [0, *accumulate(len(x) + 1 for x in packed.split(b" "))]
    for j in range(len(at) - window):
        yield packed[at[j] : at[j + window] - 1]


def _unpacked(window: int):
    """Rows (g, sid, offset, digest, k) of the windows of each string."""

    def rows(b, own, offset, digest):
        at = pa.array(own, pa.int64())
        return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(offset, pa.int32()), pa.array(digest, pa.binary()), b.column(3).take(at)], names=["g", "sid", "offset", "digest", "k"])

    def run(batches):
        for b in batches:
            own, offset, digest = [], [], []
            for i, packed in enumerate(b.column(2)):
                for j, text in enumerate(_windows_of(packed.as_py(), window)):
                    own.append(i)
                    offset.append(j)
                    digest.append(hashlib.blake2b(text, digest_size=16).digest())
                    if len(own) >= BATCH:
                        yield rows(b, own, offset, digest)
                        own, offset, digest = [], [], []
            if own:
                yield rows(b, own, offset, digest)

    return run


def _counted(window: int):
    def verdicts(g, strings):
        found = []
        for i, (_, packed, k) in enumerate(strings):
            found += [(text, i, j, k) for j, text in enumerate(_windows_of(packed, window))]
        found.sort()
        hit: dict[int, list[int]] = {}
        for x, (text, i, j, k) in enumerate(found):
            if k > 1 or x and found[x - 1][0] == text or x + 1 < len(found) and found[x + 1][0] == text:
                hit.setdefault(i, []).append(j)
        for i, js in hit.items():
            yield g, strings[i][0], js

    def run(batches):
        g0, held, out, size = None, [], [], 0
        for b in batches:
            for lo, hi in sliced(b.column(2)):
                for row in zip(*(c.slice(lo, hi - lo).to_pylist() for c in b.columns), strict=True):
                    if row[0] != g0:
                        for v in verdicts(g0, held):
                            out.append(v)
                            size += len(v[2])
                        g0, held = row[0], []
                    held.append(row[1:])
                    if size >= BATCH:
                        yield _verdicts(out)
                        out, size = [], 0
        out += verdicts(g0, held)
        if out:
            yield _verdicts(out)

    return run


def _verdicts(out):
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.list_(pa.int32()))], names=["vg", "vsid", "offsets"])


def kept_words(text: bytes, starts: np.ndarray, window: int) -> list[bytes]:
    words = text.split()
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, np.minimum(starts + window, len(words)), -1)
    gone = np.cumsum(cover)[: len(words)] > 0
    return [w for w, x in zip(words, gone.tolist(), strict=True) if not x]


def _removed(window: int):
    def run(batches):
        for b in batches:
            keys, n, sha = [], [], []
            for i in range(b.num_rows):
                t = b.column(1)[i].as_py()
                spans = b.column(2)[i].values
                starts = np.repeat(spans.field("start").to_numpy(zero_copy_only=False), np.diff(spans.field("offsets").offsets.to_numpy()))
                offsets = spans.field("offsets").flatten().to_numpy(zero_copy_only=False)
                kept = kept_words(t, np.unique(starts + offsets), window)
                keys.append(b.column(0)[i].as_py())
                n.append(len(t.split()) - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(sha)], names=["key", "gone", "sha"])

    return run


def _plain(batches):
    for b in batches:
        key, n, sha = [], [], []
        for t in b.column(1):
            t = t.as_py()
            w = t.split()
            key.append(_key(t))
            n.append(len(w))
            sha.append(hashlib.sha256(b" ".join(w)).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(key, pa.binary()), pa.array(n, pa.int64()), pa.array(sha)], names=["doc_id", "key", "n_words", "sha_all"])


def _verdict_rows(strings: DataFrame, window: int, hot: int) -> DataFrame:
    """(vg, vsid, offsets): the windows of each distinct string that stand anywhere else."""

    def distinct(df: DataFrame) -> DataFrame:
        return df.groupBy("g", "sid").agg(F.first("packed").alias("packed"), F.count(F.lit(1)).alias("k")).select("g", "sid", "packed", "k")

    least = max(hot, (strings.agg(F.sum("weight")).first()[0] or 0) // HOT_MOST)
    many = cut(strings.groupBy("g").agg(F.sum("weight").alias("weight")).where(F.col("weight") > least).select(F.col("g").alias("many")))
    if many.isEmpty():
        few = strings
    else:
        few = strings.join(F.broadcast(many), F.col("g") == F.col("many"), "left_anti")
    counted = distinct(few).repartition("g").sortWithinPartitions("g", "sid").mapInArrow(_counted(window), "vg long, vsid binary, offsets array<int>")
    if many.isEmpty():
        return counted
    rows = written(distinct(strings.join(F.broadcast(many), F.col("g") == F.col("many"), "left_semi")).mapInArrow(_unpacked(window), "g long, sid binary, offset int, digest binary, k long"), "hot-windows")
    again = cut(rows.groupBy("g", "digest").agg(F.sum("k").alias("n")).where("n > 1").select(F.col("g").alias("ag"), F.col("digest").alias("again")))
    met = rows.join(again, (F.col("g") == F.col("ag")) & (F.col("digest") == F.col("again")), "left_semi")
    return counted.union(met.groupBy(F.col("g").alias("vg"), F.col("sid").alias("vsid")).agg(F.collect_list("offset").alias("offsets")))


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of docs(doc_id, text, ...)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("t"))
    keyed = docs.withColumn("key", F.unhex(F.substring(F.sha2("t", 256), 1, 32)))
    short = F.conv(F.substring(F.hex("key"), 1, 16), 16, -10).cast("long")

    heads = written(docs.select("t").mapInArrow(_heads(window, gram), "g long, th long, start long, n int"), "minimisers")
    # Two runs differ in their text or their place; n is negative where a run may repeat itself.
    spread = heads.groupBy("g").agg(F.min("th").alias("t0"), F.max("th").alias("t1"), F.min("start").alias("s0"), F.max("start").alias("s1"), F.min("n").alias("n0"))
    company = cut(spread.where("t0 != t1 or s0 != s1 or n0 < 0").select(F.col("g").alias("c")))  # so that the join has exchanges of its own, which Spark may split
    lists = heads.join(company, F.col("g") == F.col("c"), "left_semi").groupBy("th").agg(F.collect_set(F.struct("g", "start", "n")).alias("runs"))

    texts = cut(keyed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    wanted = lists.join(texts.withColumn("h", short), F.col("th") == F.col("h")).select("rep", F.col("key").alias("k"), "runs")
    strings = written(
        keyed.join(wanted, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("key", "t", "runs").mapInArrow(_cut_strings(window), "g long, sid binary, key binary, start long, packed binary, weight long"),
        "strings",
    )

    counted = _verdict_rows(strings, window, hot)
    spans = strings.select("g", "sid", "key", "start").join(counted, (F.col("g") == F.col("vg")) & (F.col("sid") == F.col("vsid"))).groupBy("key").agg(F.collect_list(F.struct("start", "offsets")).alias("spans"))

    single = texts.where("copies = 1")
    hit = spans.join(single.withColumnRenamed("key", "k"), F.col("key") == F.col("k")).select("k", "rep", "spans")
    partly = keyed.join(hit, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("key", "t", "spans").mapInArrow(_removed(window), "key binary, gone long, sha string")
    copied = texts.where("copies > 1").select("key", F.lit(None).cast("long").alias("gone"), F.sha2(F.lit(b""), 256).alias("sha"))
    changed = partly.union(copied).withColumnRenamed("key", "k")

    plain = docs.mapInArrow(_plain, "doc_id long, key binary, n_words long, sha_all string")
    whole = (F.col("k").isNotNull()) & F.col("gone").isNull() & (F.col("n_words") >= window)
    return plain.join(changed, F.col("key") == F.col("k"), "left").select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole | F.col("gone").isNotNull(), F.col("sha")).otherwise(F.col("sha_all")).alias("kept_sha256"),
    )
