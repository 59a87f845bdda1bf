"""One document of each group of near copies, at a Jaccard similarity of five-word shingles.

SimHash with three differing bits finds few of the pairs that are alike at 0.8 (the README has
figures), so the pipeline's stage takes its candidates from two sides: SimHash links by anchor-point
covering, and equal bands of min-wise shingle hashes. Either way a candidate becomes a link only
after the sets of 64-bit shingle hashes themselves were compared; pairs whose sizes alone rule out
the similarity never travel with their sets.

First each text of a band is compared with the band's least and greatest node only, so the pairs
grow with the texts and not with the square of a group. Components of those links leave few bands
that still hold more than one; in these, members of different components are compared until they
join or all have been, so no link of a band is lost. An open band of more than BLOCK shingles is cut
into blocks of members by a hash, and each pair of blocks is worked on by itself. A pair at similarity s
shares a band with chance 1 - (1 - s^ROWS)^BANDS: 0.9996 at 0.8, over 0.99999 at 0.85.

Texts that are equal up to case of A-Z and white space are one node; texts without words are one
node as well. The first document by (doc_id, hash of the text) of a component stays.

Defined cases: null text is an empty one, like any text without words; a null doc_id sorts first;
repeated rows are one node and one row of them stays; of equal texts the least doc_id stays; texts
of fewer words than a shingle are one shingle; very long texts are hashed in pieces; columns of any
name pass through; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, sliced, text_bytes, unused, written
from .components import components
from .shingles import PIECE, MinHash, shingle_hashes, simhashes, word_hashes
from .simhash import BITS, links

SHINGLE, SIMILARITY, BANDS, ROWS, BLOCK = 5, 0.8, 20, 5, 1 << 20
#: Sizes are whole numbers, so a fraction this small only takes back what floating point adds.
SLACK = 1e-6


def shingle_set(text: bytes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(*word_hashes([text]), SHINGLE)[0])


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _each(hashes: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    return np.split(hashes, np.cumsum(counts)[:-1])


def _described(batches):
    bands = MinHash(BANDS, ROWS)
    for b in batches:
        for lo, hi in sliced(b.column(1), PIECE):
            words, n_words = word_hashes(b.column(1).slice(lo, hi - lo).to_pylist())
            h, n = shingle_hashes(words, n_words, SHINGLE)
            node = np.fromiter((xxhash.xxh64_intdigest(w.tobytes()) for w in _each(words, n_words)), np.uint64, hi - lo).view(np.int64)
            size = np.array([len(np.unique(x)) for x in _each(h, n)], np.int64)
            keys = bands.keys(h, n)
            listed = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(n > 0, BANDS, 0))].astype(np.int32)), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array(node), pa.array(size), pa.array(simhashes(h, n).view(np.int64)), listed],
                names=["doc_id", "th", "node", "n", "fp", "bands"],
            )


def _sets(batches):
    for b in batches:
        for lo, hi in sliced(b.column(1), PIECE):
            h, n = shingle_hashes(*word_hashes(b.column(1).slice(lo, hi - lo).to_pylist()), SHINGLE)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([np.unique(x).tobytes() for x in _each(h, n)], pa.binary())], names=["n", "s"])


def _views(column: pa.Array) -> list[np.ndarray]:
    """Sets of a binary column as arrays over Arrow's own memory."""
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def _verified(batches):
    for b in batches:
        for lo, hi in sliced(b.column(2)):
            x, y = (_views(b.column(i).slice(lo, hi - lo)) for i in (2, 3))
            mask = pa.array([alike(p, q) >= SIMILARITY for p, q in zip(x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(i).slice(lo, hi - lo).filter(mask) for i in (0, 1)], names=["a", "b"])


def across(label: np.ndarray, node: np.ndarray, block: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join the components of a band, or of a pair of its blocks; of members of one block only if there is one block.

    A member is compared with all others by one pass over their shingles, and not with those that its own component has taken in."""
    size = np.array([len(s) for s in sets], np.int64)
    values, flat = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)
    flat, ends = flat.astype(np.int32), np.cumsum(size)
    starts, two = ends - size, len(np.unique(block)) > 1
    _, of = np.unique(label, return_inverse=True)
    group, out, mark, members = of.copy(), [], np.zeros(len(values), bool), np.bincount(of)
    for i in np.lexsort((node, of, members[of])).tolist():
        if of[i] == np.argmax(members) or (group == group[0]).all():  # of two components one is not the largest, and has asked
            continue
        near = (group != group[i]) & (np.minimum(size, size[i]) >= SIMILARITY * np.maximum(size, size[i]) - SLACK)
        if two:
            near &= block != block[i]
        if not near.any():
            continue
        mine = flat[starts[i] : ends[i]]
        mark[mine] = True
        both = np.zeros(len(flat) + 1, np.int32)
        np.cumsum(mark[flat], out=both[1:])
        mark[mine] = False
        shared = both[ends] - both[starts]
        for j in np.flatnonzero(near & (shared >= SIMILARITY * (size + size[i] - shared) - SLACK)).tolist():
            if group[j] != group[i]:
                out.append((int(node[i]), int(node[j])))
                group[group == group[j]] = group[i]
    return out


def _joined(batches):
    """Rows (key, cell, label, node, block, s) sorted by (key, cell)."""
    held: list[tuple] = []
    key = None

    def close():
        label, node, block, sets = (list(x) for x in zip(*held, strict=True))
        return across(np.array(label, np.int64), np.array(node, np.int64), np.array(block, np.int64), [np.frombuffer(s, np.uint64) for s in sets])

    def batch(found):
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    for b in batches:
        for lo, hi in sliced(b.column(5)):
            for *k, label, node, block, s in zip(*(b.column(i).slice(lo, hi - lo).to_pylist() for i in range(6)), strict=True):
                if k != key:
                    if found := held and close():
                        yield batch(found)
                    key, held = k, []
                held.append((label, node, block, s))
    if found := held and close():
        yield batch(found)


def _open_cells(mates: DataFrame, block: int) -> DataFrame:
    """(key, cell, label, node, block) of the bands whose members have several labels; a band of over `block` shingles in all pairs of its blocks."""
    spread = mates.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.sum("n").alias("size")).where("lo != hi")
    spread = spread.select(F.col("key").alias("k"), F.greatest(F.ceil(F.col("size") / block), F.lit(1)).cast("int").alias("blocks"))
    own = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("node"), F.col("blocks"))).otherwise(F.lit(0)).cast("int")
    rows = mates.join(spread, F.col("key") == F.col("k")).select("key", "label", "node", "blocks", own.alias("block"))
    # A pair of different blocks meets in the cell of both. With one block there is one cell; else a block's own pairs have a cell as well.
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda c: F.least("block", c) * F.col("blocks") + F.greatest("block", c))
    return rows.select("key", F.explode(cells).alias("cell"), "label", "node", "block")


def groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, th, label) of every row of docs(doc_id, text, ...); equal labels are near copies. th is a hash of the text."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("t"), F.xxhash64("text").alias("th"))
    rows = written(base.mapInArrow(_described, "doc_id long, th long, node long, n long, fp long, bands array<long>"), "described")
    # One text per node, so that copies are never dealt again.
    place = F.struct("doc_id", "th")
    nodes = cut(rows.groupBy("node").agg(F.min_by("fp", place).alias("fp"), F.min_by("bands", place).alias("bands"), F.min("n").alias("n"), F.min(place).alias("at")))
    keyed = nodes.select("node", "n", F.explode("bands").alias("key"))
    ends = cut(keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low != high").withColumnRenamed("key", "k"))  # cut, so that the join may be split
    shared = cut(keyed.join(ends, F.col("key") == F.col("k")).select("key", "node", "n", "low", "high"))
    met = shared.select("node", F.explode(F.array("low", "high")).alias("other"))
    # SimHash: nodes of one fingerprint, and of linked ones, through the least node of each.
    prints = nodes.groupBy("fp").agg(F.min("node").alias("first"))
    same = nodes.select("node", "fp").join(prints, "fp").select("node", F.col("first").alias("other"))
    linked = links(prints.select("fp"), BITS)
    near = linked.join(prints.select(F.col("fp").alias("a"), F.col("first").alias("node")), "a").join(prints.select(F.col("fp").alias("b"), F.col("first").alias("other")), "b").select("node", "other")
    pairs = met.union(same).union(near).where("node != other").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    sizes = nodes.select("node", "n")
    pairs = pairs.join(sizes.withColumnsRenamed({"node": "a", "n": "na"}), "a").join(sizes.withColumnsRenamed({"node": "b", "n": "nb"}), "b")
    pairs = cut(pairs.where(F.least("na", "nb") >= SIMILARITY * F.greatest("na", "nb") - SLACK).select("a", "b"))

    wanted = pairs.select("a").union(pairs.select("b")).union(shared.select("node")).distinct().join(nodes.select("node", "at"), F.col("a") == F.col("node")).select("node", F.col("at.doc_id").alias("d"), F.col("at.th").alias("h"))
    texts = base.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h"))).select("node", "t")
    sets = written(texts.mapInArrow(_sets, "n long, s binary").dropDuplicates(["n"]), "shingle-sets")
    both = pairs.join(sets.withColumnRenamed("n", "a"), "a").withColumnRenamed("s", "x").join(sets.withColumnRenamed("n", "b"), "b").select("a", "b", "x", "s")
    found = cut(both.mapInArrow(_verified, "a long, b long"))

    label = cut(components(found))
    mates = cut(shared.select("key", "node", "n").join(label, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("label")))
    rest = _open_cells(mates, block).join(sets.withColumnRenamed("n", "node"), "node").select("key", "cell", "label", "node", "block", "s")
    more = rest.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(_joined, "a long, b long")
    label = components(found.union(more))
    return rows.select("doc_id", "th", "node").join(label, "node", "left").select("doc_id", "th", F.coalesce("label", "node").alias("label"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without all but the first document of each group; columns as they were."""
    found = cut(groups(docs))
    d, h, th = unused(docs.columns, "one_d", "one_h", "one_th")
    first = found.groupBy("label").agg(F.min(F.struct("doc_id", "th")).alias("f")).select(F.col("f.doc_id").alias(d), F.col("f.th").alias(h))
    kept = docs.withColumn(th, F.xxhash64("text")).join(first, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(th) == F.col(h)), "left_semi")
    if not found.groupBy("doc_id", "th").count().where("count > 1").isEmpty():  # repeated rows
        kept = kept.dropDuplicates(["doc_id", th])
    return kept.select(*docs.columns)
