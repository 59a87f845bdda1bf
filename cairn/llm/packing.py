"""Best-fit packing of documents into fixed-capacity bins, under conflicts.

Two pieces conflict if they come from the same source or the same duplicate cluster; a bin holds
no conflicting pieces. A document over the capacity is cut into full pieces and a rest, so no text
is dropped. Pieces go largest first (ties by doc_id, text hash and piece). Open bins are ordered by
residual; each carries a bitmap of its sources and of its clusters. A piece goes to the tightest
compatible bin: the search starts at the first residual that holds it and moves to the successor
until a compatible bin is found; only then is a new bin opened. Full bins are closed.

Pieces are dealt into shards of about SHARD pieces by a hash, so a hot source or cluster spreads
over all shards and a shard stays bounded; a bin never spans shards, and a bin id is
shard * 2^32 + number. Bitmaps number the sources and clusters of their shard, so they are exact.
A cluster is a group of near copies where labels are given (op7 has those of similar.groups), else
the rows of one text.

Defined cases: null text has no words and takes no bin (bin_id null, n_words 0); a null source is
one source of its own per document, so it conflicts with nothing but the document's other pieces; a
null doc_id is packed like any other; repeated rows are one cluster, hence in different bins; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

CAPACITY, SHARD = 2048, 4096
_SPACE = r"[\x20\x09-\x0D]+"


class Bins:
    """Open bins by residual. Bins of equal residual are grouped by their bitmaps, for the conflicts are decided by those alone."""

    def __init__(self, capacity: int):
        self.capacity, self.made = capacity, 0
        self.residuals: list[int] = []  # sorted, those in use
        self.by_source: dict[int, dict[int, list[tuple[int, int]]]] = {}  # residual -> sources -> [(clusters, bin)]

    def place(self, size: int, source: int, clusters: int) -> tuple[int, int]:
        """(bin, offset) of a piece; source and clusters are bitmaps with the piece's own bits."""
        for k in range(bisect_left(self.residuals, size), len(self.residuals)):
            r = self.residuals[k]
            groups = self.by_source[r]
            for sources, bins in groups.items():
                if sources & source:
                    continue
                for i in range(len(bins) - 1, -1, -1):
                    if not bins[i][0] & clusters:
                        held, number = bins.pop(i)
                        if not bins:
                            del groups[sources]
                            if not groups:
                                del self.by_source[r]
                                self.residuals.pop(k)
                        self._keep(r - size, sources | source, held | clusters, number)
                        return number, self.capacity - r
        self.made += 1
        self._keep(self.capacity - size, source, clusters, self.made - 1)
        return self.made - 1, 0

    def _keep(self, residual: int, sources: int, clusters: int, number: int) -> None:
        if residual:
            if residual not in self.by_source:
                insort(self.residuals, residual)
                self.by_source[residual] = {}
            self.by_source[residual].setdefault(sources, []).append((clusters, number))


def pack_shard(pieces: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """pieces(shard, doc_id, h, piece, size, source, cluster) of one shard, with bin_id and offset."""
    p = pieces.sort_values(["size", "doc_id", "h", "piece"], ascending=[False, True, True, True], na_position="first", kind="stable").reset_index(drop=True)
    bit = {s: 1 << i for i, s in enumerate(sorted(p["source"].unique()))}
    n = p["cluster"].value_counts()
    shared = {c: 1 << i for i, c in enumerate(sorted(n.index[n > 1]))}  # a cluster with one piece here cannot conflict
    bins, at = Bins(capacity), []
    for size, source, cluster in zip(p["size"].tolist(), p["source"].tolist(), p["cluster"].tolist(), strict=True):
        at.append(bins.place(size, bit[source], shared.get(cluster, 0)))
    shard = int(p["shard"].iloc[0]) << 32
    p["bin_id"] = [shard + b for b, _ in at]
    p["offset"] = [o for _, o in at]
    return p[["doc_id", "piece", "size", "bin_id", "offset", "source", "cluster"]]


def word_count(text: str = "text") -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; null has none."""
    parts = F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), _SPACE, -1)
    return F.size(parts) - (parts[0] == "").cast("int") - ((F.element_at(parts, -1) == "") & (F.size(parts) > 1)).cast("int")


def pack(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, source: str = "source", cluster: Column | None = None, labels: DataFrame | None = None) -> DataFrame:
    """(doc_id, piece, n_words, bin_id, bin_offset) of every piece of docs(doc_id, text, source, ...); n_words is the piece's size.

    `cluster` names the duplicate cluster of a row; by default the hash of its text. labels(doc_id, th, label), as similar.groups()
    gives them, name it by doc_id and hash of the text instead."""
    h = F.xxhash64("text")
    own = F.concat(F.lit("d"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), h.cast("string"))
    src = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), own) if source in docs.columns else own
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), h.alias("h"), word_count().alias("n"), src.alias("source"), (cluster if cluster is not None else h).cast("string").alias("cluster"))
    if labels is not None:  # joined without the texts
        named = labels.select(F.col("doc_id").alias("d"), F.col("th").alias("of_h"), F.col("label").cast("string").alias("label")).dropDuplicates(["d", "of_h"])
        joined = sized.join(named, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("of_h")), "left")
        sized = joined.withColumn("cluster", F.coalesce("label", "cluster")).drop("d", "of_h", "label")
    pieces = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / capacity).cast("int") - 1, F.lit(0)))))
    pieces = cut(pieces.select("doc_id", "h", "piece", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).alias("size"), "source", "cluster"))
    shards = max(1, -(-pieces.count() // shard))
    some = pieces.where("size > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id", "h", "piece"), F.lit(shards)).cast("int"))
    packed = some.groupBy("shard").applyInPandas(lambda p: pack_shard(p, capacity), "doc_id long, piece int, size int, bin_id long, offset int, source string, cluster string")
    return packed.select("doc_id", "piece", F.col("size").cast("long").alias("n_words"), "bin_id", F.col("offset").cast("long").alias("bin_offset")).union(pieces.where("size = 0").select("doc_id", "piece", F.lit(0).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("long")))
