"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A window is `window` consecutive words of a benchmark item (a shorter item is one window). A
document can hold a window only if it holds every token of it, so one necessary prefix token is
enough to find candidates: the tokens of a window are ordered by rarity, counted over all
documents, and the rarest is its prefix. Document words are joined to prefix tokens inside the
scan; the token's place in the window fixes where the window must start (positional bound), the
window must fit in the document (length bound), and the words of that item-sized window are then
compared one by one.

The benchmark side is broadcast only while its windows take at most BROADCAST_BYTES, counted before;
beyond that the words are counted with map-side combining, those so frequent that few can be (over
one in HOT_SHARE of all words, hence under HOT_SHARE of them) and no prefix are left out by a
broadcast of bounded size, the others are dealt by token, and candidates return to their texts by a
join on the document. Both ways give the same rows.

Defined cases: a null text or item has no words, so no windows and no hits; n_items counts item
ids, a null item_id is not counted; repeated rows get equal results each; of equally rare tokens
the least hash is the prefix, and the first place of it; texts of any length are taken whole (a
text's words stand in one array); other columns are ignored; an empty documents table gives no
rows, an empty benchmark no hits.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, unused

WINDOW, BROADCAST_BYTES, HOT_SHARE = 13, 48 << 20, 10_000
#: What stands between words, in a text whose A-Z are not yet lower case. Listed one by one: Java tests a listed character by one lookup.
BETWEEN = "[" + "".join(f"\\x{c:02X}" for c in range(0x80) if not chr(c).isalnum()) + "]+"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def with_words(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds `words`, as written. An empty string stands before a leading and after a last separator; it equals no word."""
    return df.withColumn("words", F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), BETWEEN, -1))


def word_count() -> Column:
    head, tail = (F.col("words")[0] == "").cast("int"), (F.element_at("words", -1) == "").cast("int")
    return F.greatest(F.size("words") - head - tail, F.lit(0))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: (wid, window words lower-cased, size, ids of the items that have it)."""
    b = benchmark.select(F.col("item_id"), lower_ascii(F.col("text").cast("string")).alias("text"))
    b = with_words(b).select("item_id", F.filter("words", lambda w: w != "").alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    w = b.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("words"), i, F.lit(window)))).alias("w"))
    return w.groupBy(F.array_join("w", " ").alias("wid")).agg(F.first("w").alias("w"), F.collect_set("item_id").alias("items")).withColumn("size", F.size("w"))


def _tokens(docs: DataFrame, *kept: str) -> DataFrame:
    # The outer form, since the optimiser repeats the whole split in a filter before the inner one.
    return docs.select(*kept, F.posexplode_outer("words").alias("pos", "word")).withColumn("key", F.xxhash64(F.lower("word")))


def hits(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, th, start, size, items) of every occurrence; th is a hash of the text, so that rows that share a doc_id stay apart."""
    windows = cut(item_windows(benchmark, window))
    # What a row takes in a hashed relation: its strings twice, its ids, and the overhead of its parts.
    size = F.octet_length("wid") * 3 + F.size("w") * 24 + F.size("items") * 8 + 128
    small = (windows.agg(F.sum(size)).first()[0] or 0) <= broadcast_bytes

    docs = with_words(documents.select("doc_id", F.xxhash64("text").alias("th"), "text"))
    vocabulary = windows.select(F.explode("w").alias("v")).select(F.xxhash64(F.lower("v")).alias("v")).distinct()
    if small:
        common = _tokens(docs).join(F.broadcast(vocabulary), F.col("key") == F.col("v"), "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    else:
        counted = cut(_tokens(docs).groupBy("key").agg(F.count(F.lit(1)).alias("n")))
        common = counted.join(vocabulary, F.col("key") == F.col("v"), "left_semi")

    places = windows.select("wid", F.posexplode("w").alias("off", "t")).withColumn("t", F.xxhash64(F.lower("t")))
    ranked = places.join(common, F.col("t") == F.col("key"), "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "t", "off")).alias("least"))
    # A token that no document has rules its windows out.
    prefixes = ranked.where("least.n > 0").select(F.col("wid").alias("id"), F.col("least.t").alias("prefix"), F.col("least.off").alias("off")).join(windows, F.col("id") == F.col("wid")).select("wid", "prefix", "off", "size", "items")
    prefixes = cut(prefixes)

    start = F.col("pos") - F.col("off")
    fits = (start >= 0) & (start + F.col("size") <= F.size("words"))
    equal = lower_ascii(F.array_join(F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("size")), " ")) == F.col("wid")
    if small:
        found = _tokens(docs, "doc_id", "th", "words").join(F.broadcast(prefixes), (F.col("key") == F.col("prefix")) & fits & equal)
        return found.select("doc_id", "th", start.alias("start"), "size", "items")
    total = counted.agg(F.sum("n")).first()[0] or 0
    hot = counted.where(F.col("n") * HOT_SHARE > total).join(prefixes.select("prefix"), F.col("key") == F.col("prefix"), "left_anti").select(F.col("key").alias("hot"))
    cool = _tokens(docs, "doc_id", "th").join(F.broadcast(hot), F.col("key") == F.col("hot"), "left_anti")
    near = cool.join(prefixes, F.col("key") == F.col("prefix")).where(start >= 0).select(F.col("doc_id").alias("d"), F.col("th").alias("h"), "pos", "off", "wid", "size", "items")
    return docs.join(near, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("th").eqNullSafe(F.col("h"))).where(fits & equal).select("doc_id", "th", start.alias("start"), "size", "items")


def _per_document(documents: DataFrame, benchmark: DataFrame, window: int, broadcast_bytes: int) -> DataFrame:
    """(d, h, hit, items, sha) of the documents with hits."""
    found = hits(documents, benchmark, window, broadcast_bytes)
    per_doc = found.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("start", "size"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))

    def cover(acc: Column, x: Column) -> Column:
        end = x["start"] + x["size"]
        return F.struct((acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["until"], x["start"]))).alias("n"), F.greatest(acc["until"], end).alias("until"))

    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return per_doc.select(
        F.col("doc_id").alias("d"),
        F.col("th").alias("h"),
        F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("until")), cover)["n"].cast("long").alias("hit"),
        F.size("items").cast("long").alias("items"),
        F.sha2(F.array_join(ids, ","), 256).alias("sha"),
    )


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """documents without those that hold a window of the benchmark, however small a part of the text it is; columns as they were."""
    d, h, th = unused(documents.columns, "bad_d", "bad_h", "bad_th")
    bad = hits(documents.select("doc_id", "text"), benchmark, window, broadcast_bytes).select(F.col("doc_id").alias(d), F.col("th").alias(h)).distinct()
    keyed = documents.withColumn(th, F.xxhash64("text"))
    return keyed.join(bad, F.col("doc_id").eqNullSafe(F.col(d)) & F.col(th).eqNullSafe(F.col(h)), "left_anti").drop(th)


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of documents(doc_id, text, ...)."""
    per_doc = _per_document(documents, benchmark, window, broadcast_bytes)
    all_docs = with_words(documents.select("doc_id", "text")).select("doc_id", F.xxhash64("text").alias("th"), word_count().cast("long").alias("n_words"))
    n_hit = F.coalesce("hit", F.lit(0)).cast("long")
    return all_docs.join(per_doc, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("th").eqNullSafe(F.col("h")), "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )


SQL = r"""
WITH b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 12), ' ') AS win, least(len(w), 13) AS size
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), p AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d
), h AS (
  SELECT p.doc_id, p.i, iw.size, iw.item_id
  FROM p, (SELECT DISTINCT size FROM iw) s, iw
  WHERE iw.size = s.size AND p.i + s.size - 1 <= len(p.w) AND array_to_string(list_slice(p.w, p.i, p.i + s.size - 1), ' ') = iw.win
), c AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM h) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS sha FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
       coalesce(t.sha, sha256('')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
