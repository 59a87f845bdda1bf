"""Line deduplication by winnowing over line hashes.

A text is its lines between newline characters. Every line has a hash of its content without
outer white space. Of each window of consecutive non-blank lines the least of their hashes is
selected (the last of equal ones), and a selected line is one fingerprint, however many windows
select it: so equal windows have equal fingerprints at equal places, and a repeated window cannot
be missed. Fingerprints that stand only once in the corpus go no further. The positions of the
others are joined by fingerprint; from each the match is extended both ways, window by window of
those that selected it, and a window counts as matched if the hash of all its lines stands earlier
as well. The lines of matched windows, which overlap into maximal runs, are deleted. Earlier means
a smaller (doc_id, hash of the text, position); a run stays where it stands first. The extension
does not follow one chosen partner: a window may be matched with any earlier place, so no run is
cut short because the earliest place of its fingerprint is another one.

A window counts only if it has MIN_WORDS words, so that two chance short lines are no passage; with
a fixed `window`, shorter ones stay. With window=None, as op9 and the pipeline have it, the minimum
holds for a whole run of any number of lines: windows are the shortest runs of MIN_WORDS words from
each line on and up to each line (at most MIN_WORDS lines, one if it is long enough). Every line of
a repeated run with that many words lies in such a window inside the run, and a window that stands
earlier is itself such a run; so exactly the lines of the maximal repeated runs go. Blank lines go
if both neighbours go.

Defined cases: null text is empty and loses nothing; a null doc_id sorts first; rows with equal
doc_id and text are one document, and all keep or lose the same lines; ties within a text go by
position; texts are taken whole, in chunks of a bounded size but one text at least; other columns
are kept as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, sliced, text_bytes, unused, written

WINDOW, MIN_WORDS, REMOVED = 2, 8, "n_lines_removed"
_WHITE = " \t\n\r\x0b\x0c"


def spans(words: list[int], window: int | None, min_words: int) -> list[tuple[int, int]]:
    """(start, stop) of the windows that count, from the words of each non-blank line; window None takes the least runs of min_words words."""
    if window is not None:
        return [(j, j + window) for j in range(len(words) - window + 1) if sum(words[j : j + window]) >= min_words]
    most, n = max(1, min_words), len(words)
    before = np.concatenate([[0], np.cumsum(np.array(words, np.int64))])
    stop = np.searchsorted(before, before[:-1] + most)  # from each line on
    start = np.searchsorted(before, before[1:] - most, "right") - 1  # up to each line
    return sorted({(j, k) for j, k in enumerate(stop.tolist()) if k <= n} | {(j, k + 1) for k, j in enumerate(start.tolist()) if j >= 0})


def selected(h: list[int], windows: list[tuple[int, int]]) -> dict[int, list[tuple[int, int]]]:
    """The fingerprints of a text: by the place of a window's least line hash, the windows (start, stop) that select it."""
    out: dict[int, list[tuple[int, int]]] = {}
    for j, k in windows:
        at = min(range(j, k), key=lambda x: (h[x], -x)) if k - j > 1 else j
        out.setdefault(at, []).append((j, k))
    return out


_PRINTS = "print long, d long, h long, wins array<struct<pos:int,n:int,whole:long>>"
_WIN = pa.struct([("pos", pa.int32()), ("n", pa.int32()), ("whole", pa.int64())])


def _prints(window: int | None, min_words: int):
    """A row for each selected line: its hash, its text's place, and the windows that selected it with the hash of all their lines."""

    def run(batches):
        for b in batches:
            for lo, hi in sliced(b.column(2)):
                prints, owners, ends, start, size, whole = [], [], [0], [], [], []
                for i, text in enumerate(b.column(2).slice(lo, hi - lo).to_pylist(), lo):
                    lines = [x for x in map(bytes.strip, text.split(b"\n")) if x]
                    h = [xxhash.xxh64_intdigest(x) for x in lines]
                    for at, windows in selected(h, spans([len(x.split()) for x in lines], window, min_words)).items():
                        for j, k in windows:
                            start.append(j)
                            size.append(k - j)
                            whole.append(xxhash.xxh3_64_intdigest(b"\n".join(lines[j:k])))
                        prints.append(h[at])
                        owners.append(i)
                        ends.append(len(start))
                at = pa.array(owners, pa.int32())
                wins = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(np.array(whole, np.uint64).view(np.int64))], fields=list(_WIN))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(prints, np.uint64).view(np.int64)), b.column(0).take(at), b.column(1).take(at), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), wins)], names=["print", "d", "h", "wins"])

    return run


def without_runs(text: str, runs: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without the lines of `runs` (first line, number of lines), and how many non-blank lines went."""
    lines = text.split("\n")
    solid = [k for k, x in enumerate(lines) if x.strip(_WHITE)]
    drop = {solid[k] for s, n in runs for k in range(s, s + n)}
    keep, gone_before = [], False
    for k, x in enumerate(lines):
        if k in drop:
            gone_before = True
        elif x.strip(_WHITE):
            gone_before = False
            keep.append(x)
        elif not gone_before:
            keep.append(x)
    return "\n".join(keep), len(drop)


def _rewrite(names: list[str], removed_name: str):
    def run(batches):
        for b in batches:
            cols = [b.column(i) for i in range(b.num_columns)]
            starts, at, removed = cols.pop(), names.index("text"), np.zeros(b.num_rows, np.int64)
            hit = np.flatnonzero(pc.fill_null(pc.list_value_length(starts), 0).to_numpy(zero_copy_only=False)).tolist()
            if hit:
                n_chars, lo, parts, sizes = "n_chars" in names, 0, [], []
                for i in hit:
                    new, removed[i] = without_runs(cols[at][i].as_py(), [(x["pos"], x["n"]) for x in starts[i].as_py()])
                    parts += [cols[at].slice(lo, i - lo), pa.array([new], pa.string())]
                    if n_chars:
                        k = names.index("n_chars")
                        sizes += [cols[k].slice(lo, i - lo), pa.array([len(new)], pa.int64())]
                    lo = i + 1
                cols[at] = pa.concat_arrays([*parts, cols[at].slice(lo)])
                if n_chars:
                    cols[k] = pa.concat_arrays([*sizes, cols[k].slice(lo)])
            yield pa.RecordBatch.from_arrays([*cols, pa.array(removed)], names=[*names, removed_name])

    return run


def prints(docs: DataFrame, window: int | None = WINDOW, min_words: int = MIN_WORDS) -> DataFrame:
    """(print, d, h, wins) of every fingerprint of docs(doc_id, text, ...)."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("h"), text_bytes().alias("t"))
    return keyed.mapInArrow(_prints(window, min_words), _PRINTS)


def removals(docs: DataFrame, window: int | None = WINDOW, min_words: int = MIN_WORDS) -> DataFrame:
    """(d, h, starts): for each document that loses lines, where its repeated windows start among its non-blank lines, and their lengths."""
    found = written(prints(docs, window, min_words), "line-prints")
    # Aggregates are cut off before they are joined, so that the joins' own exchanges stand on both sides and Spark may split a hot key.
    again = cut(found.groupBy("print").count().where("count > 1").select(F.col("print").alias("p")))
    joined = cut(found.join(again, F.col("print") == F.col("p"), "left_semi").select("d", "h", F.explode("wins").alias("w")).select("d", "h", "w.*"))
    place = F.struct(F.coalesce("d", F.lit(-(2**63))).alias("d"), "h", "pos")
    first = cut(joined.groupBy("whole").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").select(F.col("whole").alias("q"), "first"))
    later = joined.join(first, F.col("whole") == F.col("q")).where(place > F.col("first"))
    return later.groupBy("d", "h").agg(F.sort_array(F.collect_set(F.struct("pos", "n"))).alias("starts"))


def line_dedup(docs: DataFrame, window: int | None = WINDOW, min_words: int = MIN_WORDS) -> DataFrame:
    """docs(doc_id, text, ...) with the later repeated runs deleted from text, n_chars brought up to date where present,
    and the number of deleted lines as n_lines_removed (a column of that name is replaced)."""
    docs = docs.drop(REMOVED)
    names = docs.columns
    d, h, starts, own, th = unused(names, "cut_d", "cut_h", "cut_starts", "cut_id", "cut_th")
    gone = removals(docs, window, min_words).withColumnsRenamed({"d": d, "h": h, "starts": starts})
    both = docs.withColumns({own: F.col("doc_id").cast("long"), th: F.xxhash64("text")}).join(gone, F.col(own).eqNullSafe(F.col(d)) & F.col(th).eqNullSafe(F.col(h)), "left")
    kept = [F.col(c).cast("string").alias(c) if c == "text" else F.col(c).cast("long").alias(c) if c == "n_chars" else F.col(c) for c in names]
    rows = both.select(*kept, starts)
    schema = T.StructType([*rows.drop(starts).schema.fields, T.StructField(REMOVED, T.LongType())])
    return rows.mapInArrow(_rewrite(names, REMOVED), schema)


def without_repeats(docs: DataFrame, window: int | None = WINDOW, min_words: int = MIN_WORDS) -> DataFrame:
    """line_dedup() with the columns of docs, whatever their names."""
    (given,) = unused(docs.columns, f"{REMOVED}_given")
    clash = [c for c in docs.columns if c.lower() == REMOVED]
    out = line_dedup(docs.withColumnsRenamed(dict.fromkeys(clash, given)), window, min_words).drop(REMOVED)
    return out.withColumnsRenamed({given: c for c in clash})
