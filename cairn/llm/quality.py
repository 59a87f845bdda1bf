"""Document quality by Bradley-Terry ranking.

A document's score is a weighted sum of features of its text. The weights are learned from
preference pairs (a document labelled 1 is preferred to one labelled 0) by logistic loss on the
difference of their features. A score quantile of the training sample is the threshold; the
reported score is the logistic of the distance to it, shifted so that the threshold reads
THRESHOLD.

Training takes at most SAMPLE labelled rows (the least by a hash of the id, so a fixed choice) and
PAIRS pairs; rows whose crc32(doc_id as text) mod 4 is HELD_OUT are never learned from. Only texts
are scored: labels, lang, source and doc_id are no inputs.

Defined cases: null text is empty, and empty texts have a score; repeated rows get equal scores; a
document with several labels counts by their mean (0.5 or more is 1), null labels are ignored;
without labels of both kinds all weights are zero, so every score is THRESHOLD; texts are taken
whole, each by itself, so a very long one costs its own size; texts of equal features tie and get
equal scores, and of equally good quantiles the least is the threshold; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, text_bytes, unused

SAMPLE, PAIRS, THRESHOLD, HELD_OUT = 12_000, 60_000, 0.7, 2
RIDGE, ROUNDS = 1e-3, 60

_GROUPS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!", b"?", b"|", b"#$%&*+=@^~", b"\"'`", b"()[]{}<>", b"-_/\\", b":;"]
_GROUP_OF = np.full(256, len(_GROUPS), np.int64)
for _i, _g in enumerate(_GROUPS):
    _GROUP_OF[np.frombuffer(_g, np.uint8)] = _i
_GROUP_OF[128:] = len(_GROUPS) + 1
_VOWELS = re.compile(rb"[AEIOUYaeiouy\x80-\xff]")


def _one(text: bytes) -> list[float]:
    n = max(1, len(text))
    count = np.bincount(_GROUP_OF, weights=np.bincount(np.frombuffer(text, np.uint8), minlength=256), minlength=len(_GROUPS) + 2) / n
    words = text.split()
    w = max(1, len(words))
    seen = Counter(words)
    top = seen.most_common(5)
    lines = [x for x in text.split(b"\n") if x]
    m = max(1, len(lines))
    length = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    pairs = len(set(zip(words, words[1:], strict=False))) / max(1, len(words) - 1)
    solo = sum(1 for v in seen.values() if v == 1)
    upper = sum(map(bytes.isupper, seen)) / max(1, len(seen))
    alpha = sum(map(bytes.isalpha, seen)) / max(1, len(seen))
    novowel = sum(1 for x in seen if not _VOWELS.search(x)) / max(1, len(seen))
    return [
        *count,
        *np.sqrt(count),
        np.log1p(len(words)),
        len(seen) / w,
        solo / w,
        (top[0][1] if top else 0) / w,
        sum(v for _, v in top) / w,
        pairs,
        length.mean(),
        length.std(),
        np.log1p(length.max()),
        (length > 15).mean(),
        (length < 3).mean(),
        upper,
        alpha,
        novowel,
        np.log1p(len(lines)),
        len(set(lines)) / m,
        np.log1p(len(words) / m),
        sum(x[-1:] in (b".", b"!", b"?") for x in lines) / m,
    ]


def features(texts: list[bytes]) -> np.ndarray:
    return np.array([_one(t) for t in texts], np.float64).reshape(len(texts), -1)


class Ranker:
    """Standardised features and their squares, Bradley-Terry weights, the threshold and its scale."""

    def __init__(self, mean, scale, weights, threshold, spread):
        self.mean, self.scale, self.weights, self.threshold, self.spread = mean, scale, weights, threshold, spread

    def _x(self, f: np.ndarray) -> np.ndarray:
        z = np.clip((f - self.mean) / self.scale, -6, 6)
        return np.concatenate([z, z * z / 3], axis=1)

    def score(self, f: np.ndarray) -> np.ndarray:
        # Summed row by row: a matrix product may round a text's score by the number of texts beside it.
        d = ((self._x(f) * self.weights).sum(axis=1) - self.threshold) / self.spread
        return 1 / (1 + np.exp(-np.clip(d + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))


def fit(f: np.ndarray, label: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> Ranker:
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    mean, scale = (f.mean(axis=0), f.std(axis=0)) if len(f) else (0.0, 1.0)
    model = Ranker(mean, np.where(scale > 1e-9, scale, 1.0) if len(f) else 1.0, np.zeros(2 * f.shape[1]), 0.0, 1.0)
    if not len(good) or not len(bad):
        return model
    rng = np.random.default_rng(seed)
    x = model._x(f)
    d = x[rng.choice(good, pairs)] - x[rng.choice(bad, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(ROUNDS):  # Newton steps on the mean logistic loss of the differences
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # chance that the pair is ranked wrongly
        gradient = -(d * p[:, None]).mean(axis=0) + RIDGE * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / len(d) + RIDGE * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w = w - step * min(1.0, 2 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    model.weights = w
    s = x @ w
    # The quantile that serves both kinds best, of those between each two neighbouring scores.
    order = np.argsort(s, kind="stable")
    below = np.cumsum(label[order] == 0) / len(bad) - np.cumsum(label[order] == 1) / len(good)
    quantile = (int(np.argmax(below)) + 1) / len(s)
    model.threshold = float(np.quantile(s, quantile))
    model.spread = float(max(1e-6, s.std() / 3))
    return model


def _held_out(id_column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 4 == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ranker:
    """Learns from docs(doc_id, text, ...) and labels(doc_id, quality, ...)."""
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    known = known.where(~_held_out("id")).orderBy(F.xxhash64("id"), "id").limit(sample)  # bounded, so it may be broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("t")).join(F.broadcast(known), F.col("doc_id") == F.col("id"))

    def run(batches):
        for b in batches:
            f = features([t.as_py() for t in b.column(1)]) if b.num_rows else ()
            if len(f):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(f.tolist(), pa.list_(pa.float64()))], names=["doc_id", "label", "f"])

    got = rows.select("doc_id", "t", "label").mapInArrow(run, "doc_id long, label int, f array<double>").toArrow().sort_by("doc_id")
    if not got.num_rows:
        return fit(np.zeros((0, len(_one(b"")))), np.zeros(0))
    return fit(np.array(got["f"].to_pylist()), got["label"].to_numpy())


def scored(docs: DataFrame, model: Ranker) -> DataFrame:
    """docs(doc_id, text, ...) with all its columns, quality_score and quality_kept (columns of those names are replaced)."""
    docs = docs.drop("quality_score", "quality_kept")
    names = docs.columns

    def run(batches):
        for b in batches:
            texts = b.column(b.num_columns - 1)
            for lo, hi in sliced(texts):
                s = model.score(features(texts.slice(lo, hi - lo).to_pylist()))
                cols = [b.column(i).slice(lo, hi - lo) for i in range(b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(s), pa.array(s >= THRESHOLD)], names=[*names, "quality_score", "quality_kept"])

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType()), T.StructField("quality_kept", T.BooleanType())])
    return docs.select(*(F.col(c) for c in names), text_bytes().alias(unused(names, "t")[0])).mapInArrow(run, schema)


def keep(docs: DataFrame, model: Ranker) -> DataFrame:
    """docs without those below the threshold; columns as they were, whatever their names."""
    named = {c: unused(docs.columns, f"{c}_given")[0] for c in docs.columns if c.lower() in ("quality_score", "quality_kept")}
    kept = scored(docs.withColumnsRenamed(named), model).where("quality_kept").drop("quality_score", "quality_kept")
    return kept.withColumnsRenamed({v: k for k, v in named.items()})


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    model = train(docs, labels, sample)
    rows = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return rows.select("doc_id", _held_out().alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_kept").cast("int").alias("predicted"))
