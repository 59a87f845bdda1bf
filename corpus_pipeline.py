"""Corpus pipeline over documents: stages, each written as Parquet and read again as the next one's input.

quality classifier -> line dedup -> SimHash near-dedup -> benchmark decontamination -> best-fit packing.
A stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the
columns of docs. Near-duplicates are linked on five-word shingles.

Defined cases, for all stages: a null text counts as empty; a null doc_id is a document like any other and
sorts first; a very long text is taken whole; columns of any other name pass through, whatever they are
called; an empty table gives an empty one of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import common, decontaminate, lines, packing, quality, similar


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the ranking, learned from the labels, puts below the threshold.

    Empty texts have a score like others; repeated rows and texts that tie have equal scores, so all of them stay or go;
    without labels of both kinds every score is the threshold, and all stay."""
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    return quality.keep(docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeated runs of lines; every document stays, one that loses all lines as an empty text.

    Of equal runs the first by (doc_id, hash of the text, position) stays. Repeated rows are one document: they keep or lose the
    same lines, and an exact copy under another doc_id loses all. n_chars is brought up to date."""
    return lines.without_repeats(docs, window=None)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: SimHash and min-wise candidates, compared at 0.8 of five-word shingles.

    It is the first by (doc_id, hash of the text); of repeated rows one stays; all texts without words are one group."""
    return similar.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every document that holds a window of the benchmark, however small a part of the text it is.

    Texts without words hold none. An item shorter than a window is one window; an item without words is none."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of the documents that are left, piece by piece; a document without words takes no bin and has one row that says so."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]
#: The ranking and the packing cannot be told in SQL; the tests hold each stage's rows against plain Python on what it was given.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
