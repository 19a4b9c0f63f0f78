"""A corpus pipeline: documents in, encoded training mix out.

Stages, each over all rows that the one before kept, written as Parquet in the
shared folder and read again: reject toxic documents, remove exact copies (the
largest doc_id stays), keep one document of each group of near copies (4 in 5
of their distinct runs of 5 words; the smallest doc_id), mix the sources (a
document appears as often as the mix takes it), encode the texts.  All but the
last return the columns of documents, the last adds ids, n_pieces and exact.

Edge cases, the same in every stage: null text counts as empty.  Empty texts
are scored like any other, are copies of each other (one stays), near to
nothing, mixed once an epoch and encoded as no ids.  Rows are told apart by
doc_id and text together, so rows that repeat a doc_id, or have none, are lost
only where their own text is toxic or a copy; of rows alike in both, the second
stage keeps one.  Of ties, equal texts keep the largest doc_id, near copies the
smallest, and rows without one give way.  Very long texts are read whole, in
pieces of bounded size.  An empty table gives empty tables.  Other columns, also
those named as an operator's own, go through (the last stage replaces its own).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wavequery.llm import exact_dedup, jaccard_join, mixing, pieces, toxicity
from wavequery.llm.common import read_documents, read_labels, release, stash


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, read_labels(spark, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.deduplicate(docs, words=5, near=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs)


STAGES = [
    ("reject_toxic", reject_toxic),
    ("drop_copies", drop_copies),
    ("drop_near_copies", drop_near_copies),
    ("mix_sources", mix_sources),
    ("encode_pieces", encode_pieces),
]

#: Training, components and encoding can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
