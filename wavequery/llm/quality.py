"""Quality: logistic regression over hashed word n-grams, trained by FTRL.

Tokens are runs of letters and digits, or of other visible characters; A-Z is
lower-cased.  Distinct 1- and 2-grams of a text are hashed into ``2 ** BITS``
weights; a text is a sparse vector of equal entries and length 1, its score the
logistic of its dot product with the weights plus a bias.  Weights follow the
regularised leader (per-coordinate rates, L1 and L2) over at most
``TRAIN_ROWS`` labelled rows, those of the smallest hashes, streamed to the
driver one partition at a time, again until ``UPDATES`` texts were learned from
(40 times at most); the model has a fixed size (1 MB).  Every whole
text is scored on the executors.

Edge cases: null text is empty; a text without tokens gets the bias alone;
without labelled rows the score is 0.5; rows of ``labels`` without id or label
are left out, repeated ones count once (the largest label); repeated documents,
and rows without a doc_id, are scored each; texts of over ``STEP`` bytes are read
in pieces, whose last and first token make no 2-gram; an empty table gives an
empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _LOWER, arrow_bytes, map_arrow, mix, read_documents, read_labels, release, row_steps, segments, span_hashes, spans_of, stash, text_or_empty
from .toxicity import _WORDY, fold

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TRAIN_ROWS, UPDATES, THRESHOLD = 10_000, 20_000, 0.3
BITS, ALPHA, BETA, L1, L2 = 18, 1.0, 1.0, 0.005, 0.02


def _cells(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sorted distinct (row, hashed n-gram) keys of some pieces of text."""
    s1, e1, _ = spans_of(_WORDY[data], offs)
    s2, e2, _ = spans_of(~_WORDY[data] & (data > 0x20), offs)
    start, end = np.concatenate([s1, s2]), np.concatenate([e1, e2])
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    hashes = span_hashes(_LOWER[data], start, end)
    row = np.searchsorted(offs, start, "right") - 1
    same = row[1:] == row[:-1]
    pairs = mix(hashes[:-1] * np.uint64(3) + hashes[1:] * np.uint64(0x9E3779B97F4A7C15))[same]
    rows = np.concatenate([row, row[:-1][same]])
    cells = mix(np.concatenate([hashes, pairs])) >> np.uint64(64 - BITS)
    return np.unique(rows.astype(np.int64) << BITS | cells.astype(np.int64))


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of every row: indices and row bounds."""
    cuts, of = segments(data, offs, hard=True)
    keys = [np.zeros(0, np.int64)]
    for i, j in row_steps(cuts):
        own = _cells(data[cuts[i] : cuts[j]], cuts[i : j + 1] - cuts[i])
        keys.append(of[i + (own >> BITS)].astype(np.int64) << BITS | own & ((1 << BITS) - 1))
    keys = np.unique(np.concatenate(keys))
    return (keys & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(keys, np.arange(len(offs), dtype=np.int64) << BITS)


class Ftrl:
    """Follow-the-regularised-leader, one text at a time; the last weight is the bias."""

    def __init__(self) -> None:
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, cells) -> np.ndarray:
        z, n = self.z[cells], self.n[cells]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, cells: np.ndarray, label: float) -> None:
        x = np.full(len(cells) + 1, 1 / np.sqrt(max(1, len(cells))))
        x[-1] = 1.0
        cells = np.append(cells, 1 << BITS)
        w = self.weights(cells)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        s = (np.sqrt(self.n[cells] + g * g) - np.sqrt(self.n[cells])) / ALPHA
        self.z[cells] += g - s * w
        self.n[cells] += g * g


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> np.ndarray:
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = stash(labels.orderBy(F.xxhash64("doc_id", F.lit(6)), "doc_id").limit(most), "chosen", True)
    sample = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")

    def rows(batch):
        data, offs = arrow_bytes(batch.column("text"))
        for i, j in row_steps(offs):
            cells, first = grams(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            packed = [cells[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")[i:j], "label": batch.column("label")[i:j], "cells": pa.array(packed, pa.binary())})

    rows_in = map_arrow(sample, rows, "doc_id long, label int, cells binary")
    n = max(1, min(16, partitions_of(chosen)))
    table = stash(rows_in.repartition(n, F.xxhash64("doc_id", F.lit(7))).sortWithinPartitions(F.xxhash64("doc_id", F.lit(8)), "doc_id"), "grams")
    model = Ftrl()
    for _ in range(min(40, -(-UPDATES // max(1, table.count())))):
        for r in table.toLocalIterator():
            model.learn(np.frombuffer(r["cells"], np.int32), float(r["label"]))
    release(chosen, table)
    return model.weights(slice(None)).astype(np.float32)


def partitions_of(chosen: DataFrame) -> int:
    return chosen.count() // 1000 + 1


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of every row."""

    def rows(batch):
        data, offs = arrow_bytes(batch.column("text"))
        values = []
        for i, j in row_steps(offs):
            cells, first = grams(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            sums = np.concatenate([[0.0], np.cumsum(weights[cells], dtype=np.float64)])
            n = np.diff(first)
            values.append((sums[first[1:]] - sums[first[:-1]]) / np.sqrt(np.maximum(1, n)) + weights[-1])
        s = 1 / (1 + np.exp(-np.concatenate(values)))
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(s), "predicted": pa.array((s >= threshold).astype(np.int32))})

    return map_arrow(docs.select("doc_id", text_or_empty().alias("text")), rows, "doc_id long, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    known = labels.where(fold(5) != 0).select("doc_id", F.col("quality").alias("label"))
    return score(docs, train(docs, known))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality(read_documents(spark, sf_dir), read_labels(spark, sf_dir))
    return scored.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
