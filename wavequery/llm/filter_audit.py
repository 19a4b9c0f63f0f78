"""Filter interaction audit: incidence matrix product.

Five filters judge every whole text; the five answers are a mask below 32.
All that any order of the filters does to a document depends on its mask alone,
so the corpus is gathered as histograms, one row of 32 numbers for each part
and kind of document (all, good, toxic).  These rows, stacked, are multiplied by
integer matrices with a row for each mask and a column for each of the 600
(order, step): 1 where a document of that mask is kept after the step, removed
by it, failing it but removed before, or failing it alone.  Summed over the
columns of one filter, the removed are its Shapley numbers.

Filters (a document fails): A under 200 words, B under half of the words
distinct, C more than 3 % capitals A-Z, D any of ``#$%&*|``, E a smaller doc_id
has the same text.  Texts travel as SHA-256 digests; copies are found by the
least doc_id of each digest, and digests and doc_ids that very many rows share
meet their row on the map side.  Distinct words are told apart by 64-bit hashes.

Edge cases: null text is empty (it fails A, and E if it isn't the first); null
lang is the part named by the empty string; a row without a doc_id fails E
never, makes no other row fail and has no labels; rows that repeat a doc_id are
documents each, with its labels, and aren't copies of each other; of repeated
labels the largest counts; very long texts are counted in pieces; an empty table
gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import sys
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_bytes, map_arrow, read_documents, read_labels, release, split_join, stash, text_or_empty, word_rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, JUNK = 200, 50, 3, b"#$%&*|"

#: The last filter compares documents; the others look at one text.
COPY = 1 << FILTERS.index("E")

_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_JUNK = np.zeros(256, bool)
_JUNK[list(JUNK)] = True

#: Parts that one product takes; their 600 rows each are made at a time.
AT_ONCE = 64


def _count(inside: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Marked bytes of each row."""
    return np.diff(np.searchsorted(np.flatnonzero(inside), offs))


def text_masks(column) -> np.ndarray:
    """Which of the filters A to D each text fails, as bits."""
    data, offs = arrow_bytes(column)
    out = np.zeros(len(offs) - 1, np.int32)
    for i, j, hashes, first in word_rows(column, lower=False):
        own, at = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        words = np.diff(first)
        if j == i + 1:
            distinct = np.array([len(np.unique(hashes))])
        else:
            row = np.repeat(np.arange(j - i), words)
            order = np.lexsort((hashes, row))
            h, r = hashes[order], row[order]
            new = np.append(True, (h[1:] != h[:-1]) | (r[1:] != r[:-1]))[: len(h)]
            distinct = np.bincount(r[new], minlength=j - i)
        points = np.diff(at) - _count((own & 0xC0) == 0x80, at)
        fails = (words < LEAST_WORDS, 100 * distinct < DISTINCT_PERCENT * words, 100 * _count(_UPPER[own], at) > CAPITAL_PERCENT * points, _count(_JUNK[own], at) > 0)
        out[i:j] = sum(f.astype(np.int32) << k for k, f in enumerate(fails))
    return out


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good and toxic (0 or 1) of every row."""

    def rows(batch):
        columns = {c: batch.column(c) for c in ("doc_id", "part", "digest")}
        yield pa.RecordBatch.from_pydict(columns | {"mask": pa.array(text_masks(batch.column("text")))})

    part = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), F.sha2(text_or_empty().cast("binary"), 256).alias("digest"), text_or_empty().alias("text"))
    own = stash(map_arrow(texts, rows, "doc_id long, part string, digest string, mask int"), "masks")
    groups = own.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first_id")
    groups = stash(groups, "first_ids", True)
    copy = F.when(F.col("doc_id") > F.col("first_id"), COPY).otherwise(0)
    full = stash(split_join(own, groups, "digest", "left").select("doc_id", "part", F.col("mask").bitwiseOR(copy).alias("mask")), "full_masks", True)
    release(own, groups)

    def one(name):
        return F.max((F.coalesce(F.col(name), F.lit(0)) == 1).cast("int"))

    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    joined = split_join(full, stash(known, "known", True), "doc_id", "left")
    return joined.select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def histograms(rows: DataFrame) -> DataFrame:
    """One row a part: (mask, n, good, toxic) for the masks that it has."""
    cells = rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 cells at most


def orders() -> list[tuple[str, int, int]]:
    """(order, step, filter) of each column of the matrices."""
    return [("".join(FILTERS[f] for f in p), step + 1, p[step]) for p in permutations(range(len(FILTERS))) for step in range(len(FILTERS))]


def matrices() -> dict[str, np.ndarray]:
    """Masks by columns of ``orders``: 1 where a document of the mask is counted."""
    mask = np.arange(1 << len(FILTERS))[:, None]
    own, before = [], []
    for order, step, f in orders():
        own.append(1 << f)
        before.append(sum(1 << FILTERS.index(x) for x in order[: step - 1]))
    own, before = np.array(own)[None, :], np.array(before)[None, :]
    fails, gone = (mask & own) != 0, (mask & before) != 0
    out = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": mask == own}
    out = {k: v.astype(np.int64) for k, v in out.items()}
    out["shapley"] = out["removed"] @ (own.T == own).astype(np.int64)
    return out


OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the seven counts: 600 rows a part."""

    def product(batch):
        by, columns = matrices(), orders()
        names, steps = pa.array([x[0] for x in columns], pa.string()), np.array([x[1] for x in columns], np.int32)
        for at in range(0, batch.num_rows, AT_ONCE):
            some = batch.slice(at, AT_ONCE)
            part, cells = some.column("part"), some.column("cells")
            row = np.repeat(np.arange(some.num_rows), np.diff(np.asarray(cells.offsets)))
            flat = cells.flatten()
            stacked = np.zeros((3, some.num_rows, 1 << len(FILTERS)), np.int64)
            for k, name in enumerate(("n", "good", "toxic")):
                stacked[k, row, np.asarray(flat.field("mask"))] = np.asarray(flat.field(name))
            everything, good, toxic = stacked
            counts = {k: everything @ m for k, m in by.items()} | {"good_lost": good @ by["removed"], "toxic_lost": toxic @ by["removed"]}
            parts = part.take(pa.array(np.repeat(np.arange(some.num_rows), len(columns))))
            every = pa.array(np.tile(np.arange(len(columns)), some.num_rows))
            out = {"part": parts, "filter_order": names.take(every), "step": pa.array(np.tile(steps, some.num_rows))}
            yield pa.RecordBatch.from_pydict(out | {k: pa.array(counts[k].ravel()) for k in OUTCOMES})

    schema = "part string, filter_order string, step int, " + ", ".join(f"{k} long" for k in OUTCOMES)
    return map_arrow(histograms(masks(docs, labels)), product, schema)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read_documents(spark, sf_dir), read_labels(spark, sf_dir))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), f AS (
  SELECT doc_id, part,
         len(words) < 200 AS a,
         100 * len(list_distinct(words)) < 50 * len(words) AS b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c,
         regexp_matches(text, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e
  FROM t
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), h AS (
  SELECT part, a, b, c, d, e, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL
), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM x p, x q, x r, x s, x t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), k AS (
  SELECT filter_order, unnest(range(1, 6)) AS step FROM o
), m AS (
  SELECT part, filter_order, step, n, good, toxic, substr(filter_order, step, 1) AS own,
         list_aggregate([CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END, CASE WHEN d THEN 'D' END, CASE WHEN e THEN 'E' END], 'string_agg', '') AS failed
  FROM h, k
), g AS (
  SELECT *, contains(failed, own) AS fails,
         step > 1 AND regexp_matches(failed, '[' || substr(filter_order, 1, greatest(step - 1, 1)) || ']') AS gone
  FROM (SELECT * REPLACE (coalesce(failed, '') AS failed) FROM m)
), s AS (
  SELECT part, filter_order, step, any_value(own) AS own,
         sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN fails AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN failed = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM g GROUP BY part, filter_order, step
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM s
"""
