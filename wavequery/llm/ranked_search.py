"""Ranked lexical search: TPUT (three-phase uniform threshold) over postings.

The texts are read once, into a forward index: a row for each document with the
terms it shares with the queries and how often it has them.  From it come the
corpus numbers and the postings (term, contribution, document), partitioned by
ranges of (term, contribution, document) and sorted so that a list's head is its
first rows; a list that most documents are in is many partitions.  Contributions
are what a document gains from a term, before the query's own weight of it.

1. The heads of all lists, ``HEAD`` postings each, add up to partial scores; the
   exact scores of each query's best documents by them give a lower bound: the
   ``TOP``-th of these.
2. Every list of a query is read down to one threshold, such that a document
   that is met in none can't reach the bound: a list gives it the threshold at
   most, or the list's own first posting where that is less.  The sums give a
   better bound, and what a document can have at most (its sum, and so much for
   each list it wasn't met in) against it leaves the candidates.
3. The candidates' exact scores are looked up in the forward index.

Queries are the stated set: they are dealt to blocks of about ``TERMS``
(query, term) rows (or one query), which are broadcast; documents, postings and
candidates are shuffled, or broadcast behind a count.  Terms are told apart by
64-bit hashes.  All numbers but the weights' logarithm are integers.

Edge cases: null texts have no terms; documents and queries without terms, and
queries whose terms no document has, give no row; terms in all but a few
documents weigh 0; equal scores rank by doc_id, rows without one last, and rows
that repeat a doc_id are documents each; queries that repeat an item_id are
queries each; very long texts are read in pieces, cut at white space; an empty
table on either side gives an empty result; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import sys
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, partitions, read_documents, release, small, stash, text_or_empty, word_rows
from .toxicity import _WORDY

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOP, TERMS = 20, 500_000

#: Postings of a head, and documents by partial scores whose exact scores make
#: the first bound.
HEAD, LOOKED_UP = 5 * TOP, 10 * TOP


def term_counts(column):
    """(row, hash, occurrences) of the distinct terms of texts, some at a time."""
    for i, j, hashes, first in word_rows(column, table=_WORDY):
        row = np.repeat(np.arange(i, j), np.diff(first))
        order = np.lexsort((hashes, row))
        h, r = hashes[order], row[order]
        new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (r[1:] != r[:-1]))[: len(h)])
        yield r[new], h[new], np.diff(np.append(new, len(h)))


def query_terms(items: DataFrame) -> DataFrame:
    """item (a number for each row), item_id, hash and times of every term."""

    def rows(batch):
        for row, hashes, n in term_counts(batch.column("text")):
            at = pa.array(row)
            yield pa.RecordBatch.from_pydict({"item": batch.column("item").take(at), "item_id": batch.column("item_id").take(at), "hash": pa.array(hashes.view(np.int64)), "times": pa.array(n)})

    numbered = stash(items.select(F.monotonically_increasing_id().alias("item"), "item_id", text_or_empty().alias("text")), "items")
    return map_arrow(numbered, rows, numbered.select("item", "item_id").schema.add("hash", "long").add("times", "long"))


def forward_index(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """A row for each document that has terms: row (a number), doc_id, n (its
    terms with repeats), and the places in the sorted vocabulary of those it has,
    with their occurrences."""
    vocabulary = vocabulary if len(vocabulary) else np.zeros(1, np.uint64)  # without queries nothing is found

    def lists(values, bounds):
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int32)))

    def rows(batch):
        ids = batch.column("doc_id")
        for i, j, hashes, first in word_rows(batch.column("text"), table=_WORDY):
            n = np.diff(first)
            at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
            hit = np.flatnonzero(vocabulary[at] == hashes)
            row = np.repeat(np.arange(j - i), n)[hit]
            cells, tf = np.unique(row * len(vocabulary) + at[hit], return_counts=True)
            full = np.flatnonzero(n)
            bounds = np.append(np.searchsorted(cells, full * len(vocabulary)), len(cells))
            yield pa.RecordBatch.from_pydict({"doc_id": ids.take(pa.array(i + full)), "n": pa.array(n[full]), "terms": lists(cells % len(vocabulary), bounds), "tf": lists(tf, bounds)})

    found = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), rows, "doc_id long, n long, terms array<int>, tf array<int>")
    return stash(found.withColumn("row", F.monotonically_increasing_id()), "forward")


def contribution(n_docs: int, n_terms: int) -> Column:
    """Of a term with ``tf`` occurrences to a document of ``n`` terms."""
    m = 75 + _div(25 * F.col("n") * F.lit(n_docs).cast("long"), F.lit(max(1, n_terms)).cast("long"))
    return _div(F.lit(1_000_000_000).cast("long") * F.col("tf"), 1000 * F.col("tf") + 12 * m)


def _div(a: Column, b: Column) -> Column:
    """Of integers, towards zero."""
    return F.call_function("div", a, b)


def _best(rows: DataFrame, by: list[str], order: list[Column], most: int, name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= most)


class Index:
    """Forward index and postings of the corpus for a block of queries."""

    def __init__(self, docs: DataFrame, queries: DataFrame) -> None:
        """``queries``: item, hash, times of a block (stashed)."""
        vocabulary = np.sort(np.array([r["hash"] for r in queries.select("hash").distinct().collect()], np.int64).view(np.uint64))
        self.forward = forward_index(docs, vocabulary)
        total = self.forward.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
        self.gain = contribution(total["docs"], total["terms"] or 0)
        spark = docs.sparkSession
        place = spark.createDataFrame(list(zip(vocabulary.view(np.int64).tolist(), range(len(vocabulary)))), "hash long, term int")
        counts = self.forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        weight = F.floor(1000 * F.log((2.0 * total["docs"] + 2) / (2.0 * F.col("df") + 1))).cast("long")
        own = queries.join(F.broadcast(place), "hash").join(counts, "term").select("item", "term", (weight * F.col("times")).alias("g")).where("g > 0")
        #: item, term, g (the query's weight of the term).
        self.weights = stash(own, "weights", True)
        rows = self.forward.select("row", "n", F.explode(F.arrays_zip("terms", "tf")).alias("x")).select("row", "n", F.col("x.terms").alias("term"), F.col("x.tf").cast("long").alias("tf"))
        asked = F.broadcast(self.weights.select("term").distinct())
        rows = rows.join(asked, "term", "left_semi").select("term", self.gain.alias("c"), "row")
        order = [F.col("term"), F.desc("c"), F.col("row")]
        self.postings = stash(rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order), "postings")

    def heads(self, most: int = HEAD) -> DataFrame:
        """The first postings of every list, ranked."""

        def first(batch):
            term, c, row = (np.asarray(batch.column(k)) for k in ("term", "c", "row"))
            order = np.lexsort((row, -c, term))
            start = np.flatnonzero(np.append(True, np.diff(term[order]) != 0))
            place = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
            yield batch.take(pa.array(order[place < most]))

        return _best(map_arrow(self.postings, first, self.postings.schema), ["term"], [F.desc("c"), F.col("row")], most)

    def exact(self, pairs: DataFrame) -> DataFrame:
        """item, row, doc_id and score of (item, row) pairs (stashed)."""
        found = self.forward.join(small(pairs), "row").select("item", "row", "doc_id", "n", F.explode(F.arrays_zip("terms", "tf")).alias("x"))
        found = found.select("item", "row", "doc_id", "n", F.col("x.terms").alias("term"), F.col("x.tf").cast("long").alias("tf"))
        found = found.join(F.broadcast(self.weights), ["item", "term"])
        return found.groupBy("item", "row", "doc_id").agg(F.sum(F.col("g") * self.gain).alias("score"))

    def thresholds(self, most: int = TOP) -> DataFrame:
        """Phase 1: for each list of each query (item, term, g) its first posting
        ``top``, the query's lower ``bound``, 0 where the heads hold too few
        documents, and the threshold ``t``."""
        heads = stash(self.heads(max(HEAD, most)), "heads", True)
        sums = heads.join(F.broadcast(self.weights), "term").groupBy("item", "row").agg(F.sum(F.col("g") * F.col("c")).alias("part"))
        tried = stash(_best(sums, ["item"], [F.desc("part"), F.col("row")], max(LOOKED_UP, most)).select("item", "row"), "tried", True)
        last = _best(self.exact(tried), ["item"], [F.desc("score"), F.col("row")], most).where(F.col("rank") == most).select("item", F.col("score").alias("bound"))
        lists = self.weights.join(heads.where("rank = 1").select("term", F.col("c").alias("first")), "term").select("item", "term", "g", (F.col("g") * F.col("first")).alias("top"))
        lists = lists.join(last, "item", "left").withColumn("bound", F.coalesce("bound", F.lit(0)))
        # The tops in rising order: what is left below the bound, shared by those that exceed their share.
        rising, own = Window.partitionBy("item").orderBy("top", "term"), Window.partitionBy("item")
        lower = F.coalesce(F.sum("top").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        share = _div(F.greatest(F.lit(0), F.col("bound") - 1 - lower), F.count(F.lit(1)).over(own) - F.row_number().over(rising) + 1)
        lists = lists.withColumn("t", share).withColumn("t", F.coalesce(F.min(F.when(F.col("t") < F.col("top"), F.struct("top", "term", "t"))).over(own)["t"], F.lit(0)))
        return stash(lists, "thresholds", True)

    def candidates(self, most: int = TOP) -> DataFrame:
        """Phase 2: the (item, row) that can be among the best."""
        cap = F.least("t", "top")  # what a document that the list isn't read down to gets from it at most
        lists = self.thresholds(most).withColumn("cap", cap)
        asked = F.broadcast(lists.select(F.col("term").alias("_term"), "item", "g", "cap", (_div(F.col("t"), F.col("g")) + 1).alias("least")))
        met = self.postings.join(asked, (F.col("term") == F.col("_term")) & (F.col("c") >= F.col("least")))
        sums = stash(met.groupBy("item", "row").agg(F.sum(F.col("g") * F.col("c")).alias("part"), F.sum("cap").alias("met")), "sums")
        better = _best(sums, ["item"], [F.desc("part"), F.col("row")], most).where(F.col("rank") == most).select("item", F.col("part").alias("better"))
        queries = lists.groupBy("item").agg(F.max("bound").alias("bound"), F.sum("cap").alias("caps")).join(better, "item", "left")
        queries = stash(queries.select("item", "caps", F.greatest("bound", F.coalesce("better", F.lit(0))).alias("bound")), "bounds", True)
        able = F.col("part") + F.col("caps") - F.col("met") >= F.col("bound")
        out = stash(sums.join(F.broadcast(queries), "item").where(able).select("item", "row"), "candidates", True)
        release(sums)
        return out

    def best(self, most: int = TOP) -> DataFrame:
        """item, rank, doc_id and score.  Phase 3: exact scores of candidates."""
        scores = self.exact(self.candidates(most)).where("score > 0")
        release(self.postings)
        return _best(scores, ["item"], [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("row")], most).select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, most: int = TOP, terms: int = TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of the best documents for each item."""
    queries = stash(query_terms(items), "queries", True)
    blocks, parts = max(1, -(-queries.count() // terms)), []
    for k in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        parts.append(Index(docs, own).best(most))
    names = queries.select("item", "item_id").distinct()
    return reduce(DataFrame.unionByName, parts).join(names, "item").select("item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), n AS (
  SELECT doc_id, count(*)::BIGINT AS n FROM d GROUP BY doc_id
), c AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM n
), p AS (
  SELECT doc_id, term, count(*)::BIGINT AS tf FROM d SEMI JOIN q USING (term) GROUP BY doc_id, term
), w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c GROUP BY term, docs
), s AS (
  SELECT item_id, doc_id, sum(w * times * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
  FROM (SELECT item_id, term, count(*)::BIGINT AS times FROM q GROUP BY ALL) JOIN w USING (term) JOIN p USING (term) JOIN n USING (doc_id), c
  GROUP BY item_id, doc_id
), r AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""
