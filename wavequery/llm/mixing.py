"""Mixing sources to target weights (native DataFrame operations).

Targets: sources rank by code point, null last, and weigh 5, 2, 1, repeating.
They share ``SHARE`` times all words in proportion; no target exceeds ``CAP``
times its source's words, and what is cut off is shared out again by weight
(water-filling, solved in closed form over the sources' sorted ratios).

Within a source every document is taken for each complete epoch.  The rest of
the target is filled by Efraimidis-Spirakis order: key = -ln(u) / weight, u a
hash of doc_id, weight the document's quality weight; documents are sorted by
key, their words prefix-summed, and a document is taken while that brings the
source's total closer to the target.

The sort is spread: a source with n of N rows gets about n / N of ``2 *
shuffle partitions`` buckets.  A bucket is an interval of keys; its bounds come
from the keys' distribution function, a mixture of exponentials over the
source's weight levels, so buckets are even whatever the weights are.  Prefix
sums run inside buckets and are offset by the bucket totals, so a source with a
third of all rows never meets in one task.  Row counts, not values, bound every
table that is broadcast.

What a source takes beyond its epochs is a prefix of this order, so ``mixed``
needs no join by document: each source's last taken document, one row a source,
meets the documents where they are, and no text is shuffled.

Edge cases: null text has size 0; documents of size 0 take 0 words, and are
part of ``mixed`` once an epoch; a source without words has target 0; null is a source of its
own, last in order; rows without a doc_id draw by their text; rows that repeat a
doc_id share a draw and are ordered by size and text; rows equal in all of
these are taken alike by ``mixed``, as the first of them is; texts are counted
whole, however long; an empty table gives an empty result; other columns,
whatever their names, play no role and survive in ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, partitions, read_documents, stash, text_or_empty, unit_hash

SHARE, CAP, WEIGHTS, SEED = 1.5, 2.0, (5.0, 2.0, 1.0), 17

#: Quality weights are rounded up to these levels.
LEVELS = (0.25, 0.5, 0.75, 1.0)

#: Sources that may be broadcast at most (about 100 bytes each).
BROADCAST_SOURCES = 50_000


def quality_weight(n_chars: Column, size: Column) -> Column:
    """1 for documents with words of 4 to 8 characters on average, less beyond."""
    mean = n_chars / F.greatest(size, F.lit(1))
    off = F.greatest(F.lit(0.0), F.lit(5.0) - mean, mean - F.lit(9.0))
    return F.when(off < 1.0, 1.0).when(off < 2.0, 0.75).when(off < 4.0, 0.5).otherwise(0.25)


def source_targets(sources: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Add ``target`` to a table of sources (source, source_size); one row per
    source, so its global windows hold no documents."""
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    rank = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), rank + 1)
    t = sources.select("*", weight.alias("_w")).withColumn("_cap", cap * F.col("source_size"))
    t = t.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    upto = Window.orderBy(F.col("_ratio"), F.col("source").asc_nulls_last())
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    # The share per weight if exactly the sources before this one are capped.
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    )
    t = t.withColumn("_level", level)
    # The first source, by ratio, that its cap does not bind sets the level.
    found = F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", "_level"))).over(everything)["_level"]
    target = F.when(found.isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), found * F.col("_w")))
    return t.withColumn("target", target.cast("double")).drop("_w", "_cap", "_ratio", "_level")


def _level(weight: Column) -> Column:
    level = F.lit(LEVELS[-1])
    for x in reversed(LEVELS[:-1]):
        level = F.when(weight <= x, F.lit(x)).otherwise(level)
    return level


def _ordered(docs: DataFrame, weight: Column | None, seed: int) -> list[Column]:
    """What decides a row's place: its source, size, weight level, key, and the
    doc_id and text hash that order rows of one key."""
    text = text_or_empty()
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    weight = quality_weight(F.length(text), size) if weight is None else weight
    draw = unit_hash(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(text.cast("binary")))), seed)
    return [
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("_s"),
        size.alias("_size"),
        _level(weight).alias("_level"),
        (-F.log(draw) / weight).alias("_key"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_id"),
        F.xxhash64(text).alias("_hash"),
    ]


def mix(docs: DataFrame, weight: Column | None = None, seed: int = SEED, share: float = SHARE, cap: float = CAP, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source for every row.

    ``weight``: a column in (0, 1]; by default ``quality_weight`` of the text.
    ``copies``: how often the mix holds the document; taken = size * copies.
    """
    rows = _plan(docs, weight, seed, share, cap, weights)
    return rows.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("copies") * F.col("_size")).alias("taken"), "copies", "source")


def _plan(docs: DataFrame, weight: Column | None, seed: int, share: float, cap: float, weights: tuple[float, ...]) -> DataFrame:
    """For every row: its place (see ``_ordered``), epochs, whether one copy
    more is taken, and copies."""
    spark = docs.sparkSession
    narrow = stash(docs.select("doc_id", F.col("source").cast("string").alias("source"), *_ordered(docs, weight, seed)), "sizes")
    shares = [F.avg((F.col("_level") == x).cast("double")).alias(f"_p{i}") for i, x in enumerate(LEVELS)]
    sources = narrow.groupBy("_s").agg(F.first("source").alias("source"), F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("_rows"), *shares)
    targets = stash(source_targets(sources, share, cap, weights), "targets", True)
    total = targets.agg(F.sum("_rows").alias("rows"), F.count(F.lit(1)).alias("n")).first()
    buckets = 2 * partitions(spark)
    side = targets.drop("source")
    rows = narrow.join(F.broadcast(side) if total["n"] <= BROADCAST_SOURCES else side, "_s")
    below = sum((F.col(f"_p{i}") * (1 - F.exp(-F.col("_key") * x)) for i, x in enumerate(LEVELS)), F.lit(0.0))
    own = F.greatest(F.lit(1.0), F.ceil(F.col("_rows") * (buckets / max(1, total["rows"] or 1))))
    rows = rows.select("doc_id", "source", "_size", "source_size", "target", "_s", "_key", "_id", "_hash", F.least(own - 1, F.floor(below * own)).cast("int").alias("_b"))
    sums = rows.groupBy("_s", "_b").agg(F.sum("_size").alias("_words"))
    ahead = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_s", "_b", F.coalesce(F.sum("_words").over(ahead), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_s", "_b").orderBy("_key", "_id", "_size", "_hash").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_upto", F.sum("_size").over(inside)).join(sums, ["_s", "_b"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rows = rows.withColumn("epochs", epochs)
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    before = F.col("_offset") + F.col("_upto") - F.col("_size")
    rows = rows.withColumn("more", (F.col("_size") > 0) & (2 * before + F.col("_size") <= 2 * rest))
    return rows.withColumn("copies", F.col("epochs") + F.col("more").cast("long"))


def mixed(docs: DataFrame, weight: Column | None = None, seed: int = SEED, share: float = SHARE, cap: float = CAP, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The rows of ``docs``, with all columns, each as often as the mix takes it."""
    place = F.struct("_key", "_id", "_size", "_hash")
    plan = _plan(docs, weight, seed, share, cap, weights)
    last = stash(plan.groupBy(F.col("_s").alias("_mix_s")).agg(F.first("epochs").alias("_mix_n"), F.max(F.when(F.col("more"), place)).alias("_mix_last")), "last_taken", True)
    side = F.broadcast(last) if last.count() <= BROADCAST_SOURCES else last
    # All columns go as one, so none can clash with those of the plan.
    rows = docs.select(F.struct("*").alias("_row"), F.struct(*_ordered(docs, weight, seed)).alias("_own")).join(side, F.col("_own._s") == F.col("_mix_s"))
    at = F.struct(*[F.col(f"_own.{c}") for c in ("_key", "_id", "_size", "_hash")])
    more = (F.col("_own._size") > 0) & F.coalesce(at <= F.col("_mix_last"), F.lit(False))
    rows = rows.withColumn("_n", (F.col("_mix_n") + more.cast("long")).cast("int")).where("_n > 0")
    return rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("_row.*")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, length(coalesce(text, '')) AS n,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), w AS (
  SELECT *, greatest(0.0::DOUBLE, 5.0::DOUBLE - n / greatest(size, 1)::DOUBLE, n / greatest(size, 1)::DOUBLE - 9.0::DOUBLE) AS off FROM d
), k AS (
  SELECT doc_id, source, size,
         -ln((('0x' || substr(md5('17:' || doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
           / (CASE WHEN off < 1 THEN 1.0 WHEN off < 2 THEN 0.75 WHEN off < 4 THEN 0.5 ELSE 0.25 END)::DOUBLE AS key
  FROM w
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source
), r AS (
  SELECT *, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight,
         2.0::DOUBLE * source_size AS cap
  FROM s
), l AS (
  SELECT *, cap / weight AS ratio,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM r
  WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size,
         least(cap, coalesce((SELECT level FROM l WHERE ratio >= level ORDER BY ratio, level LIMIT 1) * weight, cap)) AS target
  FROM l
), p AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS epochs,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) - k.size AS before
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN size > 0 AND 2 * before + size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
"""
