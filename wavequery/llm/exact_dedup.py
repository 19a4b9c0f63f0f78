"""Exact deduplication with a heavy-hitter split (native DataFrame operations).

1. Every text becomes a SHA-256 digest, written once as a narrow table; the
   texts are read a single time.
2. A Misra-Gries summary (``freqItems``, at most ``1 / SUPPORT`` counters per
   task, merged like partial aggregates) names the digests that can be
   frequent.  It has false positives, so the candidates are counted exactly.
3. Verified winners, at most ``1 / SUPPORT`` rows by construction, are
   broadcast; their copies meet their group's row on the map side, unshuffled.
4. All other digests are aggregated (map-side combine) and joined back by
   ordinary shuffling; their groups are below ``SUPPORT`` of the rows.

Edge cases: null text counts as empty and equals the empty text; two rows that
repeat a doc_id are two rows of the same group; the group keeps the largest
doc_id (null doc_ids sort lowest, a group without any keeps null); texts are
hashed whole, however long; an empty table gives an empty result; other columns
of the input, whatever their names, play no role here and survive in
``deduplicate``, which keeps exactly one row for every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_one, read_documents, stash, text_or_empty

#: Share of all rows from which a digest may count as heavy.
SUPPORT = 1 / 2000


def text_sha() -> Column:
    return F.sha2(text_or_empty().cast("binary"), 256)


def _short(sha: Column) -> Column:
    """60 bits of a digest: with the doc_id, they name a row in 16 bytes."""
    return F.conv(F.substring(sha, 1, 15), 16, 10).cast("long")


def exact_groups(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    digests = stash(docs.select("doc_id", text_sha().alias("text_sha256")), "digests")
    heavy = _heavy_groups(digests, support)
    light = digests.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti")
    groups = light.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    both = light.join(groups, "text_sha256").unionByName(digests.join(F.broadcast(heavy), "text_sha256"))
    return both.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _heavy_groups(digests: DataFrame, support: float) -> DataFrame:
    """Exact groups of the digests that Misra-Gries names: 1 / support at most."""
    names = digests.stat.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    named = digests.join(F.broadcast(names), "text_sha256")
    return stash(
        named.groupBy("text_sha256")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where(F.col("group_size") > 1),
        "heavy",
        True,
    )


def deduplicate(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """One row of ``docs`` for every text, with all its columns: the one with
    the largest doc_id.  Rows are told apart by doc_id and text together, so rows
    that share a doc_id and differ in text all stay, null doc_ids included.  Of
    rows that repeat both, the first one met stays."""
    groups = exact_groups(docs, support).where("group_size > 1").withColumn("key", _short(F.col("text_sha256")))
    rows = groups.groupBy("doc_id", "key").agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    return keep_one(docs, _short(text_sha()), stash(rows, "copies", True))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_documents(spark, sf_dir))


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
