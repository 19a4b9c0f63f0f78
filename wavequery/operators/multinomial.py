"""Bootstrap draws with replacement that move no draw.

A replicate of n values takes each of them a number of times that add up to n.
These numbers are dealt down a binary tree: a node has m draws and the weights
(numbers of values) of its two halves, and the left half takes a binomial number
of them.  First buckets are the leaves, then the distinct values of a bucket, so
equal values are drawn together and no row is made for a draw.

All is integer arithmetic.  A binomial number is counted bit by bit: of m random
numbers in [0, 1), as many as m random bits have zeros start with 0; the next bit
of the probability decides whether those are below it, or the others above.  Bits
are 64 at a time from a counter mixed with group, replicate and node, so any
engine can repeat the draws, in any partitioning.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Distinct values of a bucket, on average; replicates that are drawn together;
#: nodes times replicates in memory at a time.
LEAF, TOGETHER, CELLS = 4096, 256, 1 << 19

GOLDEN, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX_1)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX_2)
    return h ^ (h >> np.uint64(31))


def replicate_seeds(group: int, first: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(np.uint64(group) + np.arange(first, first + n, dtype=np.uint64) * np.uint64(GOLDEN))


def halves(seed: np.ndarray, draws: np.ndarray, step: int) -> np.ndarray:
    """How many of ``draws`` random bits are zeros, counted as ones of words."""
    def word(seed: np.ndarray, left: np.ndarray, j: int) -> np.ndarray:
        ones = mixed(seed + np.uint64(step << 40 | j) * np.uint64(GOLDEN))
        return np.bitwise_count(ones & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (64 - np.minimum(64, left)).astype(np.uint64))).astype(np.int64)

    # Nearly all have no more than one word, and need no places.
    out, j = word(seed, draws, 0), 1
    todo = np.flatnonzero(draws > 64)
    while len(todo):
        left = draws[todo] - 64 * j
        out[todo] += word(seed[todo], left, j)
        todo, j = todo[left > 64], j + 1
    return out


def binomial(seed: np.ndarray, draws: np.ndarray, part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """How many of ``draws`` fall into ``part`` of ``whole``."""
    below, step = np.zeros(len(draws), np.int64), 0
    at = np.flatnonzero((draws > 0) & (part > 0))
    seed, rest, left, whole = seed[at], part[at], draws[at], whole[at]
    while len(at):
        zeros = halves(seed, left, step)
        rest = rest * 2
        one = rest >= whole
        rest -= whole * one
        below[at] += zeros * one
        left = np.where(one, left - zeros, zeros)
        # Those that are open move together: no step looks places up.
        on = (left > 0) & (rest > 0)
        at, seed, rest, left, whole = at[on], seed[on], rest[on], left[on], whole[on]
        step += 1
    return below


def deal(seeds: np.ndarray, draws: np.ndarray, weights: np.ndarray, root: int):
    """Yields (leaf, draws of each replicate) for the leaves that ``weights`` are,
    from the draws of their common node ``root``: its number, whose halves are
    numbered twice it and one more."""
    upto = np.append(0, np.cumsum(weights))
    lo, hi, node, got = np.array([0]), np.array([len(weights)]), np.array([root], np.uint64), draws[None, :].astype(np.int64)
    open_ = [(lo, hi, node, got)]
    while open_:
        lo, hi, node, got = open_.pop()
        single = hi - lo == 1
        for k in np.flatnonzero(single):
            yield int(lo[k]), got[k]
        lo, hi, node, got = lo[~single], hi[~single], node[~single], got[~single]
        step = max(1, CELLS // max(1, len(seeds)))
        for a in range(0, len(lo), step):
            l, h, n, g = lo[a : a + step], hi[a : a + step], node[a : a + step], got[a : a + step]
            mid = (l + h) // 2
            with np.errstate(over="ignore"):
                seed = mixed(seeds[None, :] + n[:, None] * np.uint64(GOLDEN)).ravel()
                shape = (len(l), len(seeds))
                part, whole = (np.broadcast_to((upto[x] - upto[l])[:, None], shape).ravel() for x in (mid, h))
                left = binomial(seed, g.ravel(), part, whole).reshape(shape)
            open_.append((np.concatenate([l, mid]), np.concatenate([mid, h]), np.concatenate([n * np.uint64(2), n * np.uint64(2) + np.uint64(1)]), np.concatenate([left, g - left])))


def sums(values: DataFrame, group, replicates: int, leaf: int = LEAF) -> DataFrame:
    """g, rep and total of every replicate of every group: the sum of its n draws.
    ``values``: q (a whole number), c (how many); ``group``: a long
    for each group."""
    own = values.select(group.alias("g"), F.col("q").cast("long").alias("q"), F.col("c").cast("long").alias("c"))
    size = own.groupBy("g").agg(F.count(F.lit(1)).alias("d"))
    depth = F.greatest(F.lit(0), F.ceil(F.log2(F.col("d") / leaf))).cast("int")
    own = own.join(size.select("g", depth.alias("depth")), "g")
    own = own.withColumn("bucket", F.pmod(F.xxhash64("q"), F.pow(F.lit(2.0), F.col("depth")).cast("long")))
    packed = F.array_sort(F.collect_list(F.struct("q", "c"))).alias("cells")  # about ``leaf`` by construction
    buckets = own.groupBy("g", "depth", "bucket").agg(packed, F.sum("c").alias("weight"))
    weights = buckets.groupBy("g", "depth").agg(F.array_sort(F.collect_list(F.struct("bucket", "weight"))).alias("weights"))
    blocks = F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // TOGETHER) - 1))).alias("block")

    def top(batches):
        for batch in batches:
            for g, depth_, cells, block in zip(*(batch.column(c) for c in ("g", "depth", "weights", "block"))):
                first = block.as_py() * TOGETHER
                n = min(TOGETHER, replicates - first)
                full = np.zeros(1 << depth_.as_py(), np.int64)
                x = cells.values
                full[np.asarray(x.field("bucket"))] = np.asarray(x.field("weight"))
                seeds = replicate_seeds(g.as_py(), first, n)
                rows = [(k, got) for k, got in deal(seeds, np.full(n, full.sum()), full, 1) if full[k]]
                yield pa.RecordBatch.from_pydict({"g": pa.array([g.as_py()] * len(rows), pa.int64()), "bucket": pa.array([k for k, _ in rows], pa.int64()), "block": pa.array([block.as_py()] * len(rows), pa.int32()), "draws": pa.array([x.tobytes() for _, x in rows], pa.binary())})

    # Each group and block of replicates is work of its own.
    n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    drawn = weights.select("g", "depth", "weights", blocks).repartition(n, "g", "block").mapInArrow(top, "g long, bucket long, block int, draws binary")

    def inside(batches):
        for batch in batches:
            for g, depth_, bucket, cells, block, draws in zip(*(batch.column(c) for c in ("g", "depth", "bucket", "cells", "block", "draws"))):
                got = np.frombuffer(draws.as_buffer(), np.int64)
                first, x = block.as_py() * TOGETHER, cells.values
                q, c = np.asarray(x.field("q")), np.asarray(x.field("c"))
                total = np.zeros(len(got), np.int64)
                for k, times in deal(replicate_seeds(g.as_py(), first, len(got)), got, c, (1 << depth_.as_py()) + bucket.as_py()):
                    total += q[k] * times
                yield pa.RecordBatch.from_pydict({"g": pa.array(np.full(len(got), g.as_py())), "rep": pa.array(np.arange(first, first + len(got), dtype=np.int32)), "total": pa.array(total)})

    parts = drawn.join(buckets.select("g", "depth", "bucket", "cells"), ["g", "bucket"]).repartition(n, "g", "bucket", "block").mapInArrow(inside, "g long, rep int, total long")
    return parts.groupBy("g", "rep").agg(F.sum("total").alias("total"))
