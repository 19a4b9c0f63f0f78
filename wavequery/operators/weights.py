"""Poisson weights of bootstrap replicates, by numpy on Arrow batches.

A replicate weighs every value by a Poisson(1) number.  Equal values are weighed
together: ``2**k`` of them by one Poisson(``2**k``) number.  A weight depends on
its row's seed and the replicate alone, so results don't depend on partitioning.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Weights of 2**k equal values are drawn at once, for k up to this.
AT_ONCE = 12

#: Weights that are in memory at a time: what fits a core's cache.
CELLS = 1 << 17


def cumulative(mean: float) -> tuple[int, np.ndarray]:
    """The least number that counts, and cumulative probabilities from it on."""
    low = max(0, int(mean - 7.5 * math.sqrt(mean)))
    x = np.arange(low, int(mean + 7.5 * math.sqrt(mean)) + 12)
    return low, np.cumsum(np.exp(x * math.log(mean) - mean - np.array([math.lgamma(i + 1) for i in x.tolist()])))


def bits(seeds: np.ndarray, replicates: int) -> np.ndarray:
    """64 bits for each seed and replicate: a mixed counter."""
    h = seeds[:, None] + np.arange(1, replicates + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def uniform(h: np.ndarray) -> np.ndarray:
    """A number in [0, 1) of the first 53 bits."""
    return (h >> np.uint64(11)) * 2.0**-53


#: First bits of a number that are looked up.
LOOKED_UP = 16


def lookup(low: int, table: np.ndarray) -> np.ndarray:
    """For all first bits the Poisson number that they decide, or -1 where it
    depends on the bits behind them."""
    first = np.arange(1 << LOOKED_UP, dtype=np.uint64) << np.uint64(64 - LOOKED_UP)
    ends = [np.searchsorted(table, uniform(x), "right") + low for x in (first, first | np.uint64((1 << 64 - LOOKED_UP) - 1))]
    return np.where(ends[0] == ends[1], ends[0], -1).astype(np.int16)


def poisson(h: np.ndarray, low: int, table: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The Poisson numbers of random bits: mostly by their first bits, those that
    these don't decide by search."""
    x = known[(h >> np.uint64(64 - LOOKED_UP)).view(np.int64)]
    open_ = x < 0
    x[open_] = np.searchsorted(table, uniform(h[open_]), "right") + low
    return x.astype(np.float64)


def weigh(replicates: int):
    """(g, value, k, seed), sorted by g, to the sums of weights, and of weighted
    values, of each group and replicate, BLOCK replicates a row."""
    tables = [(*t, lookup(*t)) for t in (cumulative(2.0**k) for k in range(AT_ONCE + 1))]

    def sums(value, k, seed):
        w, wv, step = np.zeros(replicates), np.zeros(replicates), max(1, CELLS // replicates)
        for each in np.unique(k).tolist():
            at = np.flatnonzero(k == each)
            for i in range(0, len(at), step):
                own = at[i : i + step]
                x = poisson(bits(seed[own], replicates), *tables[each])
                w += x.sum(0)
                wv += value[own] @ x
        return w, wv

    def rows(g, w, wv):
        cuts = range(0, replicates, BLOCK)
        return _rows([g] * len(cuts), range(len(cuts)), [w[i : i + BLOCK] for i in cuts], [wv[i : i + BLOCK] for i in cuts])

    def run(batches):
        at, total = None, None
        for batch in batches:
            g, value, k, seed = (np.asarray(batch.column(c)) for c in ("g", "value", "k", "seed"))
            bounds = np.flatnonzero(np.append(True, np.diff(g) != 0)) if len(g) else []
            for a, b in zip(bounds, [*bounds[1:], len(g)]):
                if at is not None and g[a] != at:
                    yield rows(at, *total)
                    total = None
                at = int(g[a])
                part = sums(value[a:b], k[a:b], seed[a:b].view(np.uint64))
                total = part if total is None else (total[0] + part[0], total[1] + part[1])
        if at is not None:
            yield rows(at, *total)

    return run


#: Replicates whose sums travel together.
BLOCK = 256


def _rows(g, block, w, wv) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((g, block, w, wv), kinds)], ["g", "block", "w", "wv"])


def added(batches):
    """The sums of all tasks, sorted by g and block, to one row for each; two
    rows are in memory at a time, however many tasks there were."""
    at, w, wv = None, None, None
    for batch in batches:
        out = []
        for i, key in enumerate(zip(batch.column("g").to_pylist(), batch.column("block").to_pylist())):
            x, y = (np.asarray(batch.column(c)[i].values) for c in ("w", "wv"))
            if key == at:
                w, wv = w + x, wv + y
            else:
                if at is not None:
                    out.append((*at, w, wv))
                at, w, wv = key, x, y
        if out:
            yield _rows(*zip(*out))
    if at is not None:
        yield _rows([at[0]], [at[1]], [w], [wv])


def interval(confidence: float):
    """The percentiles of a group's weighted means, from one row for each block."""
    tail = 100 * (1 - confidence) / 2

    def one(table: pa.Table) -> pa.Table:
        w, wv = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("w", "wv"))
        low, high = np.percentile(wv[w > 0] / w[w > 0], [tail, 100 - tail])
        return pa.table({"g": table.column("g")[:1], "ci_lo": pa.array([low]), "ci_hi": pa.array([high])})

    return one
