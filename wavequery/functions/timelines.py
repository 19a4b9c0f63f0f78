"""What timelines share, counted by numpy for a batch of rows at once.

Folds in the JVM cost some 100 microseconds a timeline.  Here all events of a
batch are flat arrays, strings are numbers, and a step deals with all rows: the
pairs of events of a type, of bounded number, then the first predicted events of
all rows, the second ones, and so on.  Rows with long sides go one by one through
the index and the numbers of ``intervals``.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .intervals import FOLDED, LEAST_IOU, ONGOING, common_length, match_events
from .text import WHITE

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Pairs of events in memory at a time.
CELLS = 1 << 19

#: ``text.MINUTES_SECONDS`` for Python.
_W = f"[{re.escape(WHITE)}]*"
CLOCK = rf"{_W}([+-]?[0-9]+){_W}:{_W}([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)){_W}(?::|\Z)"


def coded(*arrays: pa.Array) -> tuple[list[np.ndarray], list[str]]:
    """The arrays' strings as numbers, NULL as -1, and the strings."""
    both = pa.concat_arrays(arrays).dictionary_encode()
    codes = both.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(codes, np.cumsum([len(a) for a in arrays])[:-1]), both.dictionary.to_pylist()


def clock(text: str) -> float:
    """``text.seconds_or_zero`` of a string."""
    got = re.match(CLOCK, text)
    return int(got[1]) * 60 + float(got[2]) if got and -(1 << 63) <= int(got[1]) < 1 << 63 else 0.0


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... (n of them) of each, one after another."""
    return np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)


def bounded(rows: np.ndarray, cells: np.ndarray) -> list[np.ndarray]:
    """The rows in parts that have some ``CELLS`` cells each."""
    return np.split(rows, np.flatnonzero(np.diff(np.cumsum(cells) // CELLS)) + 1) if len(rows) else []


def overlap(s1, e1, s2, e2) -> np.ndarray:
    """``intervals.temporal_iou``; of what is no number, as Spark has it."""
    with np.errstate(all="ignore"):
        hull = np.maximum(e1, e2) - np.fmin(s1, s2)
        return np.where((hull > 0) | np.isnan(hull), np.maximum(0.0, np.fmin(e1, e2) - np.maximum(s1, s2)) / hull, 0.0)


def matches(n: np.ndarray, true: np.ndarray, kind: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """``intervals.greedy_match`` of many rows: of each predicted event the place
    of its true event, or -1.  First all predicted events stand in ``kind``, ``s``
    and ``e``, n a row, then all true ones."""
    own, other = np.cumsum(n) - n, n.sum() + np.cumsum(true) - true
    out, free = np.full(n.sum(), -1, np.int64), np.ones(len(kind), bool)
    long = np.maximum(n, true) > FOLDED
    for r in np.flatnonzero(long):
        a, b = slice(own[r], own[r] + n[r]), slice(other[r], other[r] + true[r])
        m = match_events((kind[a], s[a], e[a]), (kind[b], s[b], e[b]))
        out[a] = np.where(m >= 0, other[r] + m, -1)
    rows = np.flatnonzero(~long & (n > 0) & (true > 0))
    for some in bounded(rows, n[rows] * true[rows]):
        i, many = spread(own[some], n[some]), np.repeat(true[some], n[some])
        rank = np.repeat(i - np.repeat(own[some], n[some]), many)
        i, j = np.repeat(i, many), spread(np.repeat(other[some], n[some]), many)
        same = kind[i] == kind[j]
        i, j, rank = i[same], j[same], rank[same]
        v = overlap(s[i], e[i], s[j], e[j])
        v[np.isnan(v)] = np.inf  # above all numbers
        near = v > LEAST_IOU
        i, j, rank, v = i[near], j[near], rank[near], v[near]
        order = np.lexsort((j, -v, i, rank))
        i, j, rank = i[order], j[order], rank[order]
        for a, z in zip(*(np.searchsorted(rank, np.unique(rank), side) for side in ("left", "right"))):
            left = free[j[a:z]]
            x, y = i[a:z][left], j[a:z][left]
            best = np.append(True, x[1:] != x[:-1])[: len(x)]
            out[x[best]], free[y[best]] = y[best], False
    return out


def common(k: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``intervals.lcs_length`` of many rows: k elements of a and of b each."""
    first, out = np.cumsum(k) - k, k.copy()
    differ = np.bincount(np.repeat(np.arange(len(k)), k), a != b, len(k)) > 0
    for r in np.flatnonzero(differ & (k > FOLDED)):
        out[r] = common_length(*(x[first[r] : first[r] + k[r]].tolist() for x in (a, b)))
    rows = np.flatnonzero(differ & (k <= FOLDED))
    for some in bounded(rows, k[rows] ** 2):
        size, at = k[some], np.cumsum(k[some]) - k[some]
        many = np.repeat(size, size)
        i, j = np.repeat(spread(first[some], size), many), spread(np.repeat(first[some], size), many)
        bit = np.where(a[i] == b[j], np.int64(1) << spread(np.zeros_like(many), many), 0)
        u = np.add.reduceat(bit, np.cumsum(many) - many)
        full = (np.int64(1) << size) - 1
        v = full.copy()
        for step in range(size.max()):
            on = size > step
            x = v[on]
            y = x & u[at[on] + step]
            v[on] = ((x + y) | (x - y)) & full[on]
        out[some] = size - np.bitwise_count(v)
    return out


def named_alike(a: str | None, b: str | None) -> float:
    """The share of the true event's overlaps b that a names, too."""
    if not b:
        return 0.0 if a else 1.0
    names = set(b.split(", "))
    return len(names & set(a.split(", "))) / len(names) if a else 0.0


SHARED = T.StructType([T.StructField(c, T.DoubleType() if c in ("iou", "overlaps") else T.LongType()) for c in ("k", "iou", "overlaps", "lcs", "strict")])


@F.arrow_udf(SHARED)
def _shared(predicted: pa.Array, true: pa.Array, predicted_types: pa.Array, true_types: pa.Array) -> pa.Array:
    n, m = (pc.list_value_length(x).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (predicted, true))
    events = predicted.flatten(), true.flatten()

    def field(name: str) -> list[pa.Array]:
        return [pc.struct_field(x, name).cast(pa.string()) for x in events]

    (p_kind, t_kind), _ = coded(predicted_types.flatten(), true_types.flatten())
    t_kind[t_kind < 0] = -2  # NULL is no type
    (p_s, t_s, p_e, t_e), texts = coded(*field("start"), *field("end"))
    value, ongoing = np.array([clock(x) for x in texts] + [0.0]), np.array([x.lower() == "ongoing" for x in texts] + [False])
    start, end = np.append(p_s, t_s), np.append(p_e, t_e)
    s = value[start]
    e = np.where(ongoing[end], s + ONGOING, value[end])
    j = matches(n, m, np.append(p_kind, t_kind), s, e)
    i = np.flatnonzero(j >= 0)
    j, row = j[i], np.repeat(np.arange(len(n)), n)[i]
    k = np.bincount(row, minlength=len(n))
    types, names = np.concatenate(coded(*field("event_type"))[0]), coded(*field("overlaps"))
    texts = [*names[1], None]
    both, again = np.unique(names[0][0][i] % len(texts) * len(texts) + names[0][1][j - n.sum()] % len(texts), return_inverse=True)
    alike = np.array([named_alike(texts[x // len(texts)], texts[x % len(texts)]) for x in both.tolist()] + [0.0])[again]
    by_time = np.lexsort((s[j], row))
    out = {
        "k": k,
        "iou": np.bincount(row, overlap(s[i], e[i], s[j], e[j]), len(n)),
        "overlaps": np.bincount(row, alike, len(n)),
        "lcs": common(k, types[i], types[j]),
        "strict": common(k, types[i], types[j][by_time]),
    }
    return pa.StructArray.from_arrays([pa.array(x) for x in out.values()], list(out))


def shared(predicted: Column, true: Column) -> Column:
    """struct<k, iou, overlaps, lcs, strict> of two arrays of events: how many are
    matched, the sums of their overlaps in time and in names, and the longest
    common subsequences of their types, with true events by place and by time."""
    # Types are lower-cased as in the folds, by the JVM.
    return _shared(predicted, true, *[F.transform(x, lambda y: F.lower(y["event_type"])) for x in (predicted, true)])
