"""Intervals and sequences: overlap, greedy matching, common subsequences.

Matching and subsequences are folds over one row's arrays (about ten elements):
nothing is exploded or shuffled.  Rows with long arrays go through an index of
sorted starts and through bit-parallel subsequences, Arrow batches at a time;
``short`` rows are scored apart, without a way through Python.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import seconds_or_zero

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ONGOING = 10  # seconds that an open end lasts
LEAST_IOU = 0.3  # that a match exceeds

#: Events of a side up to which rows are folded; bits of a number that is no sign.
FOLDED = 62


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once a row: a generator of one row
    stands between them and what reads them, or else they would be written out
    in each place, folds within folds too."""
    row = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_pinned")
    return df.drop(*columns).select("*", row).select(*[c for c in df.columns if c not in columns], "_pinned.*")


def temporal_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap over the hull of two intervals; 0 for a hull of no length."""
    overlap = F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))
    hull = F.greatest(e1, e2) - F.least(s1, s2)
    return F.when(hull > 0, overlap / hull).otherwise(0.0)


def timed(events: Column) -> Column:
    """Events with seconds ``s`` and ``e`` besides their own fields."""

    def one(x: Column) -> Column:
        s = seconds_or_zero(x["start"])
        e = F.when(F.lower(x["end"]) == "ongoing", s + ONGOING).otherwise(seconds_or_zero(x["end"]))
        return F.struct(x["event_type"].alias("event_type"), s.alias("s"), e.alias("e"), x["overlaps"].alias("overlaps"))

    return F.transform(events, one)


def longer(a: Column, b: Column) -> Column:
    """Whether a side has more elements than are folded."""
    return F.coalesce(F.greatest(F.size(a), F.size(b)) > FOLDED, F.lit(False))


def greedy_match(predicted: Column, true: Column, short: bool = False) -> Column:
    """For every predicted event, in order, the index of the unused true event
    of its type with the highest overlap above 0.3 (the first of equal ones), or
    -1.  Both sides are ``timed`` arrays; ``short``: none of them is ``longer``,
    so that no row goes through Python."""

    def best(used: Column, x: Column, true: Column) -> Column:
        start = F.struct(F.lit(LEAST_IOU).alias("b"), F.lit(-1).alias("i"))

        def better(m: Column, g: Column) -> Column:
            v = temporal_iou(x["s"], x["e"], g["s"], g["e"])
            ok = (g["type"] == x["type"]) & ~F.array_contains(used, g["i"]) & (v > m["b"])
            return F.when(ok, F.struct(v.alias("b"), g["i"].alias("i"))).otherwise(m)

        return F.concat(used, F.array(F.coalesce(F.aggregate(true, start, better)["i"], F.lit(-1))))

    def plain(events: Column) -> Column:
        return F.transform(events, lambda x, i: F.struct(F.lower(x["event_type"]).alias("type"), x["s"].alias("s"), x["e"].alias("e"), i.alias("i")))

    def folded(predicted: Column, true: Column) -> Column:
        # Bound as in ``lcs_length``: types are lower-cased once an event, not once a pair.
        both = F.array(F.struct(plain(predicted).alias("p"), plain(true).alias("t")))
        return F.element_at(F.transform(both, lambda b: F.aggregate(b["p"], F.array().cast("array<int>"), lambda used, x: best(used, x, b["t"]))), 1)

    if short:
        return folded(predicted, true)
    long = longer(predicted, true)
    return F.when(long, _indexed_match(plain(F.when(long, predicted)), plain(F.when(long, true)))).otherwise(folded(F.when(~long, predicted), F.when(~long, true)))


def match_events(predicted: tuple, true: tuple) -> np.ndarray:
    """``greedy_match`` of (type numbers, starts, ends) of one row.

    True events of a type are sorted by their starts.  An overlap above 0.3 of
    the hull means a hull below the predicted length over 0.3, so only those that
    start in a window as long can match; they are compared all at once."""
    t_type, t_start, t_end = true
    order = np.lexsort((t_start, t_type))
    t_type, t_start, t_end = t_type[order], t_start[order], t_end[order]
    free, out = np.ones(len(order), bool), np.full(len(predicted[0]), -1, np.int32)
    first, last = np.searchsorted(t_type, predicted[0]), np.searchsorted(t_type, predicted[0], "right")
    for k, (s, e, a, z) in enumerate(zip(predicted[1].tolist(), predicted[2].tolist(), first.tolist(), last.tolist())):
        if e <= s or a == z:
            continue
        reach = (e - s) / LEAST_IOU * (1 + 1e-9)
        lo, hi = a + np.searchsorted(t_start[a:z], e - reach), a + np.searchsorted(t_start[a:z], e)
        near = lo + np.flatnonzero(free[lo:hi])
        if not len(near):
            continue
        overlap = np.maximum(0.0, np.minimum(e, t_end[near]) - np.maximum(s, t_start[near]))
        hull = np.maximum(e, t_end[near]) - np.minimum(s, t_start[near])
        iou = np.where(hull > 0, overlap / np.where(hull > 0, hull, 1.0), 0.0)
        most = iou.max()
        if most > LEAST_IOU:
            same = near[iou == most]
            own = same[np.argmin(order[same])]
            free[own], out[k] = False, order[own]
    return out


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _indexed_match(predicted: pa.Array, true: pa.Array) -> pa.Array:
    def side(events, row, names):
        x = events[row].values
        kinds = np.array([names.setdefault(t, len(names)) if t is not None else -1 - k for k, t in enumerate(x.field("type").to_pylist())], np.int64)
        return kinds, *(np.asarray(x.field(c), np.float64) for c in ("s", "e"))

    out = []
    for row in range(len(predicted)):
        names: dict = {}
        out.append(match_events(side(predicted, row, names), side(true, row, names)) if predicted[row].is_valid and true[row].is_valid else None)
    return pa.array(out, pa.list_(pa.int32()))


def lcs_length(a: Column, b: Column, short: bool = False) -> Column:
    """Length of the longest common subsequence; ``short`` as above.

    Bit-parallel: bit j of a number is 0 where a row of the table rises at j, so
    an element of ``a`` turns a row into the next one by an addition."""
    none = F.lit(0).cast("long")

    def bit(j: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), j)

    def folded(a: Column, b: Column) -> Column:
        def bits(x: Column) -> Column:
            return F.aggregate(F.transform(b, lambda y, j: F.when(y == x, bit(j)).otherwise(none)), none, lambda u, v: u.bitwiseOR(v))

        full = bit(F.size(b)) - 1

        def row(v: Column, u: Column) -> Column:
            return (v + u.bitwiseAND(v)).bitwiseOR(v - u.bitwiseAND(v)).bitwiseAND(full)

        return F.size(b) - F.bit_count(F.aggregate(F.transform(a, bits), full, row))

    def bound(a: Column, b: Column) -> Column:
        # A transform of one element binds both sides: they are computed once.
        return F.element_at(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda x: folded(x["a"], x["b"])), 1)

    some = (F.size(a) > 0) & (F.size(b) > 0)
    if short:
        # Often ``b`` is all of ``a``, but for NULLs, which are equal to nothing.
        whole = F.when(F.array_compact(a) == b, F.size(b))
        return F.when(some, F.coalesce(whole, bound(a, b))).otherwise(0)
    long = longer(a, b)
    return F.when(some, F.when(long, _long_lcs(F.when(long, a), F.when(long, b))).otherwise(bound(F.when(~long, a), F.when(~long, b)))).otherwise(0)


def common_length(a: list, b: list) -> int:
    """The same over one number of as many bits as ``b`` has elements."""
    where: dict = {}
    for j, x in enumerate(b):
        if x is not None:
            where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


@F.arrow_udf(T.IntegerType())
def _long_lcs(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else common_length(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int32())
