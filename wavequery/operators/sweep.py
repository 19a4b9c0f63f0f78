"""Join of overlapping intervals by a plane sweep over ranges of time.

Rows of both sides are sorted together by key and start, and cut into ranges of
about equal size, so a key that a third of all rows have is many ranges.  A pair
belongs where its later start is.  Intervals that are still open where a range
ends are carried into the following ranges of their key as far as they reach;
each of them pairs with every start of the other side that it covers there, so
carrying is less than the result.  In a range, the starts that an interval
covers are a run of the sorted starts, found by binary search; pairs are made
some at a time.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import keep

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Pairs that are made at a time.
PAIRS = 1 << 16


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], start: str = "s", end: str = "e", ranges: int | None = None) -> DataFrame:
    """Pairs of rows with equal keys whose intervals [start, end) overlap.
    Columns of the right side, keys aside, get the suffix ``_r``.  Empty
    intervals, and rows with a null among keys and ends, pair with none.  Rows
    that are repeated pair each."""
    spark = left.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    right = right.select(*keys, *[F.col(c).alias(c + "_r") for c in right.columns if c not in keys])

    def side(df: DataFrame, number: int, s: str, e: str) -> DataFrame:
        known = F.col(e) > F.col(s)
        for k in keys:
            known = known & F.col(k).isNotNull()
        own = [F.struct(*[c for c in x.columns if c not in keys]) if x is df else F.lit(None).cast(x.drop(*keys).schema) for x in (left, right)]
        return df.where(known).select(F.struct(*keys).alias("key"), F.col(s).cast("double").alias("s"), F.col(e).cast("double").alias("e"), F.lit(number).alias("side"), own[0].alias("l"), own[1].alias("r"))

    both = side(left, 0, start, end).unionByName(side(right, 1, start + "_r", end + "_r")).withColumn("tie", F.monotonically_increasing_id())
    order = ["key", "s", "tie"]
    rows = keep(keep(both, "intervals").repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "ranges")
    # Where each range and the next one begin: as many rows as ranges.  A key that
    # goes on in a range is the first one there.
    begins = rows.groupBy("part").agg(F.min(F.struct(*order)).alias("at")).select(F.col("part").alias("_part"), F.col("at.key").alias("key"), F.col("at.s").alias("_from"))
    begins = keep(begins.withColumn("_next", F.lead(F.struct("key", "_from")).over(Window.orderBy("_part"))), "begins")
    after = F.broadcast(begins.select(F.col("_part").alias("part"), "_next"))
    crossing = rows.join(after, "part").where((F.col("_next.key") == F.col("key")) & (F.col("_next._from") < F.col("e"))).drop("_next")
    crossing = crossing.join(F.broadcast(begins.drop("_next")), "key").where((F.col("_part") > F.col("part")) & (F.col("_from") < F.col("e")))
    carried = crossing.withColumn("part", F.col("_part")).drop("_part", "_from").select(*rows.columns)
    rows = rows.withColumn("carried", F.lit(False)).unionByName(carried.withColumn("carried", F.lit(True)))
    names = [*[c for c in left.columns if c not in keys], *[c for c in right.columns if c not in keys]]
    fields = [*[f for f in left.schema if f.name in keys], *[f for f in left.schema if f.name not in keys], *[f for f in right.schema if f.name not in keys]]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    own = rows.repartitionById(n, F.col("part")).sortWithinPartitions("part", *order)
    pairs = own.mapInArrow(_sweep([f.name for f in fields if f.name in keys], names), schema)
    return pairs.select(*left.columns, *[c for c in right.columns if c not in keys])


def covered(key: np.ndarray, s: np.ndarray, e: np.ndarray, side: np.ndarray, carried: np.ndarray):
    """(intervals, first, last): for each interval of rows sorted by key, start
    and order, the places, among the starts of the other side that aren't
    carried, of those after it that it covers."""
    times, rank = np.unique(s, return_inverse=True)
    place = key * (len(times) + 1) + rank
    stop = key * (len(times) + 1) + np.searchsorted(times, e)
    for own in (0, 1):
        other = np.flatnonzero((side != own) & ~carried)
        mine = np.flatnonzero(side == own)
        first = np.searchsorted(other, mine)  # those that come later in order
        last = np.searchsorted(place[other], stop[mine])
        some = last > first
        yield own, mine[some], other, first[some], last[some]


def _sweep(keys: list[str], names: list[str]):
    def pairs(table: pa.Table):
        table = table.combine_chunks()
        key = np.zeros(table.num_rows, np.int64)
        columns = table.column("key").combine_chunks()
        for field in columns.flatten():
            new = np.zeros(table.num_rows, bool)
            codes = np.asarray(field.dictionary_encode().indices)
            new[1:] = codes[1:] != codes[:-1]
            key += np.cumsum(new)  # rows are sorted by key: it changes where one of its parts does
        s, e, side, carried = (np.asarray(table.column(c)) for c in ("s", "e", "side", "carried"))
        left, right = table.column("l").combine_chunks().flatten(), table.column("r").combine_chunks().flatten()
        for own, mine, other, first, last in covered(key, s, e, side, carried):
            upto = np.cumsum(last - first)
            for a in range(0, int(upto[-1]) if len(upto) else 0, PAIRS):
                n = np.arange(a, min(a + PAIRS, int(upto[-1])))
                at = np.searchsorted(upto, n, "right")
                one, two = mine[at], other[last[at] - (upto[at] - n)]
                l, r = (pa.array(x) for x in ((one, two) if own == 0 else (two, one)))
                yield pa.RecordBatch.from_arrays([*[x.take(l) for x in columns.flatten()], *[x.take(l) for x in left], *[x.take(r) for x in right]], [*keys, *names])

    def run(batches):
        at, own = None, []
        for batch in batches:
            part = np.asarray(batch.column("part"))
            bounds = np.flatnonzero(np.append(True, np.diff(part) != 0)) if len(part) else []
            for a, b in zip(bounds, [*bounds[1:], len(part)]):
                if own and part[a] != at:
                    yield from pairs(pa.Table.from_batches(own))
                    own = []
                at = part[a]
                own.append(batch.slice(a, b - a))
        if own:
            yield from pairs(pa.Table.from_batches(own))

    return run
