"""N-gram Jaccard join in metric space: exact links, one component a document.

Documents are sets of distinct word shingles; two link when their Jaccard
distance, a metric, is at most tau.  Callers give the least similarity
``near`` = 100 (1 - tau) in per cent, 67 to 99, and the words of a shingle; the
numbers below are those of the defaults, 90 and 3.

Regions.  Distances between whole documents crowd near 1, so Voronoi regions
around pivot documents would have windows (2 tau) that admit nearly every
document to every region.  Regions are therefore made in projections of the
space: shingles are dealt by hash into m classes, and the Jaccard distance of
two sets within a class is a metric again.  Linked sets differ in at most
``(size - 1) // 9`` shingles, so with more classes than that they agree wholly
in one: there, each projected set is the pivot of its own region, at distance
0, and a link always lies inside a region.  m depends on the size of a set; the
triangle inequality with the empty set (sizes of linked sets are within 9 / 10)
gives the window in which a document is also put into the regions of the next
smaller sizes.  Sets of fewer than ``SMALL`` shingles, or with unusually many
empty classes, use as pivots their first shingles in hash order: linked sets
share one among the first ``n - ceil(0.9 n) + 1``.

Recursion.  In each region the member that shares most regions with others is
the pivot.  Every set's distance to its best pivot is computed; those within
tau are linked, which joins their regions without comparing their members with
each other.  Regions whose members all hang together are done.  Of the others,
those of more than ``LARGE`` members are divided: ``PIVOTS`` of their members are
pivots of Voronoi regions, every member belongs to the region of the nearest
one, and is also put into each region whose pivot is at most 2 tau farther (the
triangle inequality: a linked set may belong there).  Regions that are still
large, and at most ``SHRINK`` of the one they come from, are divided again, up to
``LEVELS`` times.  In what remains, the members outside the largest group are held
against all members, in blocks of bounded size dealt over tasks, by a few bits a
class: two sets differ in at least as many shingles as classes have different
bits.  Members with a partner that this, the sizes and the triangle inequality,
by distances to a common pivot, leave open meet again, with their texts, and are
measured exactly; what a link has joined is not compared again, so a block
returns a spanning forest and not its pairs.  Components of the links are found
by alternating large and small stars; no group is ever collected.

Equal sets are one node (64-bit digest), so exact copies take part once.  Tables
of (key, row) meet by ``split_join``: frequent keys on the map side.

Edge cases: null and empty texts have no shingles and are alone; texts of fewer
words than a shingle are one shingle of all their words; rows that repeat a
doc_id, or have none, are nodes by their sets (a component without any doc_id has
none); very long texts are read in pieces and compared as whole sets; an empty
table gives an empty result; other columns, whatever their names, are ignored by
``near_components`` and kept by ``deduplicate``.
"""

from __future__ import annotations

import bisect
import math
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_bytes, frequent, keep_ids, keep_one, map_arrow, mix, read_documents, release, repeated, row_steps, small, split_join, stash, text_or_empty, tidy, word_rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS, NEAR, SMALL = 3, 90, 64

#: Members of a region that meet in one block: the ones to place, all others;
#: and their weight, shingles or eighths of the text's bytes.
BLOCK, AGAINST, WEIGHT = 256, 1024, 1 << 20

#: Members from which a region is divided, its pivots, how much smaller than its
#: own a region must be to be divided again, and how often.
LARGE, PIVOTS, SHRINK, LEVELS = 2048, 8, 0.8, 4

#: Sets that are measured against a pivot in one task.
AROUND = 256

#: A byte of a view holds four bits each of two classes, into which the shingles
#: of a class of the regions are dealt: the finer, the closer the number of
#: classes that differ comes to the number of shingles that differ.
_NIBBLES = np.array([(x & 15 > 0) + (x >> 4 > 0) for x in range(256)], np.uint8)


# ------------------------------------------------------------------- sets
def shingle_sets(hashes: np.ndarray, first: np.ndarray, words: int = WORDS):
    """The sorted distinct shingle hashes of every row, from its words' hashes."""
    n = len(hashes)
    both = np.zeros(max(0, n - words + 1), np.uint64)
    for i in range(words):
        both = mix(both + hashes[i : n - words + 1 + i] * np.uint64(2 * i + 3))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            yield np.unique(both[a : b - words + 1])
        elif b > a:
            x = np.zeros(1, np.uint64)
            for i in range(a, b):
                x = mix(x + hashes[i : i + 1] * np.uint64(2 * (i - a) + 3) + np.uint64(1))
            yield x
        else:
            yield hashes[:0]


def text_sets(column, words: int):
    """(i, j, sets of rows i to j - 1), some rows at a time."""
    for i, j, hashes, first in word_rows(column):
        yield i, j, list(shingle_sets(hashes, first, words))


def node(u: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(u.tobytes()) - (1 << 63)


def linked(common: np.ndarray, a: np.ndarray, b: np.ndarray, near: int = NEAR) -> np.ndarray:
    return 100 * common >= near * (a + b - common)


def least_size(near: int) -> int:
    """The smallest set that another one can be near to."""
    return -(-near // (100 - near))


def schemes(near: int = NEAR, most: int = 1 << 40) -> list[tuple[int, int, int, int]]:
    """For sizes from SMALL: (least size, size beyond, classes, empty classes
    that a set may have).  A few spare classes make up for those; sets with more
    of them have other regions, so any number is right."""
    if not 67 <= near <= 99:  # linked sets are of the same or the next sizes
        raise ValueError(f"near: {near}")
    out, low = [], SMALL
    while low < most:
        high = low * 3 // 2
        differ = (100 - near) * (high - 1) // near
        spare = 0
        while True:
            m = differ + 1 + spare
            empty = m * math.exp(-low / m)
            spread = math.sqrt(empty * (1 - (1 + low / m) * math.exp(-low / m)))
            need = math.ceil(empty + 4 * spread + 1)
            if spare >= need or m > low:
                break
            spare = need
        out.append((low, high, m, spare))
        low = high
    return out


#: The low bits of a region name its scheme; ``FEW`` is that of small sets.
CODE, FEW = 6, 63


def _named(hashes: np.ndarray, code: int) -> np.ndarray:
    return (hashes >> np.uint64(CODE) << np.uint64(CODE)) | np.uint64(code)


def _first(order: np.ndarray, code: int, near: int) -> np.ndarray:
    n = len(order)
    return _named(mix(np.sort(order)[: n - -(-near * n // 100) + 1] + np.uint64(code + 1)), code)


def _classes(order: np.ndarray, m: int) -> tuple[np.ndarray, bytes]:
    """Sums of the shingles of each of m classes, and of 2 m classes four bits
    each, as m bytes."""
    cls = (order >> np.uint64(33)).astype(np.int64) % (2 * m)
    fine = np.zeros(2 * m, np.uint64)
    np.add.at(fine, cls, order)
    bits = (mix(fine) >> np.uint64(60)).astype(np.uint8)
    return fine[:m] + fine[m:], (bits[:m] | bits[m:] << 4).tobytes()


def regions(u: np.ndarray, near: int = NEAR, known: list | None = None) -> tuple[np.ndarray, list[tuple[int, bytes]]]:
    """The regions of a set, and (scheme, bits of each class).  Linked sets
    that differ share a region.  ``known``: ``schemes(near)``."""
    n, known = len(u), known or schemes(near)
    if n < least_size(near):  # no other set is near enough
        return u[:0], []
    out, views = [], []
    order = mix(u * np.uint64(0x9E3779B97F4A7C15) + np.uint64(77))
    if near * n <= 100 * (SMALL - 1):
        out.append(_first(order, FEW, near))
        views.append((FEW, _classes(order, SMALL)[1]))
    if n >= SMALL:
        own = bisect.bisect_right(known, n, key=lambda x: x[1])
        for k in (own, own - 1):
            if k < 0 or (k < own and near * n > 100 * (known[k][1] - 1)):
                continue
            _, _, m, spare = known[k]
            sums, view = _classes(order, m)
            full = np.flatnonzero(sums)
            out.append(_named(mix(sums[full] + mix((full + (k << 40) + 2).astype(np.uint64))), k))
            if m - len(full) > spare:
                out.append(_first(order, k, near))
            views.append((k, view))
    return np.concatenate(out), views


NODES = "doc_id long, k long, c long, n long, regions binary, views array<struct<code:int,view:binary>>"


def _nodes(words: int, near: int):
    known = schemes(near)

    def rows(batch):
        for i, j, sets in text_sets(batch.column("text"), words):
            both = [regions(u, near, known) for u in sets]
            flat = [x for _, views in both for x in views]
            bounds = pa.array(np.concatenate([[0], np.cumsum([len(x[1]) for x in both])]).astype(np.int32))
            views = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.binary())], ["code", "view"])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c)[i:j] for c in ("doc_id", "k")], pa.array([node(u) for u in sets], pa.int64()), pa.array([len(u) for u in sets], pa.int64()), pa.array([x[0].tobytes() for x in both], pa.binary()), pa.ListArray.from_arrays(bounds, views)],
                ["doc_id", "k", "c", "n", "regions", "views"],
            )

    return rows


_MEMBER = np.dtype([("region", np.int64), ("c", np.int64)])


def _members(batch):
    """(region, c) of each region of each set."""
    data, offs = arrow_bytes(batch.column("regions"))
    c = np.asarray(batch.column("c"))
    for i, j in row_steps(offs, 1 << 22):
        out = np.empty((offs[j] - offs[i]) // 8, _MEMBER)
        out["region"] = np.frombuffer(data[offs[i] : offs[j]].tobytes(), np.int64)
        out["c"] = np.repeat(c[i:j], np.diff(offs[i : j + 1]) // 8)
        yield out


def sets_of(texts, words: int) -> list[np.ndarray]:
    column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    return [u for _, _, sets in text_sets(column, words) for u in sets]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many members two sorted sets have in common."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def distances(rows: list[tuple], words: int, near: int) -> pa.RecordBatch:
    """c, hub, link and far (distance) of sets (cell, hub, c, text) around a
    pivot, whose own rows come first."""
    sets = sets_of([x[3] for x in rows], words)
    out = []
    for x, u in zip(rows, sets):
        if x[2] == x[1]:
            pivot = u
            continue
        common = overlap(u, pivot)
        out.append((x[2], x[1], bool(linked(common, len(u), len(pivot), near)), 1 - common / max(1, len(u) + len(pivot) - common)))
    types = (pa.int64(), pa.int64(), pa.bool_(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], ["c", "hub", "link", "far"])


# ------------------------------------------------------------------- links
def links(texts: DataFrame, nodes: DataFrame, words: int = WORDS, near: int = NEAR) -> DataFrame:
    """Links (u, v) that connect what is linked: nodes of a component, not all
    pairs.  ``texts``: doc_id, k, text; ``nodes``: stashed, see ``NODES``, and
    deleted when its regions and views are no longer needed."""
    members = stash(repeated(nodes.select("c", "regions"), _members, [("region", "long"), ("c", "long")], "c").distinct(), "members", True)
    crowd = stash(members.groupBy("c").agg(F.count(F.lit(1)).alias("score")), "crowd", True)
    # One row of the table stands for each set that isn't alone in all its regions.
    first = nodes.join(crowd, "c", "left_semi").groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k")).alias("r"), F.first("n").alias("n"))
    views = keep_ids(nodes.select("c", "views"), crowd.select("c"), "c").dropDuplicates(["c"])
    views = stash(views.select("c", F.explode("views").alias("v")).select("c", "v.code", "v.view"), "views", True)
    ids = stash(first.select(F.col("r.doc_id").alias("_d"), F.col("r.k").alias("_k"), "c", "n"), "set_ids", True)
    weight = F.greatest(F.col("n"), F.floor(F.octet_length("text") / 8)).alias("w")
    sets = texts.join(small(ids), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("k") == F.col("_k")))
    sets = stash(sets.select("c", "n", weight, "text"), "sets")
    release(nodes)
    names = frequent(members, "region")
    # The best pivot of each set: the one that is in most regions with others.
    pivots = members.join(small(crowd), "c").groupBy("region").agg(F.max(F.struct("score", "c")).alias("pivot"))
    best = split_join(members, pivots, "region", names=names).where("pivot.c != c").groupBy("c").agg(F.max("pivot").alias("pivot"))
    star = stash(best.join(crowd, "c").where(F.col("pivot") > F.struct("score", "c")).select("c", F.col("pivot.c").alias("hub")), "star", True)
    measured = measure(star, sets, words, near)
    release(ids, star)
    found = measured.where("link").select("c", "hub")
    up = found.select(F.col("c").alias("hub"), F.col("hub").alias("top"))
    label = found.join(up, "hub", "left").select("c", F.coalesce("top", "hub").alias("label"))
    known = sets.select("c", "n", "w").distinct().join(label, "c", "left").join(measured.select("c", "hub", "far"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    labelled = stash(members.join(known, "c"), "labelled", True)
    release(members, crowd)
    out = found.select(F.col("c").alias("u"), F.col("hub").alias("v")).unionByName(_within(views, sets, labelled, names, words, near))
    out = stash(out.distinct(), "links", True)
    release(sets, labelled, measured, views)
    return out


def measure(pairs: DataFrame, sets: DataFrame, words: int, near: int) -> DataFrame:
    """c, hub, link and far (distance) of pairs (c, hub), stashed.  The sets around
    a pivot meet it in parts of bounded size, so a text travels once, and that of
    a pivot once a part."""
    sizes = pairs.join(sets.select("c", "w"), "c").groupBy("hub").agg(F.count(F.lit(1)).alias("k"), F.sum("w").alias("w"))
    parts = F.greatest(F.ceil(F.col("k") / AROUND), F.ceil(F.col("w") / WEIGHT)).cast("int").alias("parts")
    sizes = stash(sizes.select("hub", parts), "pivots", True)
    cell = F.xxhash64("hub", F.col("part")).alias("cell")
    around = split_join(pairs, sizes, "hub").withColumn("part", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))
    around = stash(around.select(cell, "hub", "c"), "around", True)
    pivots = sizes.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(cell, "hub", F.col("hub").alias("c"))
    pivots = stash(pivots, "pivot_parts", True)
    rows = sets.select("c", "text").join(small(pivots), "c").unionByName(sets.select("c", "text").join(small(around), "c"))
    rows = rows.select("cell", "hub", "c", "text").repartition(F.col("cell")).sortWithinPartitions("cell", F.desc(F.col("c") == F.col("hub")), "c")
    out = stash(rows.mapInArrow(tidy(_by_block(lambda x: distances(x, words, near))), "c long, hub long, link boolean, far double").distinct(), "measured", True)
    release(sizes, around, pivots)
    return out


CELL = ["region", "code", "c", "n", "w", "label", "hub", "far", "mine", "was"]


def _within(views: DataFrame, sets: DataFrame, members: DataFrame, names: DataFrame, words: int, near: int) -> DataFrame:
    """Links inside regions whose members don't yet hang together.  ``members``:
    region, c, n, w, label, hub, far, stashed; ``names``: its frequent regions."""
    groups = members.groupBy("region").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("all"), F.sum(F.xxhash64("c").cast("decimal(38,0)")).alias("print")
    )
    # Regions with the same members are one.
    groups = groups.where("low != high").groupBy("all", "print").agg(F.min("region").alias("region")).select("region")
    code = F.expr(f"cast(region & {(1 << CODE) - 1} as int)").alias("code")
    open_ = stash(split_join(members, groups, "region", names=names), "open", True)
    counts = open_.groupBy("region", "label").agg(F.count(F.lit(1)).alias("k"))
    main = counts.groupBy("region").agg(F.max(F.struct("k", "label")).alias("main"))
    cells = split_join(open_, main, "region", names=names)
    cells = cells.select("region", code, "c", "n", "w", "label", "hub", "far", (F.col("label") != F.col("main.label")).alias("mine"), F.lit(1 << 60).alias("was"))
    cells, found = divide(stash(cells, "cells", True), sets, words, near)
    release(open_)
    by_region = cells.groupBy("region").agg(
        F.count(F.lit(1)).alias("all"), F.count_if("mine").alias("rest"), F.sum("w").alias("all_w"), F.sum(F.when(F.col("mine"), F.col("w")).otherwise(0)).alias("rest_w")
    )
    r, f = (F.greatest(F.ceil(F.col(a) / x), F.ceil(F.col(a + "_w") / WEIGHT)).cast("int").alias(name) for a, x, name in (("rest", BLOCK, "_r"), ("all", AGAINST, "_f")))
    rows = split_join(cells, by_region.where("rest > 0").select("region", r, f), "region")
    place, keep = F.pmod(F.xxhash64("c", F.lit(1)), F.col("_r")).cast("int"), ["region", "code", "c", "n", "label", "hub", "far"]
    theirs = F.pmod(F.xxhash64("c", F.lit(2)), F.col("_f")).cast("int")
    mine = rows.where("mine").select(*keep, place.alias("r"), F.explode(F.sequence(F.lit(0), F.col("_f") - 1)).alias("f"), F.lit(True).alias("mine"))
    other = rows.select(*keep, F.explode(F.sequence(F.lit(0), F.col("_r") - 1)).alias("r"), theirs.alias("f"), F.lit(False).alias("mine"))
    blocks = stash(mine.unionByName(other).select(F.xxhash64("region", "r", "f").alias("block"), *keep[1:], "mine"), "blocks")
    rows = blocks.join(views, ["c", "code"]).repartition(F.col("block")).sortWithinPartitions("block", "c")
    open_ = stash(rows.select("block", "c", "n", "label", "hub", "far", "mine", "view").mapInArrow(tidy(_by_block(lambda x: open_members(x, near))), OPEN), "open_members")
    release(blocks, cells)
    # Most pairs are open in many regions: of blocks with the same open members one stays.
    marks = open_.groupBy("block").agg(F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("c", "mine").cast("decimal(38,0)")).alias("print"))
    some = stash(open_.join(marks.groupBy("size", "print").agg(F.min("block").alias("block")).select("block"), "block"), "open_blocks", True)
    rows = sets.select("c", "text").join(small(some), "c").repartition(F.col("block")).sortWithinPartitions("block", "c")
    forests = rows.select("block", "c", "label", "mine", "text").mapInArrow(tidy(_by_block(lambda x: forest(x, words, near))), "u long, v long")
    out = stash(forests.unionByName(found).distinct(), "within", True)
    release(open_, some)
    return out


# ------------------------------------------------------------ Voronoi regions
REGION = "region long, code int, c long, n long, w long, label long, hub long, far double, mine boolean, was long, pivot long"


def divide(cells: DataFrame, sets: DataFrame, words: int, near: int) -> tuple[DataFrame, DataFrame]:
    """Divide large regions by pivots, again and again: the regions that are
    left, stashed, and links (u, v) of members to pivots.  ``cells``: ``CELL``,
    stashed; ``mine`` marks the members that must meet all members."""
    spark = cells.sparkSession
    found = spark.createDataFrame([], "u long, v long")
    for level in range(LEVELS):
        sizes = cells.groupBy("region").agg(F.count(F.lit(1)).alias("all"), F.sum("w").alias("all_w"), F.count_if("mine").alias("rest"), F.max("was").alias("was"), F.min("label").alias("low"), F.max("label").alias("high"))
        large = stash(sizes.where((F.col("all") > LARGE) & (F.col("rest") > 0) & (F.col("low") != F.col("high")) & (F.col("all") <= SHRINK * F.col("was"))).select("region", "all", "all_w"), "large", True)
        if not large.limit(1).count():
            release(large)
            break
        rows = stash(split_join(cells, large, "region"), "large_rows")
        slot = F.pmod(F.xxhash64("c", F.lit(level + 3)), F.lit(PIVOTS)).cast("int").alias("slot")
        chosen = rows.groupBy("region", slot).agg(F.min(F.struct(F.xxhash64("c", F.lit(level + 7)), "c", "label", "all", "all_w")).alias("p"))
        deals = F.greatest(F.ceil(F.col("all") / AGAINST), F.ceil(F.col("all_w") / WEIGHT)).cast("int")
        pivots = chosen.select("region", "slot", "p.c", "p.label", "p.all", "p.all_w")
        pivots = pivots.join(sets.select("c", "text"), "c").withColumn("deal", F.explode(F.sequence(F.lit(0), deals - 1)))
        members = rows.join(sets.select("c", "text"), "c").withColumn("deal", F.pmod(F.xxhash64("c", F.lit(9)), deals).cast("int"))
        both = members.withColumn("slot", F.lit(-1)).unionByName(pivots, allowMissingColumns=True)
        both = both.select(F.xxhash64("region", "deal").alias("cell"), *CELL[:-1], F.col("all").alias("was"), "slot", "text")
        both = both.repartition(F.col("cell")).sortWithinPartitions("cell", F.col("slot").desc(), "c")
        new = stash(both.mapInArrow(tidy(_by_block(lambda x, level=level: nearest(x, words, near, level))), REGION), "voronoi")
        found = stash(found.unionByName(new.where("pivot is not null").select(F.col("c").alias("u"), F.col("pivot").alias("v"))).distinct(), "pivot_links", True)
        rest = split_join(cells, large.select("region", F.lit(True).alias("_large")), "region", "left").where("_large is null")
        cells = stash(rest.select(*CELL).unionByName(new.select(*CELL)), "cells", True)
        release(large, rows, new)
    return cells, found


def nearest(rows: list[tuple], words: int, near: int, level: int) -> pa.RecordBatch:
    """Members of a region, (cell, ``CELL``, slot, text), after its pivots (slot
    >= 0): each is in the region of its nearest pivot, and, without having to meet
    all members, in each whose pivot is at most 2 tau farther."""
    all_sets = sets_of([x[12] for x in rows], words)
    pivots = {}
    for x, u in zip(rows, all_sets):
        if x[11] >= 0:
            pivots.setdefault(x[3], (x, u))
    sets = [u for _, u in pivots.values()]
    pivots = [x for x, _ in pivots.values()]
    size = np.array([len(u) for u in sets])
    tau, out = 1 - near / 100, []
    for x, u in zip(rows, all_sets):
        if x[11] >= 0:
            continue
        common = np.array([overlap(u, v) for v in sets])
        far = 1 - common / np.maximum(1, len(u) + size - common)
        own = int(far.argmin())
        close = bool(linked(common[own], len(u), size[own], near)) and pivots[own][3] != x[3]
        label = pivots[own][6] if close else x[6]
        for j in np.flatnonzero(far <= far[own] + 2 * tau + 1e-9).tolist():
            name = xxhash.xxh3_64_intdigest(f"{x[1]}:{level}:{pivots[j][11]}".encode()) - (1 << 63)
            out.append((name, *x[2:6], label, pivots[j][3], float(far[j]), x[9] and j == own, x[10], pivots[own][3] if close and j == own else None))
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], [*CELL, "pivot"])


OPEN = "block long, c long, label long, mine boolean"


def _by_block(fn):
    """Apply a function to the rows of each block; batches are sorted by block."""

    def run(batches):
        pending: list[tuple] = []
        for batch in batches:
            for row in zip(*[x.to_pylist() for x in batch.columns]):
                if pending and row[0] != pending[-1][0]:
                    yield fn(pending)
                    pending = []
                pending.append(row)
        if pending:
            yield fn(pending)

    return run


def open_members(rows: list[tuple], near: int = NEAR) -> pa.RecordBatch:
    """The rows of a block (see ``OPEN``) with a partner that may be linked."""
    others = [x for x in rows if not x[6]]
    keep: set[int] = set()
    mine_kept = []
    if others:
        n, label = np.array([x[2] for x in others]), np.array([x[3] for x in others])
        hub = np.array([x[1] if x[4] is None else x[4] for x in others])
        far = np.array([x[5] if x[5] is not None else 0.0 for x in others])
        views = np.frombuffer(b"".join([x[7] for x in others]), np.uint8).reshape(len(others), -1)
        for x in rows:
            _, own, size, own_label, own_hub, own_far, mine, view = x
            if not mine:
                continue
            open_ = (label != own_label) & (100 * np.minimum(size, n) >= near * np.maximum(size, n))
            # Triangle inequality: linked sets have distances to a common pivot within tau.
            open_ &= (hub != (own if own_hub is None else own_hub)) | (np.abs(far - (own_far or 0.0)) <= 1 - near / 100 + 1e-9)
            at = np.flatnonzero(open_)
            if not len(at):
                continue
            differ = _NIBBLES[views[at] ^ np.frombuffer(view, np.uint8)].sum(1, dtype=np.int64)
            at = at[(100 + near) * differ <= (100 - near) * (size + n[at])]
            if len(at):
                mine_kept.append(x)
                keep.update(at.tolist())
    kept = mine_kept + [others[i] for i in sorted(keep)]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in kept], v) for i, v in zip((0, 1, 3, 6), types)], ["block", "c", "label", "mine"])


def forest(rows: list[tuple], words: int = WORDS, near: int = NEAR) -> pa.RecordBatch:
    """Links between members of a block (block, c, label, mine, text) that join
    what is not joined yet."""
    sets = sets_of([x[4] for x in rows], words)
    others, mine = [i for i, x in enumerate(rows) if not x[3]], [i for i, x in enumerate(rows) if x[3]]
    found = []
    if others and mine:
        size = np.array([len(sets[i]) for i in others])
        names, cells = np.unique(np.concatenate([sets[i] for i in others]), return_inverse=True)
        offs = np.concatenate([[0], np.cumsum(size)])[:-1]
        labels, at = np.unique([x[2] for x in rows], return_inverse=True)
        joined = np.arange(len(labels))  # the group that each label is in now
        other_at = at[others]
        has = np.zeros(len(names), np.int64)
        for i in mine:
            u = sets[i]
            group = joined[other_at]
            if (group == joined[at[i]]).all():
                continue
            where = np.minimum(np.searchsorted(names, u), len(names) - 1)
            where = where[names[where] == u]
            has[where] = 1
            common = np.add.reduceat(has[cells], offs)
            has[where] = 0
            good = np.flatnonzero(linked(common, len(u), size, near) & (group != joined[at[i]]))
            for j in good.tolist():
                if joined[other_at[j]] != joined[at[i]]:
                    found.append((rows[i][1], rows[others[j]][1]))
                    joined[joined == joined[other_at[j]]] = joined[at[i]]
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(2)], ["u", "v"])


# -------------------------------------------------------------- components
def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(u, root) of every node of the edges (u, v); root: the least node of the
    component.  Alternating large and small stars, each a map-side combined
    minimum and a join, until nothing changes."""
    e = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = stash(e, "edges", True)
    last = None
    for _ in range(most):
        before, both = e, e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        small_star = e.join(low, "u")
        e = small_star.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        e = stash(e, "edges", True)
        release(before)
        state = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == last:
            return e.select("u", F.col("v").alias("root"))
        last = state
    raise RuntimeError("components did not settle")


def _grouped(docs: DataFrame, words: int, near: int) -> DataFrame:
    """doc_id, k (the text's hash), n and, of rows with shingles, component_id
    and the first row of the component (first.doc_id, first.k)."""
    texts = docs.select("doc_id", text_or_empty().alias("text")).select("doc_id", F.xxhash64("text").alias("k"), "text")
    nodes = stash(map_arrow(texts, _nodes(words, near), NODES), "nodes")
    ids = stash(nodes.select("doc_id", "k", "c", "n"), "nodes", True)
    roots = components(links(texts, nodes, words, near)).withColumnRenamed("u", "c")
    rows = split_join(ids, roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    rows = stash(rows.select("doc_id", "k", "n", "root"), "rooted", True)
    release(ids)
    some = rows.where("n > 0")
    least = some.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k")).alias("first"))
    none = rows.where("n = 0").withColumn("component_id", F.col("doc_id"))
    return split_join(some, least, "root").unionByName(none, allowMissingColumns=True)


def near_components(docs: DataFrame, words: int = WORDS, near: int = NEAR) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    return _grouped(docs, words, near).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def deduplicate(docs: DataFrame, words: int = WORDS, near: int = NEAR) -> DataFrame:
    """One row of each component: the one with the least doc_id (rows without
    one come last).  Rows are told apart by doc_id and text together; texts without
    words all stay."""
    kept = F.col("first").isNull() | (F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.k") == F.col("k")))
    rows = _grouped(docs, words, near).withColumn("kept", kept)
    rows = rows.groupBy("doc_id", F.col("k").alias("key")).agg(F.first("kept").alias("kept"), F.sum(F.when(F.col("first").isNull(), 0).otherwise(1)).alias("n"))
    return keep_one(docs, F.xxhash64(text_or_empty()), stash(rows.where("not kept or n > 1"), "copies", True))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(read_documents(spark, sf_dir))


#: Shingles as text, joined with each other; every document reaches the others of its component.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                                           ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS g
  FROM w
), n AS (
  SELECT doc_id, count(g) AS n FROM documents LEFT JOIN s USING (doc_id) GROUP BY doc_id
), e AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 90 * (p.n + q.n - count(*))
), r(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id
)
SELECT r.doc_id, any_value(n.n) AS n_shingles, min(root) AS component_id FROM r JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
