"""Suffix-array deduplication of repeated byte strings, over all documents.

A window is a string of ``LENGTH`` bytes.  Windows that repeat are found in
three steps, each exact, none of which collects a corpus-sized group:

1. Anchors.  The anchor of a window is its smallest ``GRAM``-byte gram (by
   hash, leftmost of equal ones), so equal windows have equal anchors at equal
   distances.  Consecutive windows with one anchor form a run, one row for
   about 85 bytes.  Anchors that occur once are dropped: nothing repeats there.
   A context (below) that a text holds more than ``OFTEN`` times, as texts of one
   letter do, repeats: what it covers is one span, and two runs stand for it.
2. Runs whose bytes agree altogether (their context) are counted with map-side
   combining; all windows of a context that occurs twice repeat.
3. Contexts that share an anchor and differ meet in one task, in chunks of
   whole anchors.  Their bytes are concatenated in document order and sorted
   into a suffix array (prefix doubling, up to LENGTH bytes).  Previous and next
   smaller positions in suffix order give each window's longest previous
   factor; the mirrored arrays give its longest later one.  An anchor with more
   than ``MOST`` contexts (a passage that very many documents share) would make
   a task grow with the corpus.  Its windows are counted instead, by 128-bit
   digests with map-side combining, in blocks of ``BLOCKS`` distances to the
   anchor: a block repeats as a whole, or cannot repeat because the bytes that
   all its windows share don't, or is cut into smaller blocks.  Both ways give
   the same spans; ``MOST`` bounds a task and decides nothing else.

Copies of whole texts are set apart first by SHA-256; one of each goes on.
Tables of (key, row) meet by ``split_join``: frequent keys on the map side.

``repeats(..., keep_first=True)`` removes only later copies: an occurrence
that has no earlier one, in order of doc_id and position, stays.

Edge cases: null text is empty; texts shorter than LENGTH lose bytes never;
matches don't cross documents; rows that repeat a doc_id or a text are
documents of their own (equal rows are copies of each other); null doc_ids come
first in order; texts of over ``SEGMENT`` bytes are searched in pieces that
overlap by a window, with the same result; an empty table gives an empty result;
other columns, whatever their names, are ignored.  Bytes are UTF-8; a removed
run may cut a character.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import STEP, arrow_bytes, drop_ids, gram_hashes, keep_ids, map_arrow, partitions, read_documents, release, repeated, row_steps, sliding_min, split_join, stash, text_or_empty, tidy

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH, GRAM = 200, 24

#: Contexts of an anchor that meet in one task at most; times that a text may
#: hold a context before it is known to repeat.
MOST, OFTEN = 512, 16

#: Windows in a block, level by level.
BLOCKS = (16, 4, 1)

#: Bytes of contexts that one suffix array covers (or one anchor's).
CHUNK = 1 << 19

#: Bytes of a row that are searched at a time; positions must fit 24 bits.
SEGMENT = 1 << 22


def anchors(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of windows with one anchor: the anchor's hash, the first window,
    its distance to the anchor, the number of windows, the row."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none.astype(np.uint64), none, none, none, none
    at = np.arange(n - gram + 1)
    hashes = gram_hashes(data, gram)
    keys = hashes & np.uint64(0xFFFFFFFFFF000000) | at.astype(np.uint64)
    low = (sliding_min(keys, length - gram + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
    whole = np.diff(offs) >= length
    inside = np.zeros(len(low) + 1, np.int64)  # windows that no row's end cuts
    np.add.at(inside, offs[:-1][whole], 1)
    np.add.at(inside, offs[1:][whole] - length + 1, -1)
    valid = np.cumsum(inside[:-1]) > 0
    first = valid.copy()
    first[1:] &= (low[1:] != low[:-1]) | ~valid[:-1]
    first[offs[:-1][whole]] = True
    start = np.flatnonzero(first)
    stop = np.flatnonzero(valid & np.append(~valid[1:] | first[1:], True)) + 1
    anchor = low[start]
    row = np.searchsorted(offs, start, "right") - 1
    return hashes[anchor], start, anchor - start, stop - start, row


#: A row with rel = -1 is a span that is known to go: n bytes from s on.
RUNS = [("anchor", "long"), ("ctx", "long"), ("d", "long"), ("k", "long"), ("s", "long"), ("rel", "int"), ("n", "int")]
_RUN = np.dtype([(name, {"long": np.int64, "int": np.int32}[kind]) for name, kind in RUNS])


def _runs(length: int, gram: int, keep_first: bool):
    def segments(offs):
        """Pieces (row, first byte, end) of all rows; long rows overlap by length - 1."""
        for r, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
            while b - a > SEGMENT:
                yield r, a, a + SEGMENT
                a += SEGMENT - length + 1
            yield r, a, b

    def rows(batch):
        data, offs = arrow_bytes(batch.column("text"))
        d, k = (np.asarray(batch.column(c)) for c in ("d", "k"))
        parts = list(segments(offs))
        i = 0
        while i < len(parts):
            j, size = i, 0
            while j < len(parts) and (j == i or size + parts[j][2] - parts[j][1] <= STEP):
                size += parts[j][2] - parts[j][1]
                j += 1
            part = np.concatenate([data[a:b] for _, a, b in parts[i:j]])
            cuts = np.concatenate([[0], np.cumsum([b - a for _, a, b in parts[i:j]])]).astype(np.int64)
            hashes, start, rel, n, seg = anchors(part, cuts, length, gram)
            raw = part.tobytes()
            digest = xxhash.xxh3_64_intdigest
            ctx = np.array([digest(raw[a:b]) for a, b in zip(start.tolist(), (start + n + length - 1).tolist())], np.uint64)
            ctx ^= (rel * 4096 + n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            row = np.array([r for r, _, _ in parts[i:j]], np.int64)[seg]
            begin = np.array([a for _, a, _ in parts[i:j]], np.int64)[seg]
            out = np.empty(len(start), _RUN)
            columns = [hashes.view(np.int64), ctx.view(np.int64), d[row], k[row], start - cuts[seg] + begin - offs[row], rel, n]
            for (name, _), values in zip(RUNS, columns):
                out[name] = values
            yield _thinned(out, row, length, keep_first) if 16 * len(start) > len(part) else out
            i = j

    return rows


def _thinned(runs: np.ndarray, row: np.ndarray, length: int, keep_first: bool) -> np.ndarray:
    """The runs without those of contexts that a text holds more than OFTEN
    times; their first two stay, and all that goes is covered by spans (twice
    each, since ``repeated`` returns rows whose key occurs twice)."""
    by = np.lexsort((runs["s"], runs["ctx"], row))
    first = np.flatnonzero(np.append(True, (row[by][1:] != row[by][:-1]) | (runs["ctx"][by][1:] != runs["ctx"][by][:-1])))
    size = np.diff(np.append(first, len(by)))
    often = np.repeat(size > OFTEN, size)
    place = np.arange(len(by)) - np.repeat(first, size)
    gone = by[often & (place >= int(keep_first))]
    gone = gone[np.lexsort((runs["s"][gone], row[gone]))]
    if not len(gone):
        return runs
    a, b = runs["s"][gone], runs["s"][gone] + runs["n"][gone] + length - 1
    # Spans of a text that touch are one; ends rise as starts do, but for the runs' lengths.
    reach = np.maximum.accumulate(b + row[gone] * (1 << 40)) - row[gone] * (1 << 40)
    start = np.append(True, (row[gone][1:] != row[gone][:-1]) | (a[1:] > reach[:-1]))
    spans = runs[gone][start].copy()
    last = np.append(np.flatnonzero(start)[1:], len(gone)) - 1
    spans["s"], spans["n"], spans["rel"] = a[start], (reach[last] - a[start]).astype(np.int32), -1
    names = [xxhash.xxh3_64_intdigest(x.tobytes()) for x in spans]
    spans["anchor"] = np.array(names, np.uint64).view(np.int64)
    stay = np.ones(len(runs), bool)
    stay[by[often & (place >= 2)]] = False
    return np.concatenate([runs[stay], spans, spans])


# ------------------------------------------------------------ suffix arrays
def suffix_ranks(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order by the first ``length`` bytes, equal ones by position, and
    each position's rank; positions of equal rank start equal strings.  Past
    the end counts as less than any byte, so only positions with ``length``
    bytes ahead may be compared.  Keys hold the position in their low bits: a
    plain sort of numbers gives the order."""
    n = len(data)
    bits = max(1, n.bit_length())
    if 3 * bits > 63:
        raise ValueError("a suffix array covers at most 2 MB")
    at = np.arange(n, dtype=np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    have = min(length, (63 - bits) // 9)
    key = np.zeros(n, np.uint64)
    for i in range(have):
        key = key * np.uint64(257) + padded[i : i + n] + (at + np.uint64(i) < np.uint64(n))
    while True:
        key = np.sort(key << np.uint64(bits) | at)
        order = (key & np.uint64((1 << bits) - 1)).astype(np.int64)
        key >>= np.uint64(bits)
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.append(False, key[1:] != key[:-1])).astype(np.uint64)
        if have >= length:
            return order, rank.astype(np.int64)
        more = min(have, length - have)
        ahead = np.zeros(n, np.uint64)
        ahead[: max(0, n - more)] = rank[more:] + np.uint64(1)
        key = rank << np.uint64(bits) | ahead
        have += more


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value before each one, or -1; pointers jump
    over what is known to be larger until none moves."""
    at = np.arange(-1, len(values) - 1)
    todo = np.flatnonzero(at >= 0)
    while len(todo):
        todo = todo[values[at[todo]] > values[todo]]
        at[todo] = at[at[todo]]
        todo = todo[at[todo] >= 0]
    return at


def factors(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Whether the longest previous, and the longest later, factor of each
    position reaches ``length`` bytes, counting the marked positions alone."""
    n = len(data)
    order, rank = suffix_ranks(data, length)
    order = order[starts[order]]
    by = rank[order]
    pair = by[1:] == by[:-1]
    order = order[np.append(pair, False) | np.append(False, pair)] if len(order) else order  # others reach nothing
    by, m = rank[order], len(order)

    def reached(position: np.ndarray) -> np.ndarray:
        before = nearest_smaller(position)
        after = m - 1 - nearest_smaller(position[::-1])[::-1]
        hit = (before >= 0) & (by[np.maximum(before, 0)] == by)
        hit |= (after < m) & (by[np.minimum(after, m - 1)] == by)
        out = np.zeros(n, bool)
        out[order] = hit
        return out

    return reached(order), reached(n - order)


SPANS = "d long, k long, a long, b long"


def _resolve(length: int, keep_first: bool):
    """Repeated windows among contexts that share anchors; batches sorted by
    anchor, contexts of an anchor in document order."""

    def chunk(rows):
        out = []
        size = np.array([len(r[6]) for r in rows])
        offs = np.cumsum(size) - size
        edge = np.zeros(size.sum() + 1, np.int64)
        np.add.at(edge, offs, 1)
        np.add.at(edge, offs + np.array([r[5] for r in rows]), -1)
        earlier, later = factors(np.frombuffer(b"".join([r[6] for r in rows]), np.uint8), np.cumsum(edge[:-1]) > 0, length)
        hit = earlier if keep_first else earlier | later
        for (_, times, d, k, s, n, _), o in zip(rows, offs.tolist()):
            if times > 1 and not keep_first:
                continue  # all its windows repeat, which is known
            flags = np.concatenate([[0], hit[o : o + n].view(np.int8), [0]])
            edge = np.flatnonzero(np.diff(flags))
            out += [(d, k, s + a, s + b + length - 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]
        return out

    def run(batches):
        pending, size = [], 0
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("anchor", "times", "d", "k", "s", "n", "bytes")]):
                if size >= CHUNK and row[0] != pending[-1][0]:
                    yield _spans(chunk(pending))
                    pending, size = [], 0
                pending.append(row)
                size += len(row[6])
        if pending:
            yield _spans(chunk(pending))

    return run


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["d", "k", "a", "b"])


# ---------------------------------------------------------------- operators
def repeats(docs: DataFrame, keep_first: bool = False, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Narrow tables: all rows (doc_id, d, k, sha, n_bytes, rows of the same
    text, whether it is the one that goes on) and, of each text, lists (d, k, a,
    b) of the spans to remove, which overlap.  Copied texts as a whole have no spans."""
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("d"), text_or_empty().alias("text"))
    rows = rows.select("doc_id", "d", F.xxhash64("text").alias("k"), "text")
    each = stash(rows.select("doc_id", "d", "k", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes")), "texts", True)
    copies = each.groupBy("sha").agg(F.min("d").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    narrow = stash(split_join(each, stash(copies, "copies", True), "sha", "left"), "narrow", True)
    others = stash(narrow.where("d != first").select("d", "k").distinct(), "others", True)
    texts = rows.where(F.octet_length("text") >= length).select("d", "k", "text")
    runs = stash(repeated(drop_ids(texts, others, ["d", "k"]), _runs(length, gram, keep_first), RUNS), "runs", True)
    release(each, others)
    spans = runs.where("rel < 0").select("d", "k", F.col("s").alias("a"), (F.col("s") + F.col("n")).alias("b")).distinct()
    real = runs.where("rel >= 0")
    contexts = stash(real.groupBy("anchor", "ctx").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("d", "k", "s", "rel", "n")).alias("first")), "contexts", True)
    twice = contexts.where("times > 1").select("anchor", "ctx", F.col("first").alias("_first"))
    known = split_join(real, twice, "ctx", on=["anchor", "ctx"])
    if keep_first:
        known = known.where(F.struct("d", "k", "s", "rel", "n") != F.col("_first"))
    known = stash(known.select("d", "k", F.col("s").alias("a"), (F.col("s") + F.col("n") + (length - 1)).alias("b")).unionByName(spans), "known", True)
    kinds = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    several = split_join(contexts, kinds, "anchor").select("anchor", "times", F.col("first.d").alias("d"), F.col("first.k").alias("k"), F.col("first.s").alias("s"), F.col("first.rel").alias("rel"), F.col("first.n").alias("n"), (F.col("kinds") > MOST).alias("hot"))
    several = stash(several, "several", True)
    release(runs, contexts)
    lists = known.unionByName(_several(texts, several, length, keep_first)).groupBy("d", "k").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    lists = stash(lists, "spans", True)
    release(known, several)
    return narrow, lists


def _several(texts: DataFrame, several: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """Spans of the contexts that share an anchor with others."""
    spark = texts.sparkSession

    def cut(hot: bool) -> DataFrame:
        some = several.where(F.col("hot") == F.lit(hot))
        lists = some.groupBy("d", "k").agg(F.collect_list(F.struct("anchor", "times", "s", "rel", "n")).alias("runs"))
        ids = stash(some.select("d", "k").distinct(), "ids", True)
        return map_arrow(keep_ids(texts, ids, ["d", "k"]).join(lists, ["d", "k"]), _cut(length), "anchor long, times long, d long, k long, s long, rel int, n int, bytes binary")

    cold = cut(False).repartition(partitions(spark), "anchor").sortWithinPartitions("anchor", "d", "k", "s")
    found = cold.mapInArrow(tidy(_resolve(length, keep_first)), SPANS)
    if not several.where("hot").limit(1).count():
        return found
    return found.unionByName(_hot(stash(cut(True), "cut", True), length, keep_first))


def _hot(contexts: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """Spans of contexts whose anchors are too frequent for one task."""
    own = ["d", "k", "s"]
    pending = contexts.withColumn("open", F.array(F.struct((F.col("rel") - F.col("n") + 1).alias("lo"), F.col("rel").alias("hi"))))
    spans = None
    for level in BLOCKS:
        blocks = stash(map_arrow(pending, _blocks(length, level), "core string, whole string, times long, d long, k long, s long, rel int, lo int, hi int"), "blocks", True)
        place = F.struct("d", "k", F.col("s") + F.col("rel") - F.col("hi"))
        cores = blocks.groupBy("core").agg(F.sum("times").alias("in_core"), F.min(place).alias("first")).where("in_core > 1")
        some = stash(split_join(blocks, cores, "core"), "cores", True)
        if level > 1:
            wholes = some.groupBy("whole").agg(F.sum("times").alias("in_whole"), F.min(place).alias("one")).where("in_whole > 1")
            some = stash(split_join(some, wholes, "whole", "left"), "some", True)
            whole = F.coalesce(F.col("in_whole") > 1, F.lit(False)) if not keep_first else F.lit(False)
            done = some.where(whole)
            # One of each such block goes on: others may share a part of it.
            rest = some.where(~whole | (place == F.col("one"))).groupBy(*own).agg(F.collect_list(F.struct("lo", "hi")).alias("open"))
            pending = contexts.join(rest, own)
        else:
            done = some.where(place != F.col("first")) if keep_first else some
        release(blocks)
        a = F.col("s") + F.col("rel") - F.col("hi")
        done = done.select("d", "k", a.alias("a"), (a + F.col("hi") - F.col("lo") + length).alias("b"))
        spans = done if spans is None else spans.unionByName(done)
    return spans


def _cut(length: int):
    """The bytes of each context of a text."""

    def rows(batch):
        data, offs = arrow_bytes(batch.column("text"))
        raw = data.tobytes()
        for i, (d, k, runs) in enumerate(zip(batch.column("d").to_pylist(), batch.column("k").to_pylist(), batch.column("runs").to_pylist())):
            o = int(offs[i])
            table = pa.Table.from_pylist(runs).to_pydict()
            m = len(runs)
            table["bytes"] = [raw[o + s : o + s + n + length - 1] for s, n in zip(table["s"], table["n"])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(table["anchor"], pa.int64()), pa.array(table["times"], pa.int64()), pa.array([d] * m, pa.int64()), pa.array([k] * m, pa.int64()), pa.array(table["s"], pa.int64()), pa.array(table["rel"], pa.int32()), pa.array(table["n"], pa.int32()), pa.array(table["bytes"], pa.binary())],
                ["anchor", "times", "d", "k", "s", "rel", "n", "bytes"],
            )

    return rows


def _blocks(length: int, level: int):
    """One row for each block of ``level`` distances to the anchor that the open
    ranges [lo, hi] touch: digests of the bytes that all windows of the block
    share, and of all bytes of those that the range holds."""

    def rows(batch):
        out = []
        names = ("anchor", "times", "d", "k", "s", "rel", "bytes", "open")
        for anchor, times, d, k, s, rel, raw, open_ in zip(*[batch.column(c).to_pylist() for c in names]):
            for r in open_:
                for j in range(r["lo"] // level, r["hi"] // level + 1):
                    lo, hi = max(r["lo"], j * level), min(r["hi"], j * level + level - 1)
                    tag = f"{anchor}:{j}:".encode()
                    core = raw[rel - j * level : rel - j * level - level + 1 + length]
                    whole = raw[rel - hi : rel - lo + length]
                    out.append((xxhash.xxh3_128_hexdigest(tag + core), xxhash.xxh3_128_hexdigest(tag + f"{lo}:{hi}:".encode() + whole), times, d, k, s, rel, lo, hi))
        types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], v) for i, v in enumerate(types)], ["core", "whole", "times", "d", "k", "s", "rel", "lo", "hi"])

    return rows


def _remove(batch):
    """Results of texts with spans."""
    data, offs = arrow_bytes(batch.column("text"))
    out = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
    for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())):
        raw = data[offs[i] : offs[i + 1]]
        depth = np.zeros(len(raw) + 1, np.int64)
        np.add.at(depth, a, 1)
        np.add.at(depth, b, -1)
        gone = np.cumsum(depth[:-1]) > 0
        kept = raw[~gone].tobytes()
        out["n_bytes"].append(len(raw))
        out["n_removed"].append(int(gone.sum()))
        out["n_spans"].append(int(np.count_nonzero(gone[1:] & ~gone[:-1]) + bool(len(gone) and gone[0])))
        out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        out["kept"].append(kept)
    types = {"kept_sha256": pa.string(), "kept": pa.binary()}
    columns = [pa.array(v, types.get(c, pa.int64())) for c, v in out.items()]
    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *out])


def deduplicate(docs: DataFrame, keep_first: bool = False, length: int = LENGTH, gram: int = GRAM, with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, ``with_bytes``, the
    remaining bytes (kept) of every row."""
    narrow, lists = repeats(docs, keep_first, length, gram)
    gone = (F.col("times") > 1) & (F.col("n_bytes") >= length)
    if keep_first:
        gone &= F.col("d") != F.col("first")
    gone = F.coalesce(gone, F.lit(False))
    ids = stash(lists.select("d", "k").join(narrow.where(gone).select("d", "k").distinct(), ["d", "k"], "left_anti"), "cut_ids", True)
    texts = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("d"), text_or_empty().alias("text"))
    texts = keep_ids(texts.select("doc_id", "d", F.xxhash64("text").alias("k"), "text"), ids, ["d", "k"])
    some = map_arrow(texts.join(lists, ["d", "k"]).select("doc_id", "text", "a", "b"), _remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    rest = drop_ids(narrow, ids, ["d", "k"]).select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(0).alias("n_removed"),
        F.when(gone, 1).otherwise(0).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("sha")).alias("kept_sha256"),
        *([] if not with_bytes else ["d", "k", gone.alias("gone")]),
    )
    if not with_bytes:
        return some.drop("kept").unionByName(rest)
    whole = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("d"), text_or_empty().alias("text"))
    whole = whole.select("d", F.xxhash64("text").alias("k"), F.col("text").cast("binary").alias("kept")).dropDuplicates(["d", "k"])
    rest = rest.join(whole, ["d", "k"]).withColumn("kept", F.when(F.col("gone"), F.lit(b"")).otherwise(F.col("kept"))).drop("d", "k", "gone")
    return some.unionByName(rest)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(read_documents(spark, sf_dir), with_bytes=False)
