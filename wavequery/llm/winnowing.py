"""Document fingerprints by winnowing.

Code points are hashed in runs of ``K`` (a rolling polynomial); of every
``WINDOW`` consecutive hashes the smallest is selected, the rightmost of equal
ones.  Two texts that share ``K + WINDOW - 1`` code points in a row share at
least one selected hash, and its positions tell where.  A fingerprint is hex:
10 digits for each selected hash, 8 of the hash and 2 of its distance in code
points from the one before (the first: from the start); distances are below
``WINDOW + 1``, so two digits suffice.  A shorter text selects from the hashes
it has; one below K code points is hashed whole.  Likeness is the Jaccard
similarity of the sets of selected hashes.

``pair_with_next`` gives each document the next one in descending doc_id
without collecting anything: ranges of ids, from their quantiles, each go to a
task of their own, sorted; the first row of a range also goes to the range
above it, whose last document it follows.

With the values below 23 shared code points are sure to be found, and a text of
50 code points has some five hashes.

Edge cases: null text is empty; an empty text has an empty fingerprint, and two
empty fingerprints are alike (1.0), one alone is not (0.0); a table of one row
follows itself; equal doc_ids are ordered by text; null doc_ids come last; texts
of over ``STEP`` code points are hashed in overlapping pieces, with the same
result; an empty table gives an empty result; other columns are ignored.
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

from .common import STEP, mix, partitions, read_documents, sliding_min, text_or_empty, tidy

cloudpickle.register_pickle_by_value(sys.modules[__name__])

K, WINDOW = 8, 16

_LOW, _BASE = np.uint64(0xFFFFFFFF), np.uint64(0x9E3779B97F4A7C15)


def rolling_hashes(units: np.ndarray, k: int = K) -> np.ndarray:
    """32 bits of the polynomial of every k code points in a row."""
    m = max(0, len(units) - k + 1)
    out = np.zeros(m, np.uint64)
    for i in range(k):
        out = out * _BASE + (units[i : i + m].astype(np.uint64) + np.uint64(1))
    return mix(out) >> np.uint64(32)


def select_hashes(units: np.ndarray, offs: np.ndarray, k: int = K, window: int = WINDOW):
    """Selected hashes (uint32), their positions, and each row's first one."""
    n, lengths = len(units), np.diff(offs)
    hashes = rolling_hashes(units, k)
    at = np.arange(len(hashes))
    keys = hashes << np.uint64(32) | (_LOW - at.astype(np.uint64))  # equal hashes: the rightmost is smaller
    grams = lengths - k + 1
    inside = np.zeros(max(0, n - k + 1 - window + 1) + 1, np.int64)  # windows that no row's end cuts
    full = grams >= window
    np.add.at(inside, offs[:-1][full], 1)
    np.add.at(inside, (offs[:-1] + grams - window + 1)[full], -1)
    picked = sliding_min(keys, window)[np.cumsum(inside[:-1]) > 0]
    some = np.flatnonzero((grams > 0) & ~full)
    if len(some):
        bounds = np.stack([offs[:-1][some], offs[:-1][some] + grams[some]], 1).ravel()
        picked = np.concatenate([picked, np.minimum.reduceat(np.append(keys, np.uint64(0xFFFFFFFFFFFFFFFF)), bounds)[::2]])
    pos = (_LOW - (picked & _LOW)).astype(np.int64)
    pos = np.unique(pos)
    value = hashes[pos]
    tiny = np.flatnonzero((grams <= 0) & (lengths > 0))
    if len(tiny):
        start = offs[:-1][tiny]
        pos = np.concatenate([pos, start])
        whole = [xxhash.xxh3_64_intdigest(units[a : a + size].tobytes()) >> 32 for a, size in zip(start.tolist(), lengths[tiny].tolist())]
        value = np.concatenate([value, np.array(whole, np.uint64)])
        order = np.argsort(pos, kind="stable")
        pos, value = pos[order], value[order]
    return value.astype(np.uint32), pos, np.searchsorted(pos, offs)


def _units(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _long(text: str, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``select_hashes`` of one long text: pieces that overlap by all but one
    code point of a window's reach hold every window once."""
    values, places, step = [], [], max(STEP, 2 * (k + window))
    for a in range(0, len(text) - (k + window - 2), step):
        units = _units(text[a : a + step + k + window - 2])
        value, pos, _ = select_hashes(units, np.array([0, len(units)]), k, window)
        values.append(value)
        places.append(pos + a)
    pos, first = np.unique(np.concatenate(places), return_index=True)
    return np.concatenate(values)[first], pos, np.array([0, len(pos)])


def fingerprints(texts: list[str], k: int = K, window: int = WINDOW) -> tuple[list[str], list[np.ndarray]]:
    """Fingerprint and sorted distinct hashes of every text."""
    prints, sets = [], []
    i = 0
    while i < len(texts):
        j, chars = i, 0
        while j < len(texts) and (j == i or chars + len(texts[j]) <= STEP):
            chars += len(texts[j])
            j += 1
        offs = np.concatenate([[0], np.cumsum([len(x) for x in texts[i:j]])]).astype(np.int64)
        value, pos, first = _long(texts[i], k, window) if chars > STEP else select_hashes(_units("".join(texts[i:j])), offs, k, window)
        gap = np.diff(pos, prepend=0)
        starts = first[:-1][first[:-1] < first[1:]]
        gap[starts] = pos[starts] - offs[:-1][first[:-1] < first[1:]]
        cells = np.empty((len(value), 5), np.uint8)
        cells[:, :4] = value.astype(">u4").view(np.uint8).reshape(-1, 4)
        cells[:, 4] = gap
        digits = cells.tobytes().hex()
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            prints.append(digits[10 * a : 10 * b])
            sets.append(np.unique(value[a:b]))
        i = j
    return prints, sets


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / (len(a) + len(b) - common)


def pair_with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and _tail, dealt to one task a range of ids and sorted; a
    row with _tail follows the range's last one and stands for itself elsewhere."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    n = min(partitions(spark), 8192)
    cuts = rows.select(F.percentile_approx("doc_id", [(i + 1) / n for i in range(n - 1)], 100 * n).alias("c")).first()["c"] if n > 1 else []
    cuts = sorted(set(cuts or []))
    levels = len(cuts).bit_length()
    cuts += [(1 << 63) - 1] * ((1 << levels) - 1 - len(cuts))
    if levels:
        table = F.lit(cuts).cast("array<bigint>")

        def halve(lo, step):
            return F.when(F.element_at(table, (lo + step).cast("int")) <= F.col("doc_id"), lo + step).otherwise(lo)

        bucket = F.aggregate(F.lit([1 << i for i in reversed(range(levels))]).cast("array<int>"), F.lit(0), halve)
    else:
        bucket = F.lit(0)
    bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(bucket).cast("int")
    heads = {r["b"]: r["head"] for r in rows.groupBy(bucket.alias("b")).agg(F.max("doc_id").alias("head")).collect()}
    order = sorted(heads, reverse=True)
    follows = {order[(i + 1) % len(order)]: b for i, b in enumerate(order)}  # range -> the range that its head follows
    rows = rows.withColumn("_b", bucket)
    if order:
        to = F.create_map(*[F.lit(x) for kv in follows.items() for x in kv])
        head = F.create_map(*[F.lit(x) for kv in heads.items() for x in (kv[0], -1 if kv[1] is None else kv[1])])
        is_head = F.coalesce(F.col("doc_id"), F.lit(-1)) == head[F.col("_b")]
        place = F.struct(F.col("_b").alias("b"), F.lit(0).alias("tail"))
        rows = rows.withColumn("_to", F.explode(F.when(is_head, F.array(place, F.struct(to[F.col("_b")].alias("b"), F.lit(1).alias("tail")))).otherwise(F.array(place))))
        rows = rows.select("doc_id", "text", F.col("_to.b").alias("_b"), F.col("_to.tail").alias("_tail"))
    else:
        rows = rows.withColumn("_tail", F.lit(0))
    return rows.repartitionById(n, F.col("_b")).sortWithinPartitions("_tail", F.desc_nulls_last("doc_id"), "text").select("doc_id", "text", "_tail")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches):
    pending: list[tuple] = []
    done = False
    for batch in batches:
        rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())
        for doc_id, text, tail in rows:
            if done:
                break  # only the first tail follows
            pending.append((doc_id, text))
            done = bool(tail)
            if sum(len(x[1]) for x in pending[-64:]) > STEP or len(pending) >= 512:
                if len(pending) > 1:
                    yield _rows(pending)
                    pending = pending[-1:]
    if len(pending) > 1:
        yield _rows(pending)


def _rows(pending: list[tuple]) -> pa.RecordBatch:
    """Results of all rows but the last, which only follows."""
    texts = [x[1] for x in pending]
    edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts, texts[1:])]
    prints, sets = fingerprints(texts)
    prints2, sets2 = fingerprints(edited)
    n = len(edited)
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array([x[0] for x in pending[:n]], pa.int64()),
            "n_chars": pa.array([len(x) for x in texts[:n]], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
            "fingerprint": pa.array(prints[:n], pa.string()),
            "edited_fingerprint": pa.array(prints2, pa.string()),
            "near_edited": pa.array([likeness(sets[i], sets2[i]) for i in range(n)], pa.float64()),
            "near_next": pa.array([likeness(sets[i], sets[i + 1]) for i in range(n)], pa.float64()),
        }
    )


def op8_winnow_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_with_next(read_documents(spark, sf_dir)).mapInArrow(tidy(_compare), SCHEMA)
