"""Language-model scores: context-tree weighting over binary-decomposed bytes.

A text is its lower-cased words with one space between, and an end.  A byte is
eight binary decisions; each is predicted from its leading bits and the last
``DEPTH`` bytes (a text is preceded by ends).  A node of the tree is (d last
bytes, leading bits), with the zeros and ones that followed in the training
rows.  Its Krichevsky-Trofimov estimate and what the nodes one byte longer say
are mixed half and half a priori, so after the corpus the estimate weighs
``beta / (1 + beta)``, beta being the ratio of both sides' probabilities for all
that was seen: every text is predicted by a mixture over all depths.  A node
that training never met says nothing, and its parent's estimate stands for it.

No task holds the tree or a copy of it:

1. Texts form blocks.  Each tells, bucket by bucket, which (context, byte) runs
   and words it has, and how often its training rows have them.
2. A bucket has whole subtrees (those of three last bytes), sums the blocks'
   counts and works up from the leaves.  Sums for shorter contexts are added up
   by Spark; the two topmost levels, 65 535 nodes at most, are on the driver.
3. Buckets work down again and answer the blocks: one number for each run.
4. Blocks meet their answers and score their texts.

The base score, by counts of whole words, comes the same way.  What is shuffled
are the runs of every block, so it follows the corpus; a word or run that all
texts have is one number a block.  Words are told apart by 62-bit hashes.

Edge cases: null text is empty, one end, and scored; without training rows every
byte costs 8 bits and the base scores are 0; rows without a doc_id aren't held
out; rows that repeat a doc_id are learned from and scored each; very long texts
are blocks of their own, counted and scored a million bytes at a time; bytes
that are no UTF-8 are bytes; an empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _LOWER, _SPACE, arrow_bytes, forget, map_arrow, mix, partitions, read_documents, row_steps, span_hashes, spans_of, stash, text_or_empty, tidy
from .toxicity import fold

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DEPTH = 6

#: Context bytes whose subtrees are in one bucket; shorter ones go up further.
WHOLE = 3

#: Bytes of text in a block, and positions that are looked at together.
BLOCK, STEP = 12 << 20, 1 << 20

END, SPACE = 0xFF, 0x20
WORD, END_KEY = np.uint64(1 << 62), np.uint64((1 << 63) - 1)


# --------------------------------------------------------------- text to keys
def stream(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each text as the model sees them, ends included, and n + 1
    offsets."""
    at = offs[1:] + np.arange(len(offs) - 1)
    out = np.full(len(data) + len(at), END, np.uint8)
    inside = np.ones(len(out), bool)
    inside[at] = False
    out[inside] = np.minimum(_LOWER[data], END - 1)
    gap = _SPACE[out]
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1] & (out[:-1] != END)  # one space of a run, none before the first word
    if len(keep):
        keep[0] = not gap[0]
    out = out[keep]
    out[_SPACE[out]] = SPACE
    last = np.flatnonzero((out[:-1] == SPACE) & (out[1:] == END)) if len(out) else []
    out = np.delete(out, last)
    return out, np.append(0, np.flatnonzero(out == END) + 1)


def runs(text: np.ndarray, offs: np.ndarray):
    """(a, b, keys): the run of each position from a to b: its byte in the lowest
    bits, the byte before in the highest, of DEPTH + 1."""
    for a in range(0, len(text), STEP):
        b = min(len(text), a + STEP)
        keys = text[a:b].astype(np.uint64)
        starts = offs[:-1][(offs[:-1] > a - DEPTH) & (offs[:-1] < b)]
        for k in range(1, DEPTH + 1):
            before = np.full(b - a, END, np.uint8)
            before[max(0, k - a) :] = text[max(0, a - k) : b - k]
            for o in range(k):
                own = starts + o
                before[own[(own >= a) & (own < b)] - a] = END
            keys |= before.astype(np.uint64) << np.uint64(8 * (DEPTH + 1 - k))
        yield a, b, keys


def words(text: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The key of every word, and the first word of each text."""
    start, end, first = spans_of((text != SPACE) & (text != END), offs)
    return span_hashes(text, start, end) >> np.uint64(2) | WORD, first


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    if len(keys) == 1:
        return keys[0], counts[0]
    out, at = np.unique(np.concatenate(keys), return_inverse=True)
    return out, np.bincount(at, np.concatenate(counts), len(out)).astype(np.int64)


def tallied(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, of keys doubled; odd ones count.  In place."""
    keys.sort()
    odd = (keys & np.uint64(1)).astype(np.uint8)
    keys >>= np.uint64(1)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(odd, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)


def counted(text: np.ndarray, offs: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a block, and how often its ``known`` texts have each."""
    keys, counts, own, n = [], [], np.empty(min(len(text), BLOCK), np.uint64), 0

    def done(some):
        k, c = tallied(some)
        keys.append(k)
        counts.append(c)

    for a, b, part in runs(text, offs):
        i, j = np.searchsorted(offs, a, "right") - 1, np.searchsorted(offs, b - 1, "right")
        if n + b - a > len(own):
            done(own[:n])
            n = 0
        own[n : n + b - a] = part << np.uint64(1) | np.repeat(known[i:j], np.diff(np.clip(offs[i : j + 1], a, b)))
        n += b - a
    done(own[:n])
    if len(keys) > 1:
        k, c = merged(keys, counts)
        keys, counts = [k], [c]
    part, first = words(text, offs)
    done(part << np.uint64(1) | np.repeat(known, np.diff(first)))
    done(np.full(len(known), END_KEY << np.uint64(1)) | known)
    return np.concatenate(keys), np.concatenate(counts)  # runs, words, the end: in order


class Places:
    """Where keys are among sorted distinct ones, by tables of their hashes."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self.tables, left, turn = keys, [], np.arange(len(keys), dtype=np.int32), 0
        while len(left):
            shift = np.uint64(64 - max(8, (2 * len(left)).bit_length()))
            table = np.zeros(1 << int(64 - shift), np.int32)
            slot = self.slot(keys[left], turn, shift)
            table[slot] = left
            self.tables.append((shift, table))
            left, turn = left[table[slot] != left], turn + 1

    @staticmethod
    def slot(keys: np.ndarray, turn: int, shift) -> np.ndarray:
        return ((keys + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15 + 2 * turn)) >> shift

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The places of keys that are all there."""
        out = np.zeros(len(keys), np.int32)
        todo, own = None, keys
        for turn, (shift, table) in enumerate(self.tables):
            at = table[self.slot(own, turn, shift)]
            if todo is None:
                out = at
                todo = np.flatnonzero(self.keys[at] != own)
            else:
                out[todo] = at
                todo = todo[self.keys[at] != own]
            if not len(todo):
                break
            own = keys[todo]
        return out


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Runs by their last WHOLE context bytes, words by themselves."""
    subtree = np.where(keys >= WORD, keys, keys >> np.uint64(8 * (DEPTH + 1 - WHOLE)))
    return (mix(subtree) % np.uint64(buckets)).astype(np.int32)


def dealt(keys: np.ndarray, buckets: int):
    """(bucket, places of its keys) of sorted keys; places in order."""
    to = bucket_of(keys, buckets)
    to = to.astype(np.uint16) if buckets <= 1 << 16 else to  # sorted by digits
    order = np.argsort(to, kind="stable")
    bounds = np.flatnonzero(np.append(True, np.diff(to[order]) != 0)) if len(order) else np.zeros(0, np.int64)
    for a, b in zip(bounds, [*bounds[1:], len(order)]):
        yield int(to[order[a]]), order[a:b]


def pack(values: np.ndarray, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(values).tobytes())


def unpack(cell: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(cell), kind)


def pack_floats(values: np.ndarray) -> bytes:
    """First bytes together, then second ones and so on: they are alike."""
    return pack(values.astype(np.float32).view(np.uint8).reshape(-1, 4).T)


def unpack_floats(cell: bytes) -> np.ndarray:
    return np.ascontiguousarray(unpack(cell, np.uint8).reshape(4, -1).T).view(np.float32).ravel()


def _gaps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


# ------------------------------------------------------------------- the tree
def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers: Stirling's series, eight steps up."""
    out = np.zeros(len(x))
    for i in range(8):
        out -= np.log(x + i)
    y = x + 8
    r = 1 / (y * y)
    return out + (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y


#: log_gamma of n + 1/2 and of n + 1 for small n.
_SMALL = 4096
_HALF, _WHOLE = log_gamma(np.arange(_SMALL) + 0.5), log_gamma(np.arange(_SMALL) + 1.0)


def _looked_up(table: np.ndarray, n: np.ndarray, more: float) -> np.ndarray:
    out = table[np.minimum(n, _SMALL - 1)]
    far = np.flatnonzero(n >= _SMALL)
    out[far] = log_gamma(n[far] + more)
    return out


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of what the estimator gives to all that was seen."""
    return _looked_up(_HALF, zeros, 0.5) + _looked_up(_HALF, ones, 0.5) - _looked_up(_WHOLE, zeros + ones, 1.0) - math.log(math.pi)


class Level:
    """Nodes of one depth, sorted: context << 8 | leading bits after a 1; with
    ``kt``, the estimate of a one, ``w``, its weight against longer contexts,
    and whether training has seen them."""

    def __init__(self, node, zeros, ones, longer=None) -> None:
        self.node, self.zeros, self.ones, self.seen = node, zeros, ones, zeros + ones > 0
        own = estimate(zeros, ones)
        self.kt = (ones + 0.5) / (zeros + ones + 1.0)
        if longer is None:
            self.log, self.w = own, np.ones(len(node))
        else:
            self.log = np.logaddexp(own, longer) - math.log(2)
            self.w = 1 / (1 + np.exp(np.clip(longer - own, -700, 700)))

    def shorter(self):
        """Nodes one byte shorter, and the sums of zeros, ones and logarithms."""
        up, self.up = np.unique((self.node >> 16) << 8 | (self.node & 255), return_inverse=True)
        zeros, ones = (np.bincount(self.up, x, len(up)).astype(np.int64) for x in (self.zeros, self.ones))
        return up, zeros, ones, np.bincount(self.up, self.log, len(up))


def subtree(keys: np.ndarray, counts: np.ndarray, bit: int) -> tuple[np.ndarray, list[Level]]:
    """For one of the eight decisions: the leaf of each of the sorted runs, and
    the levels DEPTH, DEPTH - 1, ... WHOLE."""
    byte = (keys & np.uint64(255)).astype(np.int64)
    node = (keys >> np.uint64(8)).astype(np.int64) << 8 | 1 << bit | byte >> (8 - bit)
    new = np.append(True, node[1:] != node[:-1])[: len(node)]
    first = np.flatnonzero(new)
    both, ones = (np.add.reduceat(x, first) if len(first) else np.zeros(0, np.int64) for x in (counts, counts * ((byte >> (7 - bit)) & 1)))
    levels = [Level(node[first], both - ones, ones)]
    for _ in range(DEPTH - WHOLE):
        levels.append(Level(*levels[-1].shorter()))
    return np.cumsum(new) - 1, levels


class Top:
    """What depths up to ``WHOLE - 1`` say: for a node that has been seen, the
    whole's estimate is ``a + b * (what longer contexts say)``, or ``z`` if those
    say nothing."""

    def __init__(self, rows) -> None:
        """``rows``: node, zeros, ones and logs, summed, of depth 1."""
        one = Level(*rows)
        root = Level(*one.shorter())
        self.z = np.full(256 * 256, 0.5)
        self.a, self.b, self.seen = np.zeros(256 * 256), np.ones(256 * 256), np.zeros(256 * 256, bool)
        for c in range(256):  # every context of one byte starts from the root
            self.z[c * 256 + root.node], self.a[c * 256 + root.node], self.b[c * 256 + root.node] = root.kt, root.w * root.kt, 1 - root.w
        self.extend(one.node, one.kt, one.w, self.z, self.a, self.b)
        self.seen[one.node] = True

    @staticmethod
    def extend(at, kt, w, z, a, b) -> None:
        """One byte longer, for the nodes ``at`` of arrays z, a and b."""
        z[at] = a[at] + b[at] * kt
        a[at] += b[at] * w * kt
        b[at] *= 1 - w


def run_scores(keys: np.ndarray, counts: np.ndarray, two: tuple, top: Top) -> np.ndarray:
    """log10 of the probability of each run's byte, of whole subtrees of sorted
    runs.  ``two``: nodes of two bytes (sorted), their kt and w."""
    byte, out = (keys & np.uint64(255)).astype(np.int64), np.zeros(len(keys))
    node, kt, w = two
    for bit in range(8):
        leaf, levels = subtree(keys, counts, bit)
        up, *_ = levels[-1].shorter()
        first = (up >> 16) << 8 | (up & 255)
        z, a, b = top.z[first], top.a[first], top.b[first]
        at = np.minimum(np.searchsorted(node, up), max(0, len(node) - 1))
        going = top.seen[first] & (node[at] == up if len(node) else False)
        own = np.flatnonzero(going)
        Top.extend(own, kt[at[own]], w[at[own]], z, a, b)
        for level in reversed(levels):  # each node goes on from the one it is a longer context of
            z, a, b, going = z[level.up], a[level.up], b[level.up], going[level.up] & level.seen
            own = np.flatnonzero(going)
            Top.extend(own, level.kt[own], level.w[own], z, a, b)
        z = z[leaf]
        out += np.log10(np.where((byte >> (7 - bit)) & 1, z, 1 - z))
    return out


# ------------------------------------------------------------------- the jobs
TEXTS = -1
CELLS = "block long, bucket int, keys binary, counts binary, doc_ids array<bigint>, held array<boolean>, text binary"


def blocks(docs: DataFrame, held, buckets: int, block: int = BLOCK) -> DataFrame:
    """The blocks' texts (bucket TEXTS) and their keys with counts."""

    def rows(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offs = arrow_bytes(batch.column("text"))
            ids, out = batch.column("doc_id"), np.asarray(batch.column("held"))
            for i, j in row_steps(offs, block):
                text, at = stream(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                keys, counts = counted(text, at, ~out[i:j])
                cells = [(number, k, pack(_gaps(keys[own])), pack(counts[own]), None, None, None) for k, own in dealt(keys, buckets)]
                cells.append((number, TEXTS, None, None, ids[i:j].to_pylist(), out[i:j].tolist(), pack(text, 3)))
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([c[k] for c in cells], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in CELLS.split(", ")])
                number += 1

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held"), text_or_empty().alias("text"))
    return stash(some.mapInArrow(tidy(rows), CELLS), "blocks")


def _grouped(batches, key: str):
    """(key, rows of it) of batches sorted by it, a list of (batch, row)."""
    at, own = None, []
    for batch in batches:
        for i, k in enumerate(batch.column(key).to_pylist()):
            if k != at:
                if own:
                    yield at, own
                at, own = k, []
            own.append((batch, i))
    if own:
        yield at, own


SUMS = "bucket int, keys binary, counts binary, node long, zeros long, ones long, log double, tokens long, kinds long"


def summed(cells: DataFrame) -> DataFrame:
    """For each bucket its keys with the counts of all blocks, the number of
    training words and of different ones, and its sums for shorter contexts."""

    def rows(batches):
        for bucket, own in _grouped(batches, "bucket"):
            keys, counts, size = [], [], 0
            for batch, i in own:
                keys.append(np.cumsum(unpack(batch.column("keys")[i].as_py(), np.uint64), dtype=np.uint64))
                counts.append(unpack(batch.column("counts")[i].as_py(), np.int64))
                size += len(keys[-1])
                if size > STEP and len(keys) > 1:  # so that no more than the different keys stay
                    k, c = merged(keys, counts)
                    keys, counts, size = [k], [c], 0
            keys, counts = merged(keys, counts)
            words = counts[keys >= WORD]
            known = (counts > 0) & (keys < WORD)
            node, zeros, ones, log = (np.concatenate(x) for x in zip(*[subtree(keys[known], counts[known], bit)[1][-1].shorter() for bit in range(8)]))
            n = len(node) + 1  # a row of the bucket's own, and one for each node
            yield pa.RecordBatch.from_pydict(
                {
                    "bucket": pa.array(np.full(n, bucket, np.int32)),
                    "keys": pa.array([pack(_gaps(keys))] + [None] * (n - 1), pa.binary()),
                    "counts": pa.array([pack(counts)] + [None] * (n - 1), pa.binary()),
                    "node": pa.array(np.append(0, node), mask=np.arange(n) == 0),
                    "zeros": pa.array(np.append(0, zeros)),
                    "ones": pa.array(np.append(0, ones)),
                    "log": pa.array(np.append(0.0, log)),
                    "tokens": pa.array(np.append(words.sum(), np.zeros(n - 1, np.int64)).astype(np.int64)),
                    "kinds": pa.array(np.append((words > 0).sum(), np.zeros(n - 1, np.int64)).astype(np.int64)),
                }
            )

    own = cells.where(F.col("bucket") != TEXTS).select("bucket", "keys", "counts")
    return stash(own.repartition(partitions(cells.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(rows), SUMS), "sums")


def top_levels(sums: DataFrame) -> tuple[DataFrame, Top]:
    """Nodes of two bytes (node, kt, w), stashed, and what is above them."""

    def settled(batch):
        level = Level(*(np.asarray(batch.column(c)) for c in ("node", "zeros", "ones", "log")))
        yield pa.RecordBatch.from_pydict({c: pa.array(getattr(level, c)) for c in ("node", "zeros", "ones", "log", "kt", "w")})

    def total(rows):
        return rows.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "log")])

    two = stash(map_arrow(total(sums.where("node is not null").select("node", "zeros", "ones", "log")), settled, "node long, zeros long, ones long, log double, kt double, w double"), "two", True)
    shorter = F.shiftleft(F.shiftright("node", 16), 8).bitwiseOR(F.col("node").bitwiseAND(255)).alias("node")
    one = total(two.select(shorter, "zeros", "ones", "log")).toPandas().sort_values("node")  # 256 * 255 rows at most
    return two, Top([one.node.to_numpy(np.int64), *(one[c].to_numpy(kind) for c, kind in (("zeros", np.int64), ("ones", np.int64), ("log", np.float64)))])


#: What a bucket reads, in this order.
NODES, MODEL, ASKED = range(3)


def answers(cells: DataFrame, sums: DataFrame, two: DataFrame, top: Top) -> DataFrame:
    """block, bucket, values, counts: log10 of the probability of each run, and the
    training count of each word, in the order of the block's keys."""
    spark = cells.sparkSession
    empty = {"block": F.lit(None).cast("long"), "keys": F.lit(None).cast("binary"), "counts": F.lit(None).cast("binary"), "nodes": F.lit(None).cast("array<struct<node: bigint, kt: double, w: double>>")}

    def as_rows(df, kind, **columns):
        return df.select("bucket", F.lit(kind).alias("kind"), *[columns.get(c, default).alias(c) for c, default in empty.items()])

    context = F.shiftright("node", 8)
    wanted = sums.where("node is not null").select("bucket", context.alias("context")).distinct()
    of = two.groupBy(context.alias("context")).agg(F.collect_list(F.struct("node", "kt", "w")).alias("nodes"))  # 255 at most
    parts = as_rows(wanted.join(of, "context"), NODES, nodes=F.col("nodes"))
    parts = parts.unionByName(as_rows(sums.where("keys is not null"), MODEL, keys=F.col("keys"), counts=F.col("counts")))
    parts = parts.unionByName(as_rows(cells.where(F.col("bucket") != TEXTS), ASKED, block=F.col("block"), keys=F.col("keys")))

    def rows(batches):
        at, nodes, keys, counts, scores = None, [], None, None, None
        for batch in batches:
            out = []
            kinds, blocks_ = batch.column("kind").to_pylist(), batch.column("block").to_pylist()
            for i, bucket in enumerate(batch.column("bucket").to_pylist()):
                if bucket != at:
                    at, nodes = bucket, []
                if kinds[i] == NODES:
                    x = batch.column("nodes").slice(i, 1).flatten()
                    nodes.append([np.asarray(x.field(k)) for k in range(3)])
                    continue
                own = np.cumsum(unpack(batch.column("keys")[i].as_py(), np.uint64), dtype=np.uint64)
                if kinds[i] == MODEL:
                    keys, counts = own, unpack(batch.column("counts")[i].as_py(), np.int64)
                    runs_ = keys < WORD
                    found = [np.concatenate([x[k] for x in nodes]) if nodes else np.zeros(0, np.int64 if k == 0 else float) for k in range(3)]
                    order = np.argsort(found[0])
                    scores = run_scores(keys[runs_], counts[runs_], tuple(x[order] for x in found), top)
                    nodes = []
                else:
                    place = np.searchsorted(keys, own)  # every key that is asked for is there
                    n = int(np.searchsorted(own, WORD))
                    out.append((blocks_[i], bucket, pack_floats(scores[place[:n]]), pack(counts[place[n:]])))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["block", "bucket", "values", "counts"])

    own = parts.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "kind")
    return own.mapInArrow(tidy(rows), "block long, bucket int, values binary, counts binary")


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"


def scored(cells: DataFrame, replies: DataFrame, buckets: int, tokens: int, kinds: int) -> DataFrame:
    """The scores of every text, from its block and the answers to it."""
    base = math.log10(tokens + 0.5 * (kinds + 1))

    def texts(x, doc_ids, held, values):
        text = unpack(x, np.uint8)
        offs = np.append(0, np.flatnonzero(text == END) + 1)
        keys, _ = counted(text, offs, np.zeros(len(offs) - 1, bool))
        n_runs = int(np.searchsorted(keys, WORD))
        score, count = np.zeros(n_runs, np.float32), np.zeros(len(keys) - n_runs, np.int64)
        for bucket, own in dealt(keys, buckets):
            n = int(np.searchsorted(own, n_runs))
            score[own[:n]], count[own[n:] - n_runs] = unpack_floats(values[bucket][0]), unpack(values[bucket][1], np.int64)
        total, places = np.zeros(len(offs) - 1), Places(keys[:n_runs])
        for a, b, own in runs(text, offs):
            i, j = np.searchsorted(offs, a, "right") - 1, np.searchsorted(offs, b - 1, "right")
            sums = np.append(0.0, np.cumsum(score[places.find(own)], dtype=np.float64))
            bounds = np.clip(offs[i : j + 1], a, b) - a
            total[i:j] += sums[bounds[1:]] - sums[bounds[:-1]]
        own, first = words(text, offs)
        c = np.append(count[Places(keys[n_runs:]).find(own)], 0)
        end = count[-1]  # the end's key is the last one

        def per_text(x):
            sums = np.append(0, np.cumsum(x[:-1]))
            return sums[first[1:]] - sums[first[:-1]]

        n = np.diff(first) + 1
        return {
            "doc_id": pa.array(doc_ids, pa.int64()), "held_out": pa.array(held, pa.bool_()), "n_tokens": pa.array(n), "n_known": pa.array(per_text(c > 0) + int(end > 0)),
            "train_tokens": pa.array(np.full(len(n), tokens, np.int64)), "base_score": pa.array(per_text(np.log10(c + 0.5)) + math.log10(end + 0.5) - n * base),
            "score": pa.array(total), "n_bytes": pa.array(np.diff(offs)),
        }

    def rows(batches):
        for _, own in _grouped(batches, "block"):
            values, text = {}, None
            for batch, i in own:
                if batch.column("bucket")[i].as_py() == TEXTS:
                    text = batch, i
                else:
                    values[batch.column("bucket")[i].as_py()] = batch.column("values")[i].as_py(), batch.column("counts")[i].as_py()
            batch, i = text
            yield pa.RecordBatch.from_pydict(texts(batch.column("text")[i].as_py(), batch.column("doc_ids")[i].as_py(), batch.column("held")[i].as_py(), values))

    both = cells.where(F.col("bucket") == TEXTS).select("block", "bucket", "doc_ids", "held", "text").unionByName(replies, allowMissingColumns=True)
    return both.repartition(partitions(cells.sparkSession), "block").sortWithinPartitions("block").mapInArrow(tidy(rows), SCORES)


def score(docs: DataFrame, held, block: int = BLOCK) -> DataFrame:
    """Scores of every row of ``docs``, learned from those not ``held``: doc_id,
    held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes."""
    buckets = 2 * partitions(docs.sparkSession)
    cells = blocks(docs, held, buckets, block)
    sums = summed(cells)
    two, top = top_levels(sums)
    n = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("kinds")).first()
    forget(docs.sparkSession)  # the shuffle of the counts
    return scored(cells, answers(cells, sums, two, top), buckets, n["tokens"], n["kinds"])


def op13_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_documents(spark, sf_dir), fold(5) == 1)
