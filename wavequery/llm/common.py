"""Helpers that the corpus operators share.

* ``stash`` writes a table to the folder that all executors share and reads it
  back: it cuts lineage, and a lost executor costs only the tasks it ran.
  ``release`` deletes such tables when nothing reads them any more.
* ``keep_ids`` / ``drop_ids`` filter a wide table by a narrow table of keys; the
  keys are broadcast only after they have been counted, and shuffled beyond.
* the numpy functions work on the UTF-8 bytes of whole Arrow batches, so no
  Python loop runs over characters or words.  Texts of more than ``STEP`` bytes
  are cut at white space, so memory doesn't grow with a text.
"""

from __future__ import annotations

import ctypes
import gc
import sys
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Keys that may be broadcast at most: some 16 bytes each, so 16 MB.
BROADCAST_IDS = 1_000_000


# ------------------------------------------------------------------ tables
def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.  Where that is unset, a folder of
    this session's own, if everything runs on this machine; else an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "/tmp/checkpoints/" + spark.sparkContext.applicationId
    return base.rstrip("/")


#: Of how many shuffle partitions a file of a narrow table is made.
FEWER = 8

#: On a local disk (``file:``), tables that live for minutes need no checksum
#: files, each of which costs a process of its own.  Other stores don't see this.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def stash(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.  ``narrow``:
    its rows are some numbers each and cheap to make, so it becomes fewer files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.coalesce(-(-partitions(spark) // FEWER)) if narrow else df).write.options(**PLAIN).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete stashed tables that nothing reads any more, and the shuffle files
    that nothing refers to."""
    for df in tables:
        spark, path = df.sparkSession, df._stash_path
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    if tables:
        forget(tables[0].sparkSession)


def forget(spark: SparkSession) -> None:
    """Let the driver find the shuffle files that nothing refers to (it learns of
    them by its garbage collection alone)."""
    gc.collect()
    spark._jvm.System.gc()


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def read_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _by_ids(df: DataFrame, ids: DataFrame, key, how: str) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    names = [f"_id{i}" for i in range(len(keys))]
    side = small(ids.select(*[F.col(c).alias(n) for c, n in zip(ids.columns, names)]))
    same = F.lit(True)
    for k, n in zip(keys, names):
        same &= df[k].eqNullSafe(side[n])
    return df.join(side, same, how)


def small(side: DataFrame) -> DataFrame:
    """``side`` (a stashed table) with a broadcast hint if a count shows that it
    is short; else Spark shuffles both sides, and splits skewed partitions."""
    return F.broadcast(side) if side.count() <= BROADCAST_IDS else side


def keep_ids(df: DataFrame, ids: DataFrame, key="doc_id") -> DataFrame:
    """Rows of ``df`` whose key (one column or some) is among ``ids`` (stashed);
    a null is equal to a null."""
    return _by_ids(df, ids, key, "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, key="doc_id") -> DataFrame:
    """Rows of ``df`` whose key is not among ``ids``; a null is equal to a null."""
    return _by_ids(df, ids, key, "left_anti")


#: Share of all rows from which a key may count as frequent.
FREQUENT = 1 / 2000


def frequent(rows: DataFrame, key: str) -> DataFrame:
    """The keys that a Misra-Gries summary names as frequent, ``1 / FREQUENT`` at
    most, by way of the driver; null is none."""
    found = rows.stat.freqItems([key], FREQUENT).first()[0]
    return rows.sparkSession.createDataFrame([(x,) for x in found if x is not None], rows.select(key).schema)


def split_join(rows: DataFrame, side: DataFrame, key: str, how: str = "inner", names: DataFrame | None = None, on: list[str] | None = None) -> DataFrame:
    """``rows`` (stashed) joined to ``side``, which has one row a key at most.
    Frequent keys (``names``, by default those of ``rows``; so ``1 / FREQUENT`` rows
    of ``side`` at most) meet their row on the map side; the rest is shuffled, and
    no key of it has more than ``FREQUENT`` of the rows.  ``on``: columns that make
    up the key, ``key`` among them, if it is frequent wherever they are."""
    on, names = on or [key], frequent(rows, key) if names is None else names
    heavy = F.broadcast(side.join(F.broadcast(names), key))
    light = rows.where(F.col(key).isNotNull()).join(F.broadcast(names), key, "left_anti").join(side, on, how)
    if how == "inner":
        return light.unionByName(rows.join(heavy, on))
    often = rows.join(F.broadcast(names.join(heavy, key, "left")), key)
    return light.unionByName(often).unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)


def repeated(df: DataFrame, make, fields: list[tuple[str, str]], distinct: str | None = None) -> DataFrame:
    """Rows whose key occurs twice at least, over all that ``make`` returns:
    structured arrays of ``fields``, (name, long or int), the key first, from a
    record batch.  ``distinct``: a field that must differ; of rows equal in both,
    one stays for each batch at most.

    Rows travel packed, some thousand in one binary cell, so a row costs its own
    bytes and no more.  Keys with over ``LOCAL`` rows in a batch are known to
    repeat: their rows go anywhere, and a signal goes where the key's others
    meet, so a key that a third of all rows have is no load for a task."""
    kinds = {"long": np.int64, "int": np.int32}
    dtype = np.dtype([(name, kinds[kind]) for name, kind in fields])
    key, n = fields[0][0], partitions(df.sparkSession)
    buckets = 4 * n  # a bucket is sorted at once

    def order(rows):
        rows = rows[np.lexsort((rows[distinct], rows[key])) if distinct else np.argsort(rows[key], kind="stable")]
        if distinct and len(rows):
            rows = rows[np.append(True, (rows[key][1:] != rows[key][:-1]) | (rows[distinct][1:] != rows[distinct][:-1]))]
        first = np.flatnonzero(np.append(True, rows[key][1:] != rows[key][:-1])) if len(rows) else np.zeros(0, np.int64)
        return rows, first, np.diff(np.append(first, len(rows)))

    def deal(batch):
        for rows in make(batch):
            rows, first, size = order(rows)
            hot = np.repeat(size > LOCAL, size)
            out = [(xxhash.xxh3_64_intdigest(x) % buckets, KNOWN, x) for x in [rows[hot].tobytes()] if x]
            for kind, some in ((OPEN, rows[~hot]), (SIGNAL, rows[key][first[size > LOCAL]])):
                keys = some[key] if kind == OPEN else some
                to = (mix(keys.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(to, kind="stable")
                bounds = np.flatnonzero(np.append(True, np.diff(to[by]) != 0)) if len(by) else []
                some = some[by]
                for a, b in zip(bounds, [*bounds[1:], len(by)]):
                    out.append((int(to[by[a]]), kind, some[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["bucket", "kind", "cells"])

    def cells(rows):
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[name])) for name, _ in fields], [name for name, _ in fields])

    def settle(open_, signals):
        rows, first, size = order(np.frombuffer(b"".join(open_), dtype))
        twice = size > 1
        if signals:
            twice |= np.isin(rows[key][first], np.frombuffer(b"".join(signals), np.int64))
        return cells(rows[np.repeat(twice, size)])

    def meet(batches):
        at, open_, signals = None, [], []
        for batch in batches:
            for bucket, kind, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if bucket != at:
                    if open_:
                        yield settle(open_, signals)
                    at, open_, signals = bucket, [], []
                if kind == KNOWN:
                    yield cells(np.frombuffer(x.as_buffer(), dtype))
                else:
                    (open_ if kind == OPEN else signals).append(x.as_py())
        if open_:
            yield settle(open_, signals)

    packed = map_arrow(df, deal, "bucket int, kind int, cells binary")
    return packed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(meet), ", ".join(f"{a} {b}" for a, b in fields))


#: Rows of a key in one batch beyond which it is known to repeat; kinds of cells.
LOCAL, OPEN, KNOWN, SIGNAL = 64, 0, 1, 2


#: The column that ``keep_one`` adds on the way.
_KEY = "_key_of_the_row"


def keep_one(docs: DataFrame, key: Column, rows: DataFrame) -> DataFrame:
    """``docs`` without the rows that go.  ``rows`` (stashed): doc_id, key, kept,
    n (rows with both alike) of those that go and of those that repeat; rows are
    told apart by doc_id and ``key``, and of rows alike in both one stays."""
    losers, twice = (rows.where(test).select("doc_id", "key") for test in ("not kept", "kept and n > 1"))
    keyed = docs.withColumn(_KEY, key)
    if not twice.limit(1).count():
        return drop_ids(keyed, losers, ["doc_id", _KEY]).drop(_KEY)
    kept = drop_ids(keyed, losers.unionByName(twice), ["doc_id", _KEY])
    return kept.unionByName(keep_ids(keyed, twice, ["doc_id", _KEY]).dropDuplicates(["doc_id", _KEY])).drop(_KEY)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def unit_hash(col: Column, seed: int) -> Column:
    """A double in (0, 1) from 52 bits of md5; DuckDB can compute the same."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), col.cast("string")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


# ------------------------------------------------------------------- bytes
#: Text bytes that one numpy step takes; its temporaries are some 100 bytes each.
STEP = 1 << 19


def arrow_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "" if not pa.types.is_binary(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    bufs = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def segments(data: np.ndarray, offs: np.ndarray, most: int = STEP, hard: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of pieces of at most about ``most`` bytes, and the row of each.
    Longer rows are cut after the first white space beyond that; a run without
    any stays whole, or with ``hard`` is cut after four times as many bytes."""
    long = np.flatnonzero(np.diff(offs) > most)
    if not len(long):
        return offs, np.arange(len(offs) - 1)
    cuts, row, done = [offs[:1]], [], 0
    for r in long.tolist():
        cuts.append(offs[done + 1 : r + 1])
        row.append(np.arange(done, r))
        own, a, end = [], int(offs[r]), int(offs[r + 1])
        while end - a > most:
            stop = min(end, a + 4 * most) if hard else end
            cut, at = 0, a + most
            while not cut and at < stop:
                space = np.flatnonzero(_SPACE[data[at : min(at + 65536, stop)]])
                cut, at = (at + int(space[0]) + 1 if len(space) else 0), at + 65536
            a = cut or stop
            if a >= end:
                break
            own.append(a)
        cuts.append(np.array([*own, end], np.int64))
        row.append(np.full(len(own) + 1, r))
        done = r + 1
    cuts.append(offs[done + 1 :])
    row.append(np.arange(done, len(offs) - 1))
    return np.concatenate(cuts), np.concatenate(row)


def row_steps(offs: np.ndarray, most: int = STEP):
    """Ranges (i, j) of rows with at most ``most`` bytes, or one longer row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j
        i = j


_ODD = np.uint64(0x9E3779B97F4A7C15)
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)

#: Spans of more bytes are hashed one by one.
_LONG = 64


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (a bijection)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def eights(data: np.ndarray) -> np.ndarray:
    """At every byte, the number that it and the seven next ones are; zeros
    follow the last one.  A view, not a copy of each."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte spans; equal spans have equal hashes wherever they are.
    Every eight bytes go through a mixing step of their own, so no arrangement
    of letters makes hashes of different spans meet more often than chance."""
    view, left = eights(data), end - start
    out = left.astype(np.uint64) * _ODD
    todo, at = np.flatnonzero((left > 0) & (left <= _LONG)), 0
    while len(todo):
        rest = left[todo] - at
        out[todo] = mix(out[todo] * _ODD + (view[start[todo] + at] & _KEEP[np.minimum(rest, 8)]))
        todo, at = todo[rest > 8], at + 8
    far = np.flatnonzero(left > _LONG)
    if len(far):
        raw = memoryview(np.ascontiguousarray(data))
        out[far] = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(start[far].tolist(), end[far].tolist())], np.uint64)
    return out


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of the ``gram`` bytes from every byte on: len(data) - gram + 1."""
    m = max(0, len(data) - gram + 1)
    view = eights(data)
    out = np.full(m, np.uint64(gram))
    for at in range(0, gram, 8):
        out = out * _ODD + (view[at : at + m] & _KEEP[min(8, gram - at)])
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VISIBLE = ~_SPACE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def spans_of(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of the bytes marked ``inside`` that no row's
    end crosses, and the first run of each row (n + 1)."""
    n = len(inside)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    cut = np.zeros(n + 1, bool)  # a row starts here
    cut[offs] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last[:-1] &= ~inside[1:] | cut[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offs)


def word_hashes(data: np.ndarray, offs: np.ndarray, lower: bool = True, table: np.ndarray = _VISIBLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, A-Z lower-cased or not, and the first word of each
    row.  ``table``: for each byte, whether words hold it (never white space)."""
    start, end, first = spans_of(table[data], offs)
    return span_hashes(_LOWER[data] if lower else data, start, end), first


def word_rows(column, lower: bool = True, table: np.ndarray = _VISIBLE):
    """Word hashes of each text, and the range of rows, some rows at a time:
    (i, j, hashes, first word of each row)."""
    data, offs = arrow_bytes(column)
    cuts, row = segments(data, offs)
    if cuts is offs:
        for i, j in row_steps(offs):
            yield i, j, *word_hashes(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], lower, table)
        return
    last = np.searchsorted(row, np.arange(len(offs)))  # the first piece of each row
    for i, j in row_steps(offs):
        parts, firsts, n = [], [np.zeros(1, np.int64)], 0
        for a, b in row_steps(cuts[last[i] : last[j] + 1]):
            p, q = cuts[last[i] + a], cuts[last[i] + b]
            h, first = word_hashes(data[p:q], cuts[last[i] + a : last[i] + b + 1] - p, lower, table)
            parts.append(h)
            firsts.append(first[1:] + n)
            n += len(h)
        yield i, j, np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate(firsts)[last[i : j + 1] - last[i]]


def sliding_min(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every run of w keys (van Herk): len(keys) - w + 1 values."""
    n = len(keys)
    if n < w:
        return keys[:0]
    blocks = -(-n // w)
    full = np.full(blocks * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    full[:n] = keys
    grid = full.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with a function from one record batch to record batches."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(tidy(run), schema)


def tidy(run):
    """``run``, then what it leaves goes back to the system: idle workers are
    kept, and their memory counts against the executor's."""

    def then(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # not glibc
                pass

    return then


