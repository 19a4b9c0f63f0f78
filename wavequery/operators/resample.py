"""Resampling of frames by a polyphase windowed-sinc filter.

An output sample at input time t is the sum of the input samples around t, each
by a sinc that passes what both rates can hold, under a Hann window of ``ZEROS``
crossings a side.  Times repeat with the ratio's numerator, so the taps are a
table with a row for each phase.

A frame needs the edges of its two neighbours (the halo): frames hand them over
by their number, in one shuffle, so a clip is as many tasks' work as it has
frames.  The samples of a frame are cut where output frames end and meet there.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ZEROS = 16


def ratio(rate: int, target: int) -> tuple[int, int]:
    """Output samples for input samples, in lowest terms."""
    g = math.gcd(rate, target)
    return target // g, rate // g


def reach(rate: int, target: int) -> int:
    """Input samples on either side that an output sample needs."""
    return math.ceil(ZEROS * max(1.0, rate / target)) + 1


def taps(rate: int, target: int) -> np.ndarray:
    """A row for each phase: weights of the samples from ``reach - 1`` before the
    one at or before t to ``reach`` after it; rows add up to 1."""
    up, _ = ratio(rate, target)
    r, cut = reach(rate, target), min(1.0, target / rate)
    d = (np.arange(up) / up)[:, None] - np.arange(1 - r, r + 1)[None, :]
    h = np.where(np.abs(d) * cut < ZEROS, np.sinc(cut * d) * (1 + np.cos(np.pi * d * cut / ZEROS)), 0.0)
    return h / h.sum(1, keepdims=True)


def filtered(window: np.ndarray, first: int, n: np.ndarray, rate: int, target: int, table: np.ndarray) -> np.ndarray:
    """Output samples ``n`` from input samples of which ``window[0]`` is the
    ``first``."""
    up, down = ratio(rate, target)
    r = table.shape[1] // 2
    base, phase = n * down // up, n * down % up
    return (window[(base - first)[:, None] + np.arange(1 - r, r + 1)[None, :]] * table[phase]).sum(1)


def resample(frames: DataFrame, size: int, target: int) -> DataFrame:
    """clip_id, frame_idx and samples at the rate ``target``, ``size`` in a frame,
    from rows (clip_id, rate, length, frame_idx, samples); ``length``: samples of
    the clip.  Clips of that rate stay as they are; outside a clip is silence.
    Frames must be as long as the filter reaches."""
    clip = frames.schema["clip_id"].dataType.simpleString()
    most = F.ceil(ZEROS * F.greatest(F.lit(1.0), F.col("rate") / target)).cast("int") + 1
    halo = F.when(F.col("rate") == target, 0).when(most <= size, most).otherwise(F.raise_error(F.lit("frames are shorter than the filter")).cast("int"))
    edges = frames.withColumn("r", halo)
    n = F.size("samples")
    parts = F.array(
        F.struct(F.col("frame_idx").alias("f"), F.lit("own").alias("part"), F.col("samples").alias("x")),
        F.struct((F.col("frame_idx") + 1).alias("f"), F.lit("before").alias("part"), F.slice("samples", F.greatest(F.lit(1), n - F.col("r") + 1), F.col("r")).alias("x")),
        F.struct((F.col("frame_idx") - 1).alias("f"), F.lit("after").alias("part"), F.slice("samples", F.lit(1), F.col("r")).alias("x")),
    )
    moved = edges.select("clip_id", "rate", "length", F.explode(F.when(F.col("r") > 0, parts).otherwise(F.slice(parts, 1, 1))).alias("p")).select("clip_id", "rate", "length", "p.*")

    def of(part):
        return F.first(F.when(F.col("part") == part, F.col("x")), ignorenulls=True).alias(part)

    whole = moved.groupBy("clip_id", "rate", "length", "f").agg(of("own"), of("before"), of("after")).where("own is not null")

    def run(batches):
        tables: dict = {}

        def samples(rate, length, f, own, before, after):
            if rate == target:
                return f * size, own
            if rate not in tables:
                tables[rate] = taps(rate, target)
            r, (up, down) = reach(rate, target), ratio(rate, target)
            total = round(length * target / rate)
            first, last = -(-f * size * up // down), -(-(f + 1) * size * up // down)
            last = total if (f + 1) * size >= length else min(last, total)
            window = np.zeros(2 * r + size + 2)
            window[r - len(before) : r] = before
            window[r : r + len(own)] = own
            window[r + size : r + size + len(after)] = after
            return first, filtered(window, f * size - r, np.arange(first, last), rate, target, tables[rate])

        for batch in batches:
            own, before, after = (batch.column(c) for c in ("own", "before", "after"))
            at, frame, offset, out = [], [], [], []
            for i, (rate, length, f) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("rate", "length", "f")))):
                parts_ = [np.asarray(x[i].values, np.float64) if x[i].is_valid else np.zeros(0) for x in (own, before, after)]
                first, values = samples(rate, length, f, *parts_)
                for a in range(first // size, -(-(first + len(values)) // size)):
                    lo, hi = max(first, a * size), min(first + len(values), (a + 1) * size)
                    at.append(i)
                    frame.append(a)
                    offset.append(lo - a * size)
                    out.append(values[lo - first : hi - first])
            yield pa.RecordBatch.from_arrays([batch.column("clip_id").take(pa.array(at, pa.int32())), pa.array(frame, pa.int64()), pa.array(offset, pa.int32()), pa.array(out, pa.list_(pa.float64()))], ["clip_id", "frame_idx", "offset", "x"])

    pieces = whole.mapInArrow(run, f"clip_id {clip}, frame_idx long, offset int, x array<double>")
    joined = pieces.groupBy("clip_id", "frame_idx").agg(F.array_sort(F.collect_list(F.struct("offset", "x"))).alias("p"))  # some pieces a frame
    return joined.select("clip_id", "frame_idx", F.flatten(F.transform("p", lambda p: p["x"])).alias("samples"))
