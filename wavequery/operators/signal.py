"""Waveforms as frames: (clip_id, frame_idx, samples) of ``size`` samples each.

A clip is never one array: an hour at 16 kHz is 57.6 million samples.  Rows of
one frame index meet in equi-joins; sums over a clip are partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["clip_id", "frame_idx"]


def zeros(size: int) -> Column:
    return F.array_repeat(F.lit(0.0), size)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def energy(samples: Column) -> Column:
    return F.aggregate(samples, F.lit(0.0), lambda s, x: s + x * x)


def rms(frames: DataFrame) -> DataFrame:
    """Root mean square of each clip."""
    return frames.groupBy("clip_id").agg(F.sqrt(F.sum(energy(F.col("samples"))) / F.sum(F.size("samples"))).alias("rms"))


def peak(frames: DataFrame) -> DataFrame:
    return frames.groupBy("clip_id").agg(F.max(F.array_max(F.transform("samples", F.abs))).alias("peak"))


def normalise(frames: DataFrame) -> DataFrame:
    """Clips that pass 1.0 are scaled to a peak of 0.95, the others kept."""
    scale = peak(frames).select("clip_id", F.when(F.col("peak") > 1, 0.95 / F.col("peak")).otherwise(1.0).alias("scale"))
    return frames.join(scale, "clip_id").select(*KEY, F.transform("samples", lambda x: x * F.col("scale")).alias("samples"))


def place(frames: DataFrame, offset: Column, size: int, *keep: str) -> DataFrame:
    """Frames moved by ``offset`` samples: each falls on one or two frames of the
    output; equal frames of a clip add up.  ``keep``: more key columns."""
    start = F.col("frame_idx") * size + offset
    rows = frames.withColumn("_s", start).withColumn("_f", F.explode(F.sequence(F.floor(F.col("_s") / size), F.floor((F.col("_s") + F.size("samples") - 1) / size))))
    lag = (F.col("_s") - F.col("_f") * size).cast("int")  # of the frame's first sample in the output frame
    moved = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when((i >= lag) & (i - lag < F.size("samples")), F.get("samples", i - lag)).otherwise(0.0))
    rows = rows.select("clip_id", *keep, F.col("_f").cast("long").alias("frame_idx"), moved.alias("samples"))
    # Two frames of a clip at most meet in one.
    lists = rows.groupBy("clip_id", *keep, "frame_idx").agg(F.collect_list("samples").alias("l"))
    return lists.select("clip_id", *keep, "frame_idx", F.aggregate("l", zeros(size), add).alias("samples"))


def fitted(frames: DataFrame, n: int, size: int) -> DataFrame:
    """Clips cut, or continued by silence, to ``n`` samples."""
    last = -(-n // size) - 1
    index = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))).alias("frame_idx")
    rows = frames.select("clip_id").distinct().select("clip_id", index).join(frames, KEY, "left")
    length = F.when(F.col("frame_idx") == last, n - last * size).otherwise(size)
    whole = F.concat(F.coalesce("samples", F.array().cast("array<double>")), F.array_repeat(F.lit(0.0), size))
    return rows.select(*KEY, F.slice(whole, F.lit(1), length).alias("samples"))


def looped(frames: DataFrame, n: int, size: int) -> DataFrame:
    """Clips of any length repeated, or cut, to ``n`` samples."""
    length = frames.groupBy("clip_id").agg(F.sum(F.size("samples")).alias("_n"))
    rows = frames.join(length, "clip_id").where("_n > 0")
    turns = F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / F.col("_n")))
    rows = rows.withColumn("_t", F.explode(turns)).withColumn("_off", F.col("_t") * F.col("_n")).where(F.col("_off") + F.col("frame_idx") * size < n)
    return fitted(place(rows, F.col("_off"), size), n, size)


def mix_snr(background: DataFrame, foreground: DataFrame, at: Column, size: int, snr_db: float = 10.0) -> DataFrame:
    """The foreground added to the background from sample ``at`` (a column of
    the foreground, one value a clip), scaled to ``snr_db`` against the part of
    the background beneath; silence on either side leaves it unscaled.  A short
    background is continued by silence; frames that the foreground touches are
    whole, others as long as they were."""
    span = foreground.groupBy("clip_id").agg(F.min(at).alias("_at"), F.sum(F.size("samples")).alias("_len"), F.sum(energy(F.col("samples"))).alias("_fg"))
    placed = place(foreground, at, size).withColumnRenamed("samples", "fg")
    both = background.withColumnRenamed("samples", "bg").join(placed, KEY, "full_outer")
    own = F.coalesce(F.size("bg"), F.lit(0))
    both = both.withColumns({"_size": F.when(F.col("fg").isNull(), own).otherwise(size), "bg": F.slice(F.concat(F.coalesce("bg", F.array().cast("array<double>")), zeros(size)), 1, size), "fg": F.coalesce("fg", zeros(size))})
    both = both.join(span, "clip_id", "left")
    inside = F.zip_with("bg", F.sequence(F.lit(0), F.lit(size - 1)), lambda x, i: F.when((F.col("frame_idx") * size + i >= F.col("_at")) & (F.col("frame_idx") * size + i < F.col("_at") + F.col("_len")), x).otherwise(0.0))
    beneath = both.groupBy("clip_id").agg(F.sum(energy(inside)).alias("_bg"))
    ratio = 10 ** (snr_db / 20)
    scale = F.when((F.col("_bg") > 0) & (F.col("_fg") > 0), ratio * F.sqrt(F.col("_bg") / F.col("_fg"))).otherwise(1.0)
    return both.join(beneath, "clip_id").withColumn("_k", scale).select(*KEY, F.slice(F.zip_with("bg", "fg", lambda x, y: x + y * F.col("_k")), F.lit(1), F.col("_size")).alias("samples"))


def anih_audio(background: DataFrame, needle: DataFrame, at: Column, n: int, needle_n: int, size: int, snr_db: float = 10.0) -> DataFrame:
    """A background looped to ``n`` samples with a needle of ``needle_n`` samples
    from sample ``at`` on."""
    return mix_snr(looped(background, n, size), fitted(needle, needle_n, size), at, size, snr_db)


def narrative_audio(story: DataFrame, clue: DataFrame, at: Column, n: int, clue_n: int, size: int, snr_db: float = 5.0) -> DataFrame:
    """A story cut or continued to ``n`` samples with a clue from ``at`` on."""
    return mix_snr(fitted(story, n, size), fitted(clue, clue_n, size), at, size, snr_db)


def drift_audio(turns: DataFrame, speech: DataFrame, rate: int, size: int, seconds: float, fade_ms: float = 10.0) -> DataFrame:
    """The turns (instance_id, ord, speaker_id, start_s, end_s) of panels, each
    taken from its speaker's frames in ``speech`` (clip_id = speaker_id)."""
    segments = turns.select(
        F.col("instance_id").alias("clip_id"), "ord", F.col("speaker_id").alias("source"), F.floor(F.col("start_s") * rate).cast("long").alias("start"), F.floor(F.col("end_s") * rate).cast("long").alias("end")
    )
    return concatenate(segments, speech, size, -(-int(seconds * rate) // size), int(fade_ms * rate / 1000))


def soundscape_audio(background: DataFrame, events: DataFrame, at: Column, n_frames: int, size: int) -> DataFrame:
    """Events summed over a looped background, normalised."""
    return sum_events(looped(background, n_frames * size, size), events, at, size, n_frames)


def sum_events(background: DataFrame, events: DataFrame, at: Column, size: int, n_frames: int) -> DataFrame:
    """Background and placed events added and normalised; ``events`` have a
    column ``event`` besides those of frames."""
    rows = background.select(*KEY, "samples").unionByName(place(events, at, size, "event").select(*KEY, "samples")).where((F.col("frame_idx") >= 0) & (F.col("frame_idx") < n_frames))
    total = rows.groupBy(*KEY).agg(F.collect_list("samples").alias("l")).select(*KEY, F.aggregate("l", zeros(size), add).alias("samples"))
    return normalise(total)


def concatenate(segments: DataFrame, frames: DataFrame, size: int, n_frames: int, fade: int) -> DataFrame:
    """Segments (clip_id, ord, source, start, end in samples) of source clips
    (``frames``, clip_id = source) laid out in order of ``ord``: a segment that
    starts after 0 fades in over ``fade`` samples, after what lies in the
    ``fade`` samples before it was faded out; then it is added.  Sources are cut
    or continued by silence; a segment without length is skipped; the result is
    normalised.  Every output frame folds the few segments that touch it."""
    total = n_frames * size
    s = segments.withColumn("end", F.least("end", F.lit(total))).where("end > start")
    own = s.join(frames.withColumnRenamed("clip_id", "source"), "source")
    placed = place(own, F.col("start"), size, "ord", "start", "end")
    before = F.greatest(F.lit(0), F.col("start") - fade)
    touched = s.select("clip_id", "ord", "start", "end", F.explode(F.sequence(F.floor(before / size), F.floor((F.col("end") - 1) / size))).alias("frame_idx"))
    rows = touched.join(placed, ["clip_id", "ord", "start", "end", "frame_idx"], "left")
    rows = rows.withColumn("samples", F.coalesce("samples", zeros(size)))
    lists = rows.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("ord", "start", "end", "samples"))).alias("l"))

    def layer(acc: Column, x: Column) -> Column:
        ramp = F.least(F.lit(fade), x["end"] - x["start"])
        first = F.greatest(F.lit(0), x["start"] - fade)
        out = x["start"] - first  # samples that fade out

        def sample(pair: Column, i: Column) -> Column:
            p = F.col("frame_idx") * size + i
            faded = F.when((x["start"] > 0) & (p >= first) & (p < x["start"]), F.when(out > 1, 1 - (p - first) / (out - 1)).otherwise(1.0)).otherwise(1.0)
            rising = F.when((x["start"] > 0) & (p < x["start"] + ramp), F.when(ramp > 1, (p - x["start"]) / (ramp - 1)).otherwise(0.0)).otherwise(1.0)
            inside = (p >= x["start"]) & (p < x["end"])
            return pair["a"] * faded + F.when(inside, pair["b"] * rising).otherwise(0.0)

        pairs = F.zip_with(acc, x["samples"], lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.transform(pairs, sample)

    laid = lists.select(*KEY, F.aggregate("l", zeros(size), layer).alias("samples"))
    grid = segments.select("clip_id").distinct().withColumn("frame_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_frames - 1).cast("long"))))
    return normalise(grid.join(laid, KEY, "left").select(*KEY, F.coalesce("samples", zeros(size)).alias("samples")))


def samples(frames: DataFrame, size: int) -> DataFrame:
    """One row a sample, for small results."""
    rows = frames.select(*KEY, F.posexplode("samples").alias("i", "v"))
    return rows.select("clip_id", (F.col("frame_idx") * size + F.col("i")).cast("long").alias("pos"), "v")
