"""Seeded task instances: ``range`` and hash choices, joined to clip tables.

Row i of a task is the same in every run and partitioning: each choice is drawn
from the md5 of (task, seed, i, purpose).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.choice import below, draw, one_of, uniform
from ..functions.text import mmss
from ..plans.tasks import AnihConfig, DriftConfig, NarrativeConfig, SoundscapeConfig, prompt


def instance_id(task: str, *key: Column) -> Column:
    """task_<8 hex digits>, from the key instead of a random uuid."""
    text = F.concat_ws(":", F.lit(task), *[k.cast("string") for k in key])
    return F.concat(F.lit(task + "_"), F.substring(F.md5(text.cast("binary")), 1, 8))


#: Parts in which the rows of a key are numbered.
PARTS = 1024


def _numbered(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows numbered from 0 within keys (k), with the number of rows (n).  Rows are
    dealt to PARTS by the hash of ``order``, numbered there, and moved on by the
    sizes of the parts before, so no task has all rows of a key."""
    rows = df.withColumn("_part", draw(F.col(order)) % PARTS)
    sizes, own = rows.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_c")), Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_c").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*keys, "_part", before.alias("_before"), F.sum("_c").over(own).alias("n"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(order)) - 1).join(sizes, [*keys, "_part"])
    return rows.withColumn("k", F.col("k") + F.col("_before")).drop("_part", "_before")


def _distinct_picks(n: Column, k: int, *key: Column | str) -> Column:
    """k different numbers below n: the j-th is drawn from what n - j numbers are
    left, and moved past the smaller ones that were taken."""

    def pick(taken: Column, j: Column) -> Column:
        x = F.aggregate(F.array_sort(taken), draw(*key, j) % (n - j), lambda x, t: x + (t <= x).cast("bigint"))
        return F.concat(taken, F.array(x))

    return F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.array().cast("array<bigint>"), pick)


def anih(spark: SparkSession, clips: DataFrame, n: int, seed: int = 0, config: AnihConfig = AnihConfig()) -> DataFrame:
    """Needle instances.  ``clips``: kind (background, needle), category, path;
    an instance whose clips are missing is left out."""
    i, key = F.col("i"), ("anih", F.lit(seed), F.col("i"))
    depth = one_of([float(x) for x in config.insertion_depths], *key, "depth") if config.insertion_depths else uniform(30, config.background_duration - 30, *key, "depth")
    rows = spark.range(n).select(F.col("id").alias("i")).select("i", one_of(config.background_sources, *key, "source").alias("background_source"), one_of(config.needle_types, *key, "needle").alias("needle_type"), depth.alias("at"), draw(*key, "clip").alias("pick"))
    backgrounds = _numbered(clips.where("kind = 'background'"), ["category"], "path").select(F.col("category").alias("background_source"), F.col("path").alias("background_path"), "k", "n")
    sizes = clips.where("kind = 'background'").groupBy(F.col("category").alias("background_source")).agg(F.count(F.lit(1)).alias("n"))
    needles = clips.where("kind = 'needle'").groupBy(F.col("category").alias("needle_type")).agg(F.min("path").alias("needle_path"))
    rows = rows.join(sizes, "background_source").withColumn("k", F.col("pick") % F.col("n")).drop("n")
    rows = rows.join(backgrounds.drop("n"), ["background_source", "k"]).join(needles, "needle_type")
    labels = F.create_map(*[F.lit(x) for kv in config.preceding_sounds.items() for x in kv])
    return rows.select(
        "i",
        instance_id("anih", F.lit(seed), i).alias("instance_id"),
        "needle_type",
        "background_source",
        "background_path",
        "needle_path",
        F.col("at").alias("needle_timestamp_seconds"),
        mmss(F.col("at")).alias("needle_timestamp"),
        F.coalesce(F.try_element_at(labels, F.col("background_source")), F.lit("ambient noise")).alias("preceding_sound"),
        F.lit(config.snr_db).alias("snr_db"),
        prompt("anih", needle_type=F.replace(F.col("needle_type"), F.lit("_"), F.lit(" "))).alias("prompt"),
    )


def drift(spark: SparkSession, speakers: DataFrame, n: int, seed: int = 0, config: DriftConfig = DriftConfig()) -> DataFrame:
    """Panel instances with their speakers in order.  ``speakers``: dataset,
    speaker_id.  A dataset with too few speakers yields none; of the others a row
    an instance and place is drawn by number and joined."""
    key = ("speaker_drift", F.lit(seed), F.col("i"))
    rows = spark.range(n).select(F.col("id").alias("i")).withColumn("dataset", one_of(config.dataset_sources, *key, "dataset"))
    sizes = speakers.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= config.num_speakers)
    picks = _distinct_picks(F.col("n"), config.num_speakers, *key, F.lit("speaker"))
    rows = rows.join(sizes, "dataset").select("i", "dataset", F.posexplode(picks).alias("ord", "k"))
    picked = rows.join(_numbered(speakers, ["dataset"], "speaker_id").select("dataset", "k", "speaker_id"), ["dataset", "k"])
    lists = picked.groupBy("i", "dataset").agg(F.array_sort(F.collect_list(F.struct("ord", "speaker_id"))).alias("s"))
    return lists.select(
        "i",
        instance_id("speaker_drift", F.lit(seed), F.col("i")).alias("instance_id"),
        "dataset",
        F.transform("s", lambda x: x["speaker_id"]).alias("speaker_order"),
        F.lit(config.target_speaker_id + 1).alias("target_speaker_id"),
        mmss(F.lit(config.initial_speech_duration / 2)).alias("first_appearance_timestamp"),
        mmss(F.lit(config.final_speech_time)).alias("target_return_timestamp"),
        prompt("speaker_drift", duration_minutes=F.lit(int(config.total_duration / 60)), num_speakers=F.lit(config.num_speakers), target_timestamp=mmss(F.lit(config.final_speech_time))).alias("prompt"),
    )


def turns(instances: DataFrame, seed: int = 0, config: DriftConfig = DriftConfig()) -> DataFrame:
    """The turns of each panel: equal first turns of all speakers, equal middle
    turns of speakers other than the target, the target's return."""
    c, first = config, config.initial_speech_duration / config.num_speakers
    rest = c.final_speech_time - c.initial_speech_duration
    middle = max(10, int(rest / 60))
    others = [k for k in range(c.num_speakers) if k != c.target_speaker_id]
    rows = instances.select("i", "instance_id", "speaker_order", F.explode(F.sequence(F.lit(0), F.lit(c.num_speakers + middle))).alias("ord"))
    k, j = F.col("ord"), F.col("ord") - c.num_speakers
    start, end = k < c.num_speakers, k == c.num_speakers + middle
    who = F.when(start, k).when(end, c.target_speaker_id).otherwise(one_of(others, "turns", F.lit(seed), F.col("i"), k))
    begin = F.when(start, k * first).when(end, c.final_speech_time).otherwise(c.initial_speech_duration + j * (rest / middle))
    length = F.when(start, first).when(end, c.final_speech_duration).otherwise(rest / middle)
    return rows.select("instance_id", "ord", who.alias("speaker_idx"), F.get("speaker_order", who).alias("speaker_id"), begin.alias("start_s"), (begin + length).alias("end_s"), F.when(start, "initial").when(end, "target_return").otherwise("middle").alias("kind"))


def timelines(spark: SparkSession, n: int, seed: int = 0, config: SoundscapeConfig = SoundscapeConfig()) -> DataFrame:
    """Event rows of soundscapes: a weather event first, whose successor starts
    after 0.3 of it; then others without replacement, one after the other, until
    the end; some name one of the three events before as overlapping."""
    c, s = config, F.lit(seed)
    kinds = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(e).alias("event_type"), F.lit(e.startswith(("rain", "wind", "thunder"))).alias("weather")) for i, e in enumerate(c.event_types)])
    rows = spark.range(n).select(F.col("id").alias("i"), F.explode(kinds).alias("e")).select("i", "e.*")
    rows = rows.withColumn("lot", draw("soundscape", s, F.col("i"), F.col("t")))
    own = Window.partitionBy("i")
    by_lot = own.orderBy(F.desc("weather"), "lot", "t")
    rows = rows.withColumn("ord", F.when(F.row_number().over(by_lot) == 1, 0))
    rows = rows.withColumn("ord", F.coalesce("ord", F.row_number().over(own.orderBy(F.col("ord").isNotNull(), "lot", "t")))).withColumn("ord", F.col("ord").cast("int"))
    count = c.num_events - 2 + below(5, "soundscape", s, F.col("i"), "count")
    rows = rows.where(F.col("ord") < count).withColumn("length", uniform(c.min_event_duration, c.max_event_duration, "soundscape", s, F.col("i"), F.col("t"), "length"))
    step = F.when(F.col("ord") == 0, 0.3 * F.col("length")).otherwise(F.col("length"))
    ahead = own.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start_s", F.coalesce(F.sum(step).over(ahead), F.lit(0.0))).where(F.col("start_s") < c.duration)
    before = F.collect_list(F.struct("event_type", "start_s")).over(own.orderBy("ord").rowsBetween(-3, -1))
    rows = rows.withColumn("recent", before)
    end = F.least(F.col("start_s") + F.col("length"), F.lit(c.duration))
    pick = F.get("recent", (below(F.greatest(F.size("recent"), F.lit(1)), "soundscape", s, F.col("i"), F.col("t"), "which")).cast("int"))
    named = F.lit(c.overlap_allowed) & (F.size("recent") > 0) & (below(100, "soundscape", s, F.col("i"), F.col("t"), "overlap") < 40)
    overlaps = F.when(named, F.concat(pick["event_type"], F.lit(" (from "), mmss(pick["start_s"]), F.lit(")"))).otherwise("")
    return rows.select("i", "ord", "event_type", "start_s", end.alias("end_s"), mmss(F.col("start_s")).alias("start"), F.when(end < c.duration, mmss(end)).otherwise("ongoing").alias("end"), overlaps.alias("overlaps"))


def soundscape(spark: SparkSession, n: int, seed: int = 0, config: SoundscapeConfig = SoundscapeConfig(), clips: DataFrame | None = None) -> DataFrame:
    """Soundscape instances: events sorted by their printed start; one of the
    background clips (kind, path), if there are any."""
    event = F.struct(F.floor("start_s").alias("s"), "ord", F.struct("event_type", "start", "end", "overlaps").alias("e"))
    lists = timelines(spark, n, seed, config).groupBy("i").agg(F.array_sort(F.collect_list(event)).alias("l"))
    if clips is None:
        lists = lists.withColumn("background_path", F.lit(None).cast("string"))
    else:
        numbered = _numbered(clips.where("kind = 'background'").select("kind", "path"), ["kind"], "path").select("k", F.col("path").alias("background_path"))
        size = clips.where("kind = 'background'").agg(F.count(F.lit(1)).alias("_n"))
        lists = lists.join(size).withColumn("k", F.when(F.col("_n") > 0, draw("soundscape", F.lit(seed), F.col("i"), "background") % F.col("_n")))
        lists = lists.join(numbered, "k", "left")
    events = F.transform("l", lambda x: x["e"])
    return lists.select("i", instance_id("soundscape", F.lit(seed), F.col("i")).alias("instance_id"), events.alias("events"), "background_path", F.lit(config.duration).alias("duration"), F.size("l").alias("num_events"), prompt("soundscape", duration_minutes=F.lit(int(config.duration / 60))).alias("prompt"))


def narrative(spark: SparkSession, clues: DataFrame, n: int, seed: int = 0, config: NarrativeConfig = NarrativeConfig()) -> DataFrame:
    """Story instances.  ``clues``: category, path; others are left out."""
    key = ("narrative_coherence", F.lit(seed), F.col("i"))
    rows = spark.range(n).select(F.col("id").alias("i")).withColumn("clue_type", one_of(config.clue_types, *key, "clue"))
    rows = rows.join(clues.groupBy(F.col("category").alias("clue_type")).agg(F.min("path").alias("clue_path")), "clue_type")
    for name, low, high in (("a", 0.05, 0.15), ("b", 0.35, 0.55), ("c", 0.80, 0.95)):
        rows = rows.withColumn(f"clue_{name}_timestamp_seconds", uniform(low, high, *key, name) * config.duration)
    rows = rows.withColumns({f"clue_{x}_timestamp": mmss(F.col(f"clue_{x}_timestamp_seconds")) for x in "abc"})
    clue = F.replace(F.col("clue_type"), F.lit("_"), F.lit(" "))
    steps = F.array(
        F.concat(F.lit("Identify the "), clue, F.lit(" at "), "clue_a_timestamp"),
        F.concat(F.lit("Note the character's reference to the "), clue, F.lit(" at "), "clue_b_timestamp"),
        F.concat(F.lit("Compare suspect's alibi at "), "clue_c_timestamp", F.lit(" with acoustic evidence")),
    )
    return rows.select(
        "i",
        instance_id("narrative_coherence", F.lit(seed), F.col("i")).alias("instance_id"),
        "clue_type",
        "clue_path",
        one_of(["Validates", "Debunks"], *key, "verdict").alias("correct_verdict"),
        *[f"clue_{x}_timestamp" for x in "abc"],
        *[f"clue_{x}_timestamp_seconds" for x in "abc"],
        F.array(*[f"clue_{x}_timestamp" for x in "abc"]).alias("key_timestamps"),
        steps.alias("required_reasoning_steps"),
        prompt("narrative_coherence", duration_minutes=F.lit(int(config.duration / 60))).alias("prompt"),
    )
