"""Per-task scores: one wide row per answer, all of it in one projection.

An error that has no value (a timestamp is missing) is NULL here, so that
aggregates leave it out; sinks write it as infinity.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import greedy_match, lcs_length, pinned, temporal_iou, timed
from ..functions.text import anih_answer, drift_answer, narrative_answer, seconds, soundscape_answer, step_matches, step_words, word_jaccard, words
from ..functions.timelines import shared

METRICS = {
    "anih": ["timestamp_error_seconds", "timestamp_hit_1s", "timestamp_hit_5s", "preceding_sound_iou", "composite_score"],
    "speaker_drift": ["speaker_accuracy", "appearance_error_seconds", "appearance_hit_5s", "joint_accuracy"],
    "soundscape": ["event_f1", "timeline_iou", "ordering_accuracy", "overlap_detection_f1", "composite_score"],
    "narrative_coherence": ["verdict_accuracy", "reasoning_completeness", "timestamp_citation_precision", "timestamp_citation_recall", "timestamp_citation_f1", "composite_score"],
}

#: The metric that ranks models on each task.
PRIMARY = {"anih": "composite_score", "speaker_drift": "joint_accuracy", "soundscape": "composite_score", "narrative_coherence": "composite_score"}


def flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def harmonic(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def score_anih(df: DataFrame) -> DataFrame:
    """Adds scores to rows with response, needle_timestamp and gt_sound."""
    df = pinned(df, a=anih_answer(F.col("response")))
    given = (F.col("a.timestamp") != "") & (F.col("needle_timestamp") != "")
    error = F.when(given, F.abs(seconds(F.col("a.timestamp")) - seconds(F.col("needle_timestamp"))))
    df = df.withColumns({"timestamp_error_seconds": error, "preceding_sound_iou": word_jaccard(F.col("a.preceding_sound"), F.col("gt_sound"))})
    e = F.col("timestamp_error_seconds")
    df = df.withColumns({"timestamp_hit_1s": flag(e <= 1), "timestamp_hit_5s": flag(e <= 5)})
    return df.withColumn("composite_score", 0.7 * F.col("timestamp_hit_5s") + 0.3 * F.col("preceding_sound_iou")).drop("a")


def score_drift(df: DataFrame) -> DataFrame:
    """Adds scores to rows with response, target_speaker_id and
    first_appearance_timestamp (NULL: the speaker had not spoken)."""
    df = pinned(df, a=drift_answer(F.col("response")))
    said, true = F.col("a.first_appearance"), F.col("first_appearance_timestamp")
    error = F.when((said != "") & (true != ""), F.abs(seconds(said) - seconds(true))).when(said.isNull() & true.isNull(), 0.0)
    df = df.withColumns({"speaker_accuracy": flag(F.col("a.predicted_speaker").eqNullSafe(F.col("target_speaker_id"))), "appearance_error_seconds": error})
    df = df.withColumn("appearance_hit_5s", flag(F.col("appearance_error_seconds") <= 5))
    return df.withColumn("joint_accuracy", F.col("speaker_accuracy") * F.col("appearance_hit_5s")).drop("a")


def match_events(df: DataFrame, short: bool = False) -> DataFrame:
    """Adds to rows with ``events`` (or response) and true_events both sides with
    seconds, p and t, the matches m of p, and the matched ``pairs`` (p, t) in order
    of p.  ``short``: no side is longer than what is folded."""
    if "events" not in df.columns:
        df = df.withColumn("events", soundscape_answer(F.col("response")))
    df = pinned(df, p=timed(F.col("events")), t=timed(F.col("true_events")))
    df = pinned(df, m=greedy_match(F.col("p"), F.col("t"), short))
    pairs = F.filter(F.transform("m", lambda j, i: F.struct(i.alias("i"), j.alias("j"))), lambda x: x["j"] >= 0)
    return pinned(df, pairs=F.transform(pairs, lambda x: F.struct(F.get("p", x["i"]).alias("p"), F.get("t", x["j"]).alias("t"))))


def types_of_pairs() -> tuple[Column, Column, Column]:
    """Types of the ``pairs``: predicted, true, and true in order of time."""
    by_time = F.transform(F.array_sort(F.transform("pairs", lambda x, i: F.struct(x["t"]["s"].alias("s"), i.alias("i"), x["t"]["event_type"].alias("e")))), lambda x: x["e"])
    return F.transform("pairs", lambda x: x["p"]["event_type"]), F.transform("pairs", lambda x: x["t"]["event_type"]), by_time


def score_soundscape(df: DataFrame) -> DataFrame:
    """Adds scores to rows with response (or ``events``, already parsed) and
    true_events.  Without true events the last two metrics are NULL.
    ``ordering_accuracy_strict`` orders the matched true events by time."""
    if "events" not in df.columns:
        df = pinned(df, events=soundscape_answer(F.col("response")))
    df = pinned(df, m=shared(F.col("events"), F.col("true_events")))
    sums = {c: F.col("m")[c] for c in ("k", "iou", "overlaps", "lcs", "strict")}
    return _timeline_scores(df, F.size("events"), F.size("true_events"), **sums).drop("m")


def _score_soundscape(df: DataFrame, short: bool) -> DataFrame:
    """The same by folds of each row: what ``timelines`` is checked against."""
    df = match_events(df, short)
    iou = F.transform("pairs", lambda x: temporal_iou(x["p"]["s"], x["p"]["e"], x["t"]["s"], x["t"]["e"]))

    def named(c: Column) -> Column:
        return F.coalesce(c != "", F.lit(False))

    def overlap(x: Column) -> Column:
        a, b = x["p"]["overlaps"], x["t"]["overlaps"]
        both = F.when(named(a), F.size(F.array_intersect(F.split(a, ", "), F.split(b, ", ")))).otherwise(0)
        return F.when(named(b), both / F.size(F.array_distinct(F.split(b, ", ")))).otherwise(flag(~named(a)))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

    p_types, t_types, by_time = types_of_pairs()
    lcs, strict = lcs_length(p_types, t_types, short), lcs_length(p_types, by_time, short)
    df = _timeline_scores(df, F.size("p"), F.size("t"), F.size("pairs"), total(iou), total(F.transform("pairs", overlap)), lcs, strict)
    return df.drop("p", "t", "m", "pairs")


def _timeline_scores(df: DataFrame, n: Column, true: Column, k: Column, iou: Column, overlaps: Column, lcs: Column, strict: Column) -> DataFrame:
    """Scores from what timelines share (``timelines.shared``)."""
    some = true > 0
    df = df.withColumns(
        {
            "event_f1": F.when(some, harmonic(ratio(k, n), ratio(k, true))).otherwise(0.0),
            "timeline_iou": F.when(some, ratio(iou, k)).otherwise(0.0),
            "ordering_accuracy": F.when(some, ratio(lcs, k)).otherwise(0.0),
            "ordering_accuracy_strict": F.when(some, ratio(strict, k)).otherwise(0.0),
            "overlap_detection_f1": F.when(some, ratio(overlaps, k)),
        }
    )
    weights = (("event_f1", 0.3), ("timeline_iou", 0.3), ("ordering_accuracy", 0.2), ("overlap_detection_f1", 0.2))
    return df.withColumn("composite_score", reduce(lambda a, b: a + b, [w * F.col(c) for c, w in weights]))


def score_narrative(df: DataFrame) -> DataFrame:
    """Adds scores to rows with response, correct_verdict, key_timestamps and
    required_reasoning_steps."""
    df = pinned(df, a=narrative_answer(F.col("response")))
    # The words of each step are split off once, not in each pair of steps.
    said, true = F.transform("a.reasoning_steps", words), F.transform("required_reasoning_steps", step_words)
    df = pinned(df, said=said, true=true, cited=F.array_distinct(F.col("a.cited_timestamps")), keys=F.array_distinct(F.col("key_timestamps")))
    true, cited, keys = F.col("true"), F.col("cited"), F.col("keys")
    hits = F.filter(true, lambda t: F.exists("said", lambda p: step_matches(p, t)))
    common = F.size(F.array_intersect(cited, keys))
    df = df.withColumns(
        {
            "verdict_accuracy": flag(F.col("a.verdict").eqNullSafe(F.col("correct_verdict"))),
            "reasoning_completeness": ratio(F.size(hits), F.size(true)),
            "timestamp_citation_precision": F.when(F.size(keys) > 0, ratio(common, F.size(cited))).otherwise(0.0),
            "timestamp_citation_recall": ratio(common, F.size(keys)),
        }
    )
    df = df.withColumn("timestamp_citation_f1", harmonic(F.col("timestamp_citation_precision"), F.col("timestamp_citation_recall")))
    composite = 0.4 * F.col("verdict_accuracy") + 0.4 * F.col("reasoning_completeness") + 0.2 * F.col("timestamp_citation_f1")
    return df.withColumn("composite_score", composite).drop("a", "said", "true", "cited", "keys")


SCORE = {"anih": score_anih, "speaker_drift": score_drift, "soundscape": score_soundscape, "narrative_coherence": score_narrative}


#: What a score of each task is made of.
SCORED = {
    "anih": ["response", "needle_timestamp", "gt_sound"],
    "speaker_drift": ["response", "target_speaker_id", "first_appearance_timestamp"],
    "soundscape": ["response", "true_events"],
    "narrative_coherence": ["response", "correct_verdict", "key_timestamps", "required_reasoning_steps"],
}


def counted_scores(answers: DataFrame, task: str, names: list[str] | None = None) -> DataFrame:
    """(task, model, metric, value, c): the scores ``names`` (all, if None) of
    unscored rows, c of them equal.

    Rows of a model that are alike in all that is scored are one, so an answer is
    parsed once, however often it was given, and after a shuffle: by all tasks,
    however few the input was read by.  Timelines are whole columns of events,
    next to never alike, and are scored as they come."""
    names = METRICS[task] if names is None else names
    rows = answers.select("model", *SCORED[task])
    rows = rows.withColumn("c", F.lit(1).cast("long")) if task == "soundscape" else rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("c"))
    wide = SCORE[task](rows).select(F.lit(task).alias("task"), "model", "c", *[F.col(n).cast("double").alias(n) for n in names])
    return wide.unpivot(["task", "model", "c"], names, "metric", "value").select("task", "model", "metric", "value", "c")


def long_scores(scored: DataFrame, task: str, instance: str) -> DataFrame:
    """(task, model, instance_id, metric, value) of scored rows."""
    names = METRICS[task]
    wide = scored.select(F.lit(task).alias("task"), "model", F.col(instance).cast("string").alias("instance_id"), *[F.col(n).cast("double").alias(n) for n in names])
    return wide.unpivot(["task", "model", "instance_id"], names, "metric", "value")
