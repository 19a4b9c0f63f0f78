"""Timelines scored in batches against folds of each row, and what reports don't compute."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_core import scores
from wavequery import catalogue
from wavequery.functions import text, timelines
from wavequery.operators import aggregate, evaluators, multinomial
from wavequery.sources import fixtures

EVENTS = "array<struct<event_type:string,start:string,end:string,overlaps:string>>"
SCORES = [*evaluators.METRICS["soundscape"], "ordering_accuracy_strict"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def timeline(rng, n):
    def at(x):
        return rng.choice(["", None, "noise", "1:75", "ONGOING"]) if rng.random() < 0.1 else f"{x // 60:02d}:{x % 60:02d}"

    def event(x):
        kind = rng.choice(["rain", "Rain", "RAIN", "wind", "straße", "ΣΑΣ", "", None])
        return kind, at(x), rng.choice([at(x + rng.randint(-2, 40)), "ongoing"]), rng.choice(["", None, "wind", "rain, wind", "wind, rain, wind", ", "])

    return [None if rng.random() < 0.03 else event(rng.randint(0, 5 * n)) for _ in range(n)]


def test_batches_score_as_folds_do(spark):
    rng = random.Random(21)
    rows = [(i, timeline(rng, rng.choice([0, 1, 2, 3, 8, 40, 62])), timeline(rng, rng.choice([0, 1, 2, 3, 8, 40, 62]))) for i in range(500)]
    rows += [(-1, None, timeline(rng, 3)), (-2, timeline(rng, 3), None), (-3, None, None)]
    rows += [(1000 + i, x, x) for i, x in enumerate([timeline(rng, n) for n in (1, 3, 62)])]
    df = spark.createDataFrame(rows, f"i int, events {EVENTS}, true_events {EVENTS}")
    want = {r["i"]: tuple(r) for r in evaluators._score_soundscape(df, True).select("i", *SCORES).collect()}
    assert len(want) == len(rows) and sum(r[3] > 0 for r in want.values()) > 100 and any(r[3] != r[6] for r in want.values())
    assert {r["i"]: tuple(r) for r in evaluators.score_soundscape(df).select("i", *SCORES).collect()} == want


def test_parts_of_a_batch_match_as_the_whole(monkeypatch):
    rng = np.random.default_rng(23)
    n, true = rng.integers(0, 9, 300), rng.integers(0, 9, 300)
    s = rng.integers(0, 60, n.sum() + true.sum()).astype(float)
    kind, e, k = rng.integers(0, 3, len(s)), s + rng.integers(-2, 30, len(s)), rng.integers(0, 9, 300)
    a, b = rng.integers(0, 3, k.sum()), rng.integers(0, 3, k.sum())
    whole = timelines.matches(n, true, kind, s, e), timelines.common(k, a, b)
    monkeypatch.setattr(timelines, "CELLS", 50)
    assert (whole[0] == timelines.matches(n, true, kind, s, e)).all() and (whole[1] == timelines.common(k, a, b)).all() and (whole[0] >= 0).sum() > 100


def test_long_timelines_in_batches(spark):
    rng = random.Random(22)
    rows = [(i, [x for x in timeline(rng, rng.choice([3, 63, 90, 300])) if x and x[0] is not None], [x for x in timeline(rng, rng.choice([3, 62, 120])) if x and x[0] is not None]) for i in range(40)]
    df = spark.createDataFrame(rows, f"i int, events {EVENTS}, true_events {EVENTS}")
    a, b = ({r["i"]: tuple(r) for r in x.select("i", *SCORES).collect()} for x in (evaluators.score_soundscape(df), evaluators._score_soundscape(df, False)))
    assert all(a[i] == pytest.approx(b[i], abs=1e-12) for i in b) and len(a) == 40


def test_clock_reads_as_the_pattern_does(spark):
    odd = ["", ":", "1:2", "01:02", "-1:30", "+1:+2", "1:-0", " 1 : 2 ", " 1　: 2\x85", "1:2:3", "1:2x", "1:2.", "1:.5", "1:.", "1:2.50:x", "a1:2", "١:٢", "1​:2", "9223372036854775808:1", "1:2\n", "1.5:2", "00:99.25", "12:", ":30", "\x1c1:2"]
    df = spark.createDataFrame([(x,) for x in odd], "x string").select("x", text.seconds_or_zero(F.col("x")).alias("s"))
    assert {r["x"]: timelines.clock(r["x"]) for r in df.collect()} == {r["x"]: r["s"] for r in df.collect()}


def test_timelines_are_neither_folded_nor_read_twice(spark):
    """folds took most of the time; long and short ones were branches."""
    df = spark.createDataFrame([("1. Event: rain, Start: 00:01, End: 00:09", [("rain", "00:01", "00:09", "")])], f"response string, true_events {EVENTS}")
    text_ = plan(evaluators.score_soundscape(df))
    assert "aggregate(" not in text_ and "Union" not in text_ and text_.count("Scan ") == 1


def test_timelines_are_gathered_once(spark):
    assert plan(fixtures.soundscape(spark, "/root/testdata/sf0.001")).count("partial_collect_list(") == 1


def test_reports_of_means_select_no_medians(spark, monkeypatch):
    """nor do they write a table of all values."""
    kept, real = [], aggregate.keep
    monkeypatch.setattr(aggregate, "keep", lambda df, name: kept.append(name) or real(df, name))
    assert catalogue.QUERIES["radar_matrix"](spark, "/root/testdata/sf0.001").count() == 4
    assert kept == ["means"]


def test_means_are_those_of_the_summary(spark):
    df = scores(spark, [0.1] * 7, "same").unionByName(scores(spark, [1.0, None, 0.25, 3.5], "some")).unionByName(scores(spark, [None, None], "none"))
    want = {r["metric"]: r["mean"] for r in aggregate.summarise(df).collect()}
    got = {r["metric"]: r["mean"] for r in aggregate.means(df).collect()}
    assert got == pytest.approx(want) and got["same"] == 0.1 and got["none"] == 0.0
    counted = df.groupBy(*aggregate.KEYS, "value").agg(F.count(F.lit(1)).alias("c"))
    assert {r["metric"]: r["mean"] for r in aggregate.means(counted).collect()} == pytest.approx(want)


def test_details_select_no_medians(spark, monkeypatch):
    """mean and std need none."""
    monkeypatch.setattr(aggregate, "_medians", lambda *a: pytest.fail("medians"))
    assert catalogue.QUERIES["detail_table"](spark, "/root/testdata/sf0.001").count() == 20


def test_bins_are_found_by_halving(spark, monkeypatch):
    """comparing a value with each cut took most of the selection."""
    kept, real = [], aggregate.keep
    monkeypatch.setattr(aggregate, "keep", lambda df, name: kept.append(plan(df)) or real(df, name))
    values = [float(x % 97) for x in range(400)] + [1e9, -1e9]
    rows = spark.createDataFrame([("t", "m", "x", v, 1, 99) for v in sorted(set(values))], "task string, model string, metric string, value double, c long, k long")
    for bins in (2, 3, 8, 64):
        assert [r["median"] for r in aggregate._medians(rows, 10, bins).collect()] == [48.0]
    assert len(kept) > 4 and not any("filter(cuts" in x for x in kept)


def test_open_draws_move_together(monkeypatch):
    """draws of one word and of several; no step is given a draw that is done."""
    steps, real = [], multinomial.halves
    monkeypatch.setattr(multinomial, "halves", lambda seed, draws, step: steps.append(int(draws.min())) or real(seed, draws, step))
    seeds = multinomial.replicate_seeds(7, 0, 40)
    got = dict(multinomial.deal(seeds, np.full(40, 300), np.array([100, 0, 70, 1, 129]), 1))
    assert (sum(got.values()) == 300).all() and not got[1].any() and all(least > 0 for least in steps)
    ones = [real(seeds, np.full(40, n), 3) for n in (1, 64, 65, 129, 1000)]
    assert all((x >= 0).all() and (x <= n).all() for x, n in zip(ones, (1, 64, 65, 129, 1000))) and abs(ones[-1].mean() - 500) < 20


def test_timelines_are_shuffled_once(spark, tmp_path):
    """lists of events were shuffled again, by strings.  Events without a user or
    time meet as they did."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    odd = events.where("event_id < 40").withColumns({"ts": F.when(F.col("event_id") % 3 > 0, F.col("ts")), "user_id": F.when(F.col("event_id") % 3 < 2, F.col("user_id")), "event_id": -F.col("event_id") - 1})
    many = events.where("event_id < 30").withColumns({"user_id": F.lit(7).cast("long"), "event_id": F.col("event_id") + 1000})
    events.unionByName(odd).unionByName(many).write.parquet(f"{tmp_path}/events.parquet")
    got = fixtures.soundscape(spark, str(tmp_path))
    assert plan(got).count("Exchange ") == 1
    rows = fixtures.table(spark, str(tmp_path), fixtures.SOUNDSCAPE)
    event = F.struct("ord", F.struct("event_type", "start_ts", "end_ts", "overlap_names").alias("e"), "line")
    want = rows.groupBy("instance_id", "model").agg(F.array_sort(F.collect_list(event)).alias("t"))
    want = {(r["instance_id"], r["model"]): ([tuple(x["e"]) for x in r["t"]], "\n".join(x["line"] for x in r["t"] if x["line"] is not None)) for r in want.collect()}
    assert {(r["instance_id"], r["model"]): ([tuple(x) for x in r["true_events"]], r["response"]) for r in got.collect()} == want
    assert got.count() == len(want) and sum(len(x) for x, _ in want.values()) == 1070 + events.count() - 1000 and (None, None) in want and (None, "m0") in want


def test_timelines_stay_in_many_parts(spark):
    """few bytes a row, so they were joined into one task a core, uneven ones."""
    got = fixtures.soundscape(spark, "/root/testdata/sf0.001")
    assert got.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
