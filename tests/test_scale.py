"""Groups, keys and sequences that are large: bounds of what a task holds."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_core import greedy, lcs, scores
from wavequery.functions import intervals, text
from wavequery.operators import aggregate, evaluators, multinomial, report, sweep, weights


# ------------------------------------------------------------------ medians
@pytest.mark.parametrize("outlier", [1e15, -1e300])
def test_median_beside_an_outlier_sorts_few_values(spark, outlier):
    rng = random.Random(1)
    values = [rng.random() for _ in range(6000)] + [outlier] + [0.25] * 700
    df = scores(spark, values).unionByName(scores(spark, [3.0, None, 1.0], "other"))
    want = float(np.median(values))
    r = {r["metric"]: r for r in aggregate.summarise(df).collect()}
    assert r["composite_score"]["median"] == want and r["other"]["median"] == 2.0
    equal = df.where("value is not null").groupBy(*aggregate.KEYS, "value").agg(F.count(F.lit(1)).alias("c"))
    sizes = equal.groupBy(*aggregate.KEYS).agg(F.sum("c").alias("k"))
    rows = equal.join(sizes, aggregate.KEYS)
    left = aggregate.selected(rows, leaf=50, bins=8)
    assert left.groupBy(*aggregate.KEYS).count().agg(F.max("count")).first()[0] <= 50
    assert {r["metric"]: r["median"] for r in aggregate._medians(rows, 50, 8).collect()} == {"composite_score": want, "other": 2.0}


def test_selection_of_even_counts_at_random(spark):
    rng = random.Random(2)
    groups = {f"g{i}": [rng.choice([rng.random(), rng.randint(0, 3), rng.random() * 10 ** rng.randint(-9, 9)]) for _ in range(rng.choice([1, 2, 30, 31, 200]))] for i in range(12)}
    df = spark.createDataFrame([("t", "m", g, v, 1, len(x)) for g, x in groups.items() for v in map(float, x)], "task string, model string, metric string, value double, c long, k long")
    df = df.groupBy(*aggregate.KEYS, "value", "k").agg(F.sum("c").alias("c"))
    got = {r["metric"]: r["median"] for r in aggregate._medians(df, 4, 3).collect()}
    assert got == pytest.approx({g: float(np.median(x)) for g, x in groups.items()})


# ---------------------------------------------------------------- bootstrap
@pytest.mark.parametrize("leaf", [4096, 3])
def test_draws_are_multinomial(spark, leaf):
    """Also over several buckets: how often a value is drawn, told by its mark."""
    weights = [1, 5, 30, 64, 100, 7, 1]
    n, p = sum(weights), weights[3] / sum(weights)
    df = spark.createDataFrame([(1_000_000 if k == 3 else k, w) for k, w in enumerate(weights)], "q long, c long")
    rows = multinomial.sums(df, F.lit(12345).cast("long"), 600, leaf).collect()
    times = np.array([r["total"] for r in sorted(rows, key=lambda r: r["rep"])]) // 1_000_000
    assert len(times) == 600 and abs(times.mean() - n * p) < 5 * np.sqrt(n * p * (1 - p) / 600)
    assert times.var() == pytest.approx(n * p * (1 - p), rel=0.35)


def test_every_replicate_deals_all_draws():
    seeds = multinomial.replicate_seeds(99, 0, 300)
    weights = np.array([3, 1, 1000, 20, 5, 64])
    got = dict(multinomial.deal(seeds, np.full(300, weights.sum()), weights, 1))
    table = np.array([got[k] for k in range(len(weights))])
    assert (table.sum(0) == weights.sum()).all() and (table >= 0).all()
    assert table.mean(1) == pytest.approx(weights, rel=0.2, abs=0.4)


def test_interval_does_not_depend_on_partitioning(spark):
    rng = random.Random(3)
    df = scores(spark, [rng.random() for _ in range(300)])
    a, b = (aggregate.bootstrap(x, 300, leaf=16).first() for x in (df, df.repartition(7)))
    assert (a["ci_lo"], a["ci_hi"], a["n"]) == (b["ci_lo"], b["ci_hi"], b["n"])
    c = aggregate.poisson_bootstrap(df, 2000).first()
    assert (a["ci_lo"], a["ci_hi"]) == pytest.approx((c["ci_lo"], c["ci_hi"]), abs=0.015)


# ---------------------------------------------------------------- intervals
def test_overlaps_of_a_hot_key(spark):
    """A third of the rows have one key; ranges stay even, and the pairs are
    those of all rows against all."""
    rng = random.Random(6)
    rows = [(i, "hot" if i % 3 == 0 else f"k{rng.randint(0, 40)}", float(s := rng.randint(0, 3000)), float(s + rng.choice([0, 1, 5, 60, 2500 if i % 50 == 0 else 2]))) for i in range(900)]
    rows += [(i, k, s, e) for i, k, s, e in rows[:5]] + [(-1, None, 1.0, 9.0), (-2, "hot", None, 9.0)]
    df = spark.createDataFrame(rows, "i int, k string, s double, e double")
    right = df.where("i % 2 = 0").withColumn("extra", F.col("i") * 2)
    got = sorted((r["i"], r["i_r"], r["extra_r"]) for r in sweep.overlap_join(df, right, ["k"], ranges=9).collect())
    full = [r for r in rows if r[1] is not None and r[2] is not None and r[3] > r[2]]
    assert got == sorted((a[0], b[0], 2 * b[0]) for a in full for b in full if b[0] % 2 == 0 and a[1] == b[1] and a[2] < b[3] and b[2] < a[3])


def test_ranges_of_a_hot_key_are_even(spark, monkeypatch):
    kept, real = {}, sweep.keep
    monkeypatch.setattr(sweep, "keep", lambda df, name: kept.setdefault(name, real(df, name)))
    df = spark.range(30_000).select(F.col("id").cast("int").alias("i"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), (F.col("id") * 1.0).alias("s"), (F.col("id") + 1.5).alias("e"))
    assert sweep.overlap_join(df, df, ["k"], ranges=12).count() == 30_000
    sizes = [r["count"] for r in kept["ranges"].groupBy("part").count().collect()]
    assert len(sizes) == 12 and max(sizes) <= 3 * sorted(sizes)[len(sizes) // 2]


# ---------------------------------------------------------------- sequences
def events(rng, n, width=40):
    return [(rng.choice(["rain", "Rain", "dog", "wind"]), float(s := rng.randint(0, 4 * n)), float(s + rng.randint(-2, width))) for _ in range(n)]


def test_long_timelines_match_as_the_fold_does(spark):
    rng = random.Random(14)
    rows = [(i, events(rng, rng.choice([0, 5, 61, 62, 63, 90])), events(rng, rng.choice([0, 5, 62, 63, 120]))) for i in range(60)]
    kind = "array<struct<event_type:string,s:double,e:double>>"
    df = spark.createDataFrame(rows, f"i int, p {kind}, t {kind}")
    names = [F.transform(c, lambda x: x["event_type"]) for c in ("p", "t")]
    for r in df.select("i", intervals.greedy_match(F.col("p"), F.col("t")).alias("m"), intervals.lcs_length(*names).alias("n")).collect():
        _, p, t = rows[r["i"]]
        assert r["m"] == greedy(p, t) and r["n"] == lcs([x[0] for x in p], [x[0] for x in t])


def test_five_thousand_events_take_seconds(spark):
    rng = random.Random(15)
    p, t = events(rng, 5000), events(rng, 5000)
    kind = "array<struct<event_type:string,s:double,e:double>>"
    df = spark.createDataFrame([(p, t)], f"p {kind}, t {kind}")
    began = time.time()
    matched = df.select(intervals.greedy_match(F.col("p"), F.col("t")).alias("m")).first()["m"]
    assert time.time() - began < 20 and len(matched) == 5000 and len({x for x in matched if x >= 0}) == sum(x >= 0 for x in matched)
    a, b = [rng.randint(0, 9) for _ in range(5000)], [rng.randint(0, 9) for _ in range(5000)]
    began = time.process_time()
    n = intervals.common_length(a, b)
    assert time.process_time() - began < 1 and 0 < n < 5000


# -------------------------------------------------------------- equal answers
def test_equal_answers_are_scored_once(spark):
    """The counted scores are those of all rows, and fewer rows are parsed."""
    df = spark.range(600).select("id", F.concat(F.lit("m"), F.col("id") % 2).alias("model"), F.concat(F.lit("Timestamp: 01:0"), F.col("id") % 5).alias("response"), F.lit("01:02").alias("needle_timestamp"), F.lit("rain").alias("gt_sound"))
    got = evaluators.counted_scores(df, "anih")
    assert got.count() == 10 * len(evaluators.METRICS["anih"])
    want = aggregate.summarise(evaluators.long_scores(evaluators.score_anih(df), "anih", "id"))
    assert sorted(aggregate.summarise(got).collect()) == sorted(want.collect())


def test_short_timelines_need_no_python(spark):
    event = "array<struct<event_type:string,start:string,end:string,overlaps:string>>"
    line = "1. Event: rain, Start: 00:01, End: 00:09"
    rows = [(i, "\n".join([line] * n), [("rain", "00:01", "00:09", "")] * n) for i, n in enumerate([0, 1, 62, 63, 70])]
    df = spark.createDataFrame(rows, f"i int, response string, true_events {event}")
    short = evaluators._score_soundscape(df.where("i < 3"), True)
    assert "ArrowEvalPython" not in short._jdf.queryExecution().executedPlan().toString()
    got = {r["i"]: r["event_f1"] for r in evaluators.score_soundscape(df).collect()}
    assert got == {0: 0.0, 1: 1.0, 2: 1.0, 3: 1.0, 4: 1.0}


def test_a_pattern_runs_once_a_line(spark):
    lines = ["1. Event: $1 , Start: 00:10, End: \\0", "\u00a0noise 2) dog; 00:20; 00:30", "\r", "3: event: a, start 1, end 2, overlaps: b, c", "EVENT x, Start: 5", "4. x, Event: y, Start: 1, End: 2,Overlaps: "]
    df = spark.createDataFrame([("\n".join(lines),), (None,), ("",)], "r string").select(text.soundscape_answer(F.col("r")).alias("e"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("Start[:") == 1 and plan.count(r"[\.\:\)]") == 1
    want = [("$1", "00:10", "\\0", ""), ("dog", "00:20", "00:30", ""), ("a", "1", "2", "b, c"), ("y", "1", "2", "")]
    assert [[tuple(e) for e in r["e"]] for r in df.collect()] == [want, [], []]


def test_subsequences_of_nulls(spark):
    """NULL is equal to nothing; what is left may be all of the other side."""
    rows = [(["a", None, "b"], ["a", "b"], 2), (["a", None], ["a", None], 1), ([None], [None], 0), ([None], [], 0), (["b", "a"], ["a", "b"], 1)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>, n int")
    assert [r["n"] == r["x"] for r in df.select("n", intervals.lcs_length(F.col("a"), F.col("b"), True).alias("x")).collect()] == [True] * 5


def test_reports_read_the_summary_alone(spark):
    grid = report.dense_grid(aggregate.summarise(scores(spark, [0.0, 1.0, 1.0])))
    plan = grid._jdf.queryExecution().optimizedPlan().toString()
    files = {f.rsplit("/", 2)[-2].split("-")[0] for f in grid.inputFiles()}
    assert files == {"summary"} and "percentile" not in plan and len(grid.collect()) == 1


def test_looked_up_weights_are_those_that_are_searched():
    seeds = np.random.default_rng(4).integers(0, 1 << 63, 7, dtype=np.uint64)
    for k in (0, 3, 12):
        low, table = weights.cumulative(2.0**k)
        h = weights.bits(seeds, 3000)
        assert (weights.poisson(h, low, table, weights.lookup(low, table)) == np.searchsorted(table, weights.uniform(h), "right") + low).all()


def test_poisson_bootstrap_reads_scores_once(spark, monkeypatch):
    kept, real = [], aggregate.keep
    monkeypatch.setattr(aggregate, "keep", lambda df, name: kept.append(name) or real(df, name))
    assert aggregate.poisson_bootstrap(scores(spark, [0.0, 1.0, 1.0]), 200).count() == 1
    assert kept == ["equal"]
