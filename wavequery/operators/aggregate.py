"""Summaries of long scores (task, model, instance_id, metric, value), or of
counted ones (task, model, metric, value, c): c is how many are equal.

NULL stands for an error without a value and is left out by every aggregate; a
metric with nothing left counts as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.choice import draw
from ..sources.scratch import keep
from . import multinomial
from .evaluators import PRIMARY
from .weights import AT_ONCE, added, interval, weigh

KEYS = ["task", "model", "metric"]


#: Distinct values of a group that one task sorts at most, in how many bins the
#: others are divided at a time, and the rank error of the bins' bounds (1 over).
LEAF, BINS, ACCURACY = 4096, 64, 6400


def counted(scores: DataFrame, *value: Column) -> DataFrame:
    """Equal values of a metric as one row with their count ``c``, in one shuffle
    with partial sums, written once: all else reads that table."""
    many = F.sum("c") if "c" in scores.columns else F.count(F.lit(1))
    return keep(scores.groupBy(*KEYS, *(value or ["value"])).agg(many.alias("c")), "equal")


def summarise(scores: DataFrame, medians: bool = True) -> DataFrame:
    """mean, std (population), median (unless told not to), min, max and n of every
    metric.

    The scores are computed once (``counted``), and so is the summary, a row a
    metric, which reports read several times.  No buffer holds a group: its
    median is found by selection (``selected``)."""
    equal = counted(scores)
    v, c = F.col("value"), F.col("c")
    known = F.when(v.isNotNull(), c).otherwise(0)
    reach = equal.groupBy(*KEYS).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.sum(known).alias("k"), F.sum(c).alias("n"))
    rows = equal.join(reach, KEYS).withColumns({"d": v - F.col("min"), "c": known})
    # Distances to the least value: equal values have a deviation of exactly 0.
    sums = rows.groupBy(*KEYS).agg(F.sum(c * F.col("d")).alias("s"), F.sum(c * F.col("d") * F.col("d")).alias("q"))
    mean = F.col("s") / F.col("k")
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("k") - mean * mean))
    out, middle = reach.join(sums, KEYS), []
    if medians:
        out = out.join(_medians(equal.where("value is not null").join(reach.select(*KEYS, "k"), KEYS)), KEYS, "left")
        middle = [F.coalesce("median", F.lit(0.0)).alias("median")]
    out = out.select(
        *KEYS,
        F.coalesce(F.col("min") + mean, F.lit(0.0)).alias("mean"),
        F.coalesce(std, F.lit(0.0)).alias("std"),
        *middle,
        "min",
        "max",
        "n",
    )
    return keep(out, "summary")


def means(scores: DataFrame) -> DataFrame:
    """The mean of every metric alone, for what reads no more of a summary: one
    shuffle of partial sums, no table of values and no selection of medians."""
    v, c = F.col("value"), F.col("c") if "c" in scores.columns else F.lit(1)
    known = F.when(v.isNotNull(), c)
    sums = scores.groupBy(*KEYS).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.sum(c * v).alias("s"), F.sum(known).alias("k"))
    # Equal values have exactly their value as their mean.
    mean = F.when(F.col("min") == F.col("max"), F.col("min")).otherwise(F.col("s") / F.col("k"))
    return keep(sums.select(*KEYS, F.coalesce(mean, F.lit(0.0)).alias("mean")), "means")


def _ranks() -> tuple[Column, Column]:
    """The two ranks, from 0, that make a median of k values."""
    return F.floor((F.col("k") - 1) / 2), F.floor(F.col("k") / 2)


def selected(rows: DataFrame, leaf: int = LEAF, bins: int = BINS) -> DataFrame:
    """Of distinct values (KEYS, value, c, k) those among which the median is,
    with how many values are ``before`` them; ``leaf`` at most in any group.

    Recursive selection: groups that have more are divided at approximate
    quantiles of their distinct values, so an outlier takes a bin of its own and
    no more; what isn't in the bins of the two ranks leaves.  A round divides the
    values of a group by about ``bins``; a quantile's buffer and the bins are
    bounded, so no task holds a group."""
    rows = rows.withColumn("before", F.lit(0).cast("long"))
    low, high = _ranks()
    while (rows.groupBy(*KEYS).count().agg(F.max("count")).first()[0] or 0) > leaf:
        cuts = rows.groupBy(*KEYS).agg(F.percentile_approx("value", [i / bins for i in range(1, bins)], ACCURACY).alias("cuts"))
        # How many cuts are less, by halving: one comparison a power of two.
        placed = rows.join(cuts, KEYS).withColumn("bin", F.lit(0))
        for step in (1 << i for i in reversed(range(bins.bit_length()))):
            less = F.get("cuts", F.col("bin") + (step - 1)) < F.col("value")
            placed = placed.withColumn("bin", F.col("bin") + F.when(less, step).otherwise(0))
        placed = placed.select(*KEYS, "value", "c", "k", "before", "bin")
        sums = placed.groupBy(*KEYS, "bin", "k", "before").agg(F.sum("c").alias("own"))
        ahead = Window.partitionBy(*KEYS).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("from", F.col("before") + F.coalesce(F.sum("own").over(ahead), F.lit(0)))
        upto = F.col("from") + F.col("own")
        hit = sums.where((F.col("from") <= low) & (low < upto) | (F.col("from") <= high) & (high < upto))
        # The two ranks are neighbours: nothing is between their bins.
        first = Window.partitionBy(*KEYS)
        hit = hit.select(*KEYS, "bin", F.min("from").over(first).alias("before"))
        rows = keep(placed.drop("before").join(hit, [*KEYS, "bin"]).select(*KEYS, "value", "c", "k", "before"), "selected")
    return rows


def _medians(rows: DataFrame, leaf: int = LEAF, bins: int = BINS) -> DataFrame:
    """The median of each group from its distinct values (KEYS, value, c, k)."""
    upto = Window.partitionBy(*KEYS).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    inside = selected(rows, leaf, bins).withColumn("upto", F.col("before") + F.sum("c").over(upto))
    inside = inside.withColumn("from", F.col("upto") - F.col("c"))
    low, high = _ranks()

    def at(rank):
        return F.max(F.when((F.col("from") <= rank) & (rank < F.col("upto")), F.col("value")))

    return inside.groupBy(*KEYS).agg(((at(low) + at(high)) / 2).alias("median"))


def mean_latency(responses: DataFrame) -> DataFrame:
    """Mean of positive latencies by model, 0 without any."""
    ms = F.col("latency_ms")
    return responses.groupBy("model").agg(F.coalesce(F.avg(F.when(ms > 0, ms)), F.lit(0.0)).alias("avg_latency_ms"))


#: Values are drawn as whole numbers of this unit, so that sums are exact.
UNIT = 1e-6


def bootstrap(scores: DataFrame, replicates: int = 10_000, confidence: float = 0.95, leaf: int = multinomial.LEAF) -> DataFrame:
    """Percentile interval of the mean: ``replicates`` resamples with replacement
    of the values, rounded to ``UNIT``.

    No draw is a row: equal values become one with their count, and the n draws
    of a replicate are dealt over them (``multinomial``).  A group is buckets of
    some ``leaf`` distinct values; buckets and blocks of replicates are tasks'
    work, and their sums meet by group and replicate."""
    q = F.round(F.col("value") / UNIT).cast("long").alias("q")
    equal = counted(scores.where("value is not null"), q)
    group = F.conv(F.substring(F.md5(F.concat_ws(":", *KEYS).cast("binary")), 1, 15), 16, 10).cast("long")
    sizes = equal.groupBy(*KEYS).agg(F.sum("c").alias("n")).withColumn("g", group)
    totals = multinomial.sums(equal, group, replicates, leaf).withColumnRenamed("total", "mu")
    # Percentiles of the sums: whole numbers, of ``replicates`` a group.
    limits = _interval(totals, confidence, ["g"]).join(sizes, "g")
    return limits.select(*KEYS, *[(F.col(c) / F.col("n") * UNIT).alias(c) for c in ("ci_lo", "ci_hi")], "n")


def poisson_bootstrap(scores: DataFrame, replicates: int = 10_000, confidence: float = 0.95) -> DataFrame:
    """The same interval with Poisson(1) weights instead of draws.  Weights of
    equal values add up to Poisson(count), so each distinct value of a group
    takes a few draws a replicate, one for each power of two in its count, and
    only ``replicates`` partial sums of each group and task are shuffled, which
    are added up by blocks of replicates."""
    top = 1 << AT_ONCE
    equal = counted(scores.where("value is not null"))
    whole = F.transform(F.when(F.col("c") >= top, F.sequence(F.lit(1).cast("long"), F.floor(F.col("c") / top))).otherwise(F.array().cast("array<bigint>")), lambda i: F.struct(F.lit(AT_ONCE).alias("k"), i.alias("i")))
    bits = F.filter(F.sequence(F.lit(0), F.lit(AT_ONCE - 1)), lambda k: F.col("c").bitwiseAND(F.element_at(F.lit([1 << i for i in range(AT_ONCE)]).cast("array<bigint>"), k + 1)) > 0)
    parts = equal.select(*KEYS, "value", F.explode(F.concat(whole, F.transform(bits, lambda k: F.struct(k.alias("k"), F.lit(0).cast("long").alias("i"))))).alias("p"))
    group = F.xxhash64(*KEYS)
    seed = F.xxhash64(draw(F.col("model"), F.col("metric"), F.col("value"), F.col("p.k"), F.col("p.i")), "task", "value", "p.k", "p.i")
    # Small rows still have many draws: deal them over all tasks, by a number
    # of partitions, as Spark would put them together.
    rows = parts.select(group.alias("g"), "value", F.col("p.k").cast("int").alias("k"), seed.alias("seed"))
    parts_of_work = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = rows.repartition(parts_of_work, "seed").sortWithinPartitions("g", "seed")
    kind = "g long, block int, w array<double>, wv array<double>"
    sums = rows.mapInArrow(weigh(replicates), kind).repartition(parts_of_work, "g", "block").sortWithinPartitions("g", "block").mapInArrow(added, kind)
    limits = sums.groupBy("g").applyInArrow(interval(confidence), "g long, ci_lo double, ci_hi double")
    names = equal.groupBy(group.alias("g")).agg(*[F.first(k).alias(k) for k in KEYS], F.sum("c").alias("n"))
    return limits.join(names, "g").select(*KEYS, "ci_lo", "ci_hi", "n")


def _interval(means: DataFrame, confidence: float, keys: list[str]) -> DataFrame:
    tail = (1 - confidence) / 2
    return means.groupBy(*keys).agg(F.percentile("mu", F.lit(tail)).alias("ci_lo"), F.percentile("mu", F.lit(1 - tail)).alias("ci_hi"))


def with_intervals(summary: DataFrame, intervals: DataFrame) -> DataFrame:
    """Adds ci_lo and ci_hi, NULL for metrics with fewer than two values."""
    ci = intervals.where(F.col("n") >= 2).select(*KEYS, "ci_lo", "ci_hi")
    return summary.join(ci, KEYS, "left")


def primary(summary: DataFrame) -> DataFrame:
    """The rows of each task's primary metric."""
    pairs = F.create_map(*[F.lit(x) for kv in PRIMARY.items() for x in kv])
    return summary.where(F.col("metric") == pairs[F.col("task")])


def rank_models(summary: DataFrame) -> DataFrame:
    """Models by primary metric, best first; equal scores by name."""
    order = Window.partitionBy("task").orderBy(F.desc("mean"), "model")
    return primary(summary).select("task", "model", F.col("mean").alias("score"), F.row_number().over(order).alias("rank"))


def best_models(summary: DataFrame) -> DataFrame:
    return rank_models(summary).where("rank = 1").drop("rank")
