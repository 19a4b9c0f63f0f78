"""All queries of the engine by name, with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles as o
from .functions.intervals import lcs_length, temporal_iou
from .functions.text import anih_answer, drift_answer, mmss, narrative_answer, seconds, seconds_or_zero, soundscape_answer, title
from .operators import aggregate, generate, report, signal
from .operators.evaluators import METRICS, PRIMARY, SCORE, counted_scores, long_scores, match_events, types_of_pairs
from .operators.resample import resample
from .operators.sweep import overlap_join
from .plans import runner
from .plans.tasks import prompt
from .sources import files, fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MODELS = ["m0", "m1", "m2", "m3"]


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c):
    """Rounded alike in both engines: ties are pushed up first."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(1e-9), 6)


# ------------------------------------------------------------------ inputs
def anih(spark, sf_dir):
    return fixtures.table(spark, sf_dir, fixtures.ANIH)


def drift(spark, sf_dir):
    return fixtures.table(spark, sf_dir, fixtures.DRIFT)


def narrative(spark, sf_dir):
    rows = fixtures.table(spark, sf_dir, fixtures.NARRATIVE)
    return rows.withColumns({"key_timestamps": F.array("t_a", "t_b", "t_c"), "required_reasoning_steps": F.array("r_a", "r_b", "r_c")})


INPUT = {"anih": (anih, "event_id"), "speaker_drift": (drift, "event_id"), "soundscape": (fixtures.soundscape, "instance_id"), "narrative_coherence": (narrative, "event_id")}


def scored(spark, sf_dir, task):
    return SCORE[task](INPUT[task][0](spark, sf_dir))


def all_scores(spark, sf_dir):
    return reduce(DataFrame.unionByName, [long_scores(scored(spark, sf_dir, t), t, INPUT[t][1]) for t in METRICS])


def counted(spark, sf_dir, names=METRICS):
    """All scores without instances, counted: ``names`` of each task."""
    return reduce(DataFrame.unionByName, [counted_scores(INPUT[t][0](spark, sf_dir), t, names[t]) for t in METRICS])


def counted_primary(spark, sf_dir):
    """Of the primary metrics alone; what these don't need isn't computed."""
    return counted(spark, sf_dir, {t: [m] for t, m in PRIMARY.items()})


def summary(spark, sf_dir):
    return aggregate.summarise(counted(spark, sf_dir))


def main_summary(spark, sf_dir):
    """The means of the primary metrics: all that is read of them."""
    return aggregate.means(counted_primary(spark, sf_dir))


def latencies(spark, sf_dir):
    """latency_ms is -1 for answers that failed."""
    ms = F.when(F.col("event_type") == "error", -1.0).otherwise(F.col("value"))
    return fixtures.events(spark, sf_dir).select(F.concat(F.lit("m"), F.col("event_id") % 4).alias("model"), F.col("event_id").cast("string").alias("instance_id"), ms.alias("latency_ms"))


# ----------------------------------------------------------------- parsing
@query(f"SELECT event_id, \"timestamp\", preceding_sound FROM ({o.ANIH_PARSED})")
def anih_parse(spark, sf_dir):
    return anih(spark, sf_dir).select("event_id", anih_answer(F.col("response")).alias("a")).select("event_id", "a.*")


@query(f"SELECT event_id, predicted_speaker, first_appearance FROM ({o.DRIFT_PARSED})")
def drift_parse(spark, sf_dir):
    return drift(spark, sf_dir).select("event_id", drift_answer(F.col("response")).alias("a")).select("event_id", "a.*")


@query(f"SELECT instance_id, i, event_type, \"start\", \"end\", \"overlaps\" FROM ({o.SOUND_PARSED})")
def soundscape_parse(spark, sf_dir):
    rows = fixtures.soundscape(spark, sf_dir).select("instance_id", F.posexplode(soundscape_answer(F.col("response"))).alias("i", "e"))
    return rows.select("instance_id", (F.col("i") + 1).cast("long").alias("i"), "e.*")


@query(f"SELECT event_id, verdict, array_to_string(reasoning_steps, '|') AS steps, array_to_string(cited_timestamps, '|') AS cited FROM ({o.NARRATIVE_PARSED})")
def narrative_parse(spark, sf_dir):
    rows = narrative(spark, sf_dir).select("event_id", narrative_answer(F.col("response")).alias("a"))
    return rows.select("event_id", "a.verdict", F.array_join("a.reasoning_steps", "|").alias("steps"), F.array_join("a.cited_timestamps", "|").alias("cited"))


@query(
    f"SELECT event_id, ts, {o.secs('ts')} AS strict, coalesce({o.secs('ts')}, 0) AS lenient, CASE WHEN {o.secs('ts')} IS NOT NULL THEN format('{{:02d}}:{{:02d}}', floor(({o.secs('ts')}) / 60)::BIGINT, floor(({o.secs('ts')}) % 60)::BIGINT) END AS back "
    "FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN (event_id % 130)::VARCHAR || ':' || lpad((event_id % 60)::VARCHAR, 2, '0') WHEN 1 THEN '05:00.5' WHEN 2 THEN '1:02:03' WHEN 3 THEN 'ongoing' ELSE '12:' END AS ts FROM events)"
)
def timestamp_roundtrip(spark, sf_dir):
    n = F.col("event_id")
    ts = F.when(n % 5 == 0, F.concat((n % 130).cast("string"), F.lit(":"), F.lpad((n % 60).cast("string"), 2, "0"))).when(n % 5 == 1, "05:00.5").when(n % 5 == 2, "1:02:03").when(n % 5 == 3, "ongoing").otherwise("12:")
    rows = fixtures.events(spark, sf_dir).select("event_id", ts.alias("ts"))
    return rows.select("event_id", "ts", seconds(F.col("ts")).alias("strict"), seconds_or_zero(F.col("ts")).alias("lenient"), mmss(seconds(F.col("ts"))).alias("back"))


@query(
    "SELECT 'conversations' AS source, count(*) AS n, count(nullif(regexp_extract(text, '(\\d{1,2}:\\d{2}(?:\\.\\d+)?)', 1), '')) AS timestamps, count(nullif(regexp_extract(text, '[Ss]peaker[:\\s]+(\\d+)', 1), '')) AS speakers FROM conversations "
    "UNION ALL SELECT 'documents', count(*), count(nullif(regexp_extract(text, '(\\d{1,2}:\\d{2}(?:\\.\\d+)?)', 1), '')), count(nullif(regexp_extract(text, '[Ss]peaker[:\\s]+(\\d+)', 1), '')) FROM documents"
)
def free_text_parse(spark, sf_dir):
    """Parsers over text that is no answer: they find next to nothing and never fail."""
    both = [spark.read.parquet(f"{sf_dir}/{t}.parquet").select(F.lit(t).alias("source"), "text") for t in ("conversations", "documents")]
    rows = both[0].unionByName(both[1]).select("source", anih_answer(F.col("text"))["timestamp"].alias("t"), drift_answer(F.col("text"))["predicted_speaker"].alias("s"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("t").alias("timestamps"), F.count("s").alias("speakers"))


# ----------------------------------------------------------------- scoring
def _scores(task):
    sql, key, names = o.METRICS[task]
    strict = ["ordering_accuracy_strict"] if task == "soundscape" else []

    def run(spark, sf_dir):
        return scored(spark, sf_dir, task).select(key, "model", *[r6(n).alias(n) for n in [*names, *strict]])

    return run, o.rounded(sql, [key, "model"], [*names, *strict])


for _name, _task in (("anih_scores", "anih"), ("drift_scores", "speaker_drift"), ("soundscape_scores", "soundscape"), ("narrative_scores", "narrative_coherence")):
    QUERIES[_name], ORACLES[_name] = _scores(_task)


@query(
    f"SELECT model, count(*) AS n, {o.r6('avg(timestamp_error_seconds)')} AS error_mean, {o.r6('stddev_pop(timestamp_error_seconds)')} AS error_std, {o.r6('median(timestamp_error_seconds)')} AS error_median, "
    f"{o.r6('avg(timestamp_hit_5s)')} AS hit_5s, {o.r6('avg(preceding_sound_iou)')} AS sound_iou, {o.r6('avg(composite_score)')} AS composite FROM ({o.ANIH_SCORES}) GROUP BY model"
)
def anih_leaderboard(spark, sf_dir):
    rows = aggregate.summarise(counted_scores(anih(spark, sf_dir), "anih"))

    def of(metric, column):
        return F.max(F.when(F.col("metric") == metric, F.col(column)))

    e = "timestamp_error_seconds"
    columns = [("error_mean", e, "mean"), ("error_std", e, "std"), ("error_median", e, "median"), ("hit_5s", "timestamp_hit_5s", "mean"), ("sound_iou", "preceding_sound_iou", "mean"), ("composite", "composite_score", "mean")]
    rows = rows.groupBy("model").agg(of(e, "n").alias("n"), *[r6(of(m, c)).alias(name) for name, m, c in columns])
    return rows.orderBy(F.desc("composite"), "model")


def _matched(spark, sf_dir):
    return match_events(fixtures.soundscape(spark, sf_dir).withColumn("events", soundscape_answer(F.col("response"))))


@query(
    f"WITH p AS (SELECT instance_id, i, event_type, {o.span('\"start\"', '\"end\"')} FROM ({o.SOUND_PARSED})), t AS (SELECT instance_id, ord AS j, event_type, {o.span('start_ts', 'end_ts')} FROM ({o.on_events(fixtures.SOUNDSCAPE)})) "
    f"SELECT p.instance_id, p.i, t.j, {o.r6(o.iou('p.s', 'p.e', 't.s', 't.e'))} AS iou FROM p JOIN t ON p.instance_id = t.instance_id"
)
def temporal_iou_pairs(spark, sf_dir):
    rows = _matched(spark, sf_dir).select("instance_id", "t", F.posexplode("p").alias("i", "x")).select("instance_id", "i", "x", F.posexplode("t").alias("j", "y"))
    iou = temporal_iou(F.col("x.s"), F.col("x.e"), F.col("y.s"), F.col("y.e"))
    return rows.select("instance_id", (F.col("i") + 1).cast("long").alias("i"), (F.col("j") + 1).cast("long").alias("j"), r6(iou).alias("iou"))


@query(f"SELECT instance_id, i, coalesce(j, 0) AS j FROM ({o.SOUND_MATCHED})")
def greedy_event_match(spark, sf_dir):
    rows = _matched(spark, sf_dir).select("instance_id", F.posexplode("m").alias("i", "j"))
    return rows.select("instance_id", (F.col("i") + 1).cast("long").alias("i"), (F.col("j") + 1).cast("long").alias("j"))


@query(f"SELECT instance_id, k, lcs, lcs_strict FROM ({o.LCS})")
def lcs_ordering(spark, sf_dir):
    rows = _matched(spark, sf_dir).where(F.size("pairs") > 0)
    p, t, by_time = types_of_pairs()
    return rows.select("instance_id", F.size("pairs").cast("long").alias("k"), lcs_length(p, t).cast("long").alias("lcs"), lcs_length(p, by_time).cast("long").alias("lcs_strict"))


# -------------------------------------------------------------- aggregates
_SUMMARY = ["mean", "std", "median", "min", "max"]


@query(f"SELECT task, model, metric, n, {', '.join(f'{o.r6(c)} AS {c}' for c in _SUMMARY)} FROM ({o.SUMMARY})")
def metric_summary(spark, sf_dir):
    return summary(spark, sf_dir).select("task", "model", "metric", "n", *[r6(c).alias(c) for c in _SUMMARY])


@query(f"SELECT model, {o.r6('avg_latency_ms')} AS avg_latency_ms FROM ({o.LATENCY})")
def latency_mean(spark, sf_dir):
    return aggregate.mean_latency(latencies(spark, sf_dir)).select("model", r6("avg_latency_ms").alias("avg_latency_ms"))


@query()
def bootstrap_ci(spark, sf_dir):
    """The interval of every metric of every task, with the replicates of the
    configuration, by Poisson weights."""
    return aggregate.poisson_bootstrap(counted(spark, sf_dir))


#: Replicates of the intervals that SQL repeats draw by draw.
DRAWN = 40


@query(o.bootstrap_draws(DRAWN))
def bootstrap_draws(spark, sf_dir):
    """The interval of every metric of every task, drawn with replacement."""
    rows = aggregate.bootstrap(counted(spark, sf_dir), DRAWN)
    return rows.select("task", "model", "metric", "n", r6("ci_lo").alias("ci_lo"), r6("ci_hi").alias("ci_hi"))


@query(f"SELECT task, model, {o.r6('score')} AS score, rank FROM ({o.RANKED})")
def model_ranking(spark, sf_dir):
    return aggregate.rank_models(main_summary(spark, sf_dir)).select("task", "model", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"SELECT task, model, {o.r6('score')} AS score FROM ({o.RANKED}) WHERE rank = 1")
def best_model(spark, sf_dir):
    return aggregate.best_models(main_summary(spark, sf_dir)).select("task", "model", r6("score").alias("score"))


@query(
    f"WITH a AS (SELECT event_id FROM ({o.on_events(fixtures.ANIH)})) "
    "SELECT count(*) FILTER (a.event_id IS NOT NULL AND r.o_orderkey IS NOT NULL) AS both_sides, count(*) FILTER (r.o_orderkey IS NULL) AS only_truth, count(*) FILTER (a.event_id IS NULL) AS only_response FROM a FULL OUTER JOIN orders r ON a.event_id = r.o_orderkey"
)
def joined_scores(spark, sf_dir):
    """Audit of instances against responses (orders stand for them): what an
    inner join would lose."""
    truth, responses = anih(spark, sf_dir).select("event_id"), spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    both = truth.join(responses, truth["event_id"] == responses["id"], "full_outer")
    return both.agg(F.count_if(F.col("event_id").isNotNull() & F.col("id").isNotNull()).alias("both_sides"), F.count_if(F.col("id").isNull()).alias("only_truth"), F.count_if(F.col("event_id").isNull()).alias("only_response"))


# ----------------------------------------------------------------- reports
@query(
    f"WITH p AS ({o.PRIMARY}) SELECT t.task, m.model, {o.r6('p.mean')} AS mean FROM (SELECT DISTINCT task FROM p) t CROSS JOIN (SELECT DISTINCT model FROM p) m LEFT JOIN p ON p.task = t.task AND p.model = m.model AND NOT (p.task = 'soundscape' AND p.model = 'm3')"
)
def dense_result_grid(spark, sf_dir):
    """Without the results of one model in one task: the grid has a gap there."""
    rows = main_summary(spark, sf_dir).where("not (task = 'soundscape' and model = 'm3')")
    return report.dense_grid(rows).select("task", "model", r6("mean").alias("mean"))


@query(f"SELECT task, {', '.join(o.r6(f'max(mean) FILTER (model = {m!r})') + ' AS ' + m for m in MODELS)} FROM ({o.PRIMARY}) GROUP BY task")
def main_table(spark, sf_dir):
    return report.main_table(main_summary(spark, sf_dir), MODELS).select("task", *[r6(m).alias(m) for m in MODELS])


@query()
def main_table_intervals(spark, sf_dir):
    """The main table as text, ``mean [low, high]``."""
    scores = aggregate.counted(counted_primary(spark, sf_dir))
    rows = aggregate.with_intervals(aggregate.summarise(scores), aggregate.poisson_bootstrap(scores))
    return report.main_cells(rows, MODELS)


_TASKS = list(METRICS)


@query(f"SELECT model, {', '.join(f'coalesce({o.r6(f'max(mean) FILTER (task = {t!r})')}, 0) AS {t}' for t in _TASKS)} FROM ({o.PRIMARY}) GROUP BY model")
def radar_matrix(spark, sf_dir):
    return report.radar(main_summary(spark, sf_dir), MODELS).select("model", *[r6(t).alias(t) for t in _TASKS])


@query(f"SELECT task, model, floor((600 + event_id % 5 * 720) / 600)::BIGINT AS step, {o.r6('avg(s.value)')} AS mean, count(*) AS n FROM ({o.long('anih')}) s JOIN events ON event_id::VARCHAR = instance_id WHERE metric = 'composite_score' GROUP BY ALL")
def scaling_by_duration(spark, sf_dir):
    """Scores by length of the audio, ten minutes a step (an extension)."""
    n = F.col("event_id")
    lengths = fixtures.events(spark, sf_dir).select(n.cast("string").alias("instance_id"), (600.0 + n % 5 * 720).alias("duration"))
    rows = report.scaling(long_scores(scored(spark, sf_dir, "anih"), "anih", "event_id"), lengths)
    return rows.select("task", "model", "step", r6("mean").alias("mean"), "n")


@query(
    f"SELECT task, metric, {', '.join(o.r6(f'max({c}) FILTER (model = {m!r})') + f' AS {m}_{c}' for m in MODELS for c in ('mean', 'std'))} FROM ({o.SUMMARY}) GROUP BY task, metric"
)
def detail_table(spark, sf_dir):
    return report.detail_table(aggregate.summarise(counted(spark, sf_dir), medians=False), MODELS).select("task", "metric", *[r6(f"{m}_{c}").alias(f"{m}_{c}") for m in MODELS for c in ("mean", "std")])


@query(
    f"SELECT s.task, s.model, s.instance_id, coalesce(l.ms, -1.0::DOUBLE) AS latency_ms, {o.r6('s.value')} AS score FROM ({o.LONG}) s LEFT JOIN (SELECT event_id::VARCHAR AS id, 'm' || (event_id % 4)::VARCHAR AS model, CASE WHEN event_type = 'error' THEN -1.0::DOUBLE ELSE value END AS ms FROM events) l "
    "ON l.id = s.instance_id AND l.model = s.model WHERE metric = CASE task WHEN 'speaker_drift' THEN 'joint_accuracy' ELSE 'composite_score' END"
)
def failure_rows(spark, sf_dir):
    """Of all tasks; soundscapes are of many events and have no latency."""
    rows = report.failure_rows(all_scores(spark, sf_dir), latencies(spark, sf_dir))
    return rows.select("task", "model", "instance_id", "latency_ms", r6("score").alias("score"))


@query(f"SELECT s.task, s.model, s.metric, {o.r6('s.mean')} AS mean FROM ({o.SUMMARY}) s JOIN ({o.RANKED}) r ON r.task = s.task AND r.model = s.model AND r.rank = 1 WHERE s.metric <> 'composite_score'")
def failure_breakdown(spark, sf_dir):
    return report.failure_breakdown(aggregate.means(counted(spark, sf_dir))).select("task", "model", "metric", r6("mean").alias("mean"))


@query(f"SELECT task, model, {o.r6('avg_latency_ms / 1000')} AS latency_s, {o.r6('mean')} AS accuracy FROM ({o.PRIMARY}) JOIN ({o.LATENCY}) USING (model)")
def latency_accuracy(spark, sf_dir):
    rows = report.latency_accuracy(main_summary(spark, sf_dir), aggregate.mean_latency(latencies(spark, sf_dir)))
    return rows.select("task", "model", r6("latency_s").alias("latency_s"), r6("accuracy").alias("accuracy"))


@query(f"SELECT floor({o.secs('needle_timestamp')} / 600)::BIGINT AS depth, count(*) AS n, {o.r6('avg(timestamp_hit_5s)')} AS hit_5s FROM ({o.ANIH_SCORES}) JOIN (SELECT event_id, needle_timestamp FROM ({o.on_events(fixtures.ANIH)})) USING (event_id) GROUP BY 1")
def depth_analysis(spark, sf_dir):
    """Hits by depth of the needle, ten minutes a bucket (an extension)."""
    rows = scored(spark, sf_dir, "anih").select(F.lit("timestamp_hit_5s").alias("metric"), F.col("timestamp_hit_5s").alias("value"), "needle_timestamp")
    return report.by_bucket(rows, seconds(F.col("needle_timestamp")), 600, "depth").select("depth", "n", r6("mean").alias("hit_5s"))


@query("SELECT DISTINCT event_type, upper(event_type[1]) || event_type[2:] || ' Rate' AS title FROM events")
def display_names(spark, sf_dir):
    name = F.concat(F.col("event_type"), F.lit("_rate"))
    return fixtures.events(spark, sf_dir).select("event_type").distinct().select("event_type", title(name).alias("title"))


# -------------------------------------------------------------- generators
def _clips(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    size, key = F.col("p_size"), F.col("p_partkey")

    def pick(names, n):
        return F.element_at(F.array(*[F.lit(x) for x in names]), (n % len(names) + 1).cast("int"))

    wav = F.lit(".wav")
    backgrounds = part.select(F.lit("background").alias("kind"), pick(["library", "office"], key).alias("category"), F.concat(F.lit("bg/"), F.lpad(key.cast("string"), 9, "0"), wav).alias("path"))
    needles = part.select(F.lit("needle").alias("kind"), pick(["glass_shatter", "pen_click", "door_slam"], size).alias("category"), F.concat(F.lit("needle/"), (size % 3).cast("string"), wav).alias("path")).distinct()
    clues = part.select(F.lit("clue").alias("kind"), pick(["clock_chime", "church_bell", "train_whistle", "ice_cream_truck"], size).alias("category"), F.concat(F.lit("clue/"), (size % 4).cast("string"), wav).alias("path")).distinct()
    return backgrounds.unionByName(needles).unionByName(clues)


def _speakers(spark, sf_dir):
    dataset = F.element_at(F.array(F.lit("voxceleb2"), F.lit("ami"), F.lit("librispeech")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(dataset.alias("dataset"), F.col("c_name").alias("speaker_id"))


def _instances(spark, sf_dir):
    """As many instances as ``part`` has rows."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").count()


@query(o.GEN_ANIH)
def gen_anih(spark, sf_dir):
    rows = generate.anih(spark, _clips(spark, sf_dir), _instances(spark, sf_dir))
    return rows.select("instance_id", "needle_type", "background_source", "background_path", "needle_path", r6("needle_timestamp_seconds").alias("at_s"), "needle_timestamp", "preceding_sound", "prompt")


@query(f"SELECT i, instance_id, dataset, array_to_string(speaker_order, '|') AS speaker_order FROM ({o.GEN_DRIFT})")
def gen_drift(spark, sf_dir):
    return generate.drift(spark, _speakers(spark, sf_dir), _instances(spark, sf_dir)).select("i", "instance_id", "dataset", F.array_join("speaker_order", "|").alias("speaker_order"))


@query(o.GEN_TURNS)
def gen_turns(spark, sf_dir):
    rows = generate.turns(generate.drift(spark, _speakers(spark, sf_dir), _instances(spark, sf_dir)))
    return rows.select("instance_id", F.col("ord").cast("long").alias("ord"), F.col("speaker_idx").cast("long").alias("speaker_idx"), "speaker_id", r6("start_s").alias("start_s"), r6("end_s").alias("end_s"), "kind")


@query(o.GEN_SOUNDSCAPE)
def gen_soundscape(spark, sf_dir):
    rows = generate.timelines(spark, _instances(spark, sf_dir))
    return rows.select("i", F.col("ord").cast("long").alias("ord"), "event_type", r6("start_s").alias("start_s"), r6("end_s").alias("end_s"), "start", "end", F.col("overlaps").alias("overlap_names"))


@query(o.GEN_SOUNDSCAPES)
def gen_soundscape_instances(spark, sf_dir):
    rows = generate.soundscape(spark, _instances(spark, sf_dir), clips=_clips(spark, sf_dir))
    names = F.transform("events", lambda e: F.concat(e["event_type"], F.lit(" "), e["start"]))
    return rows.select("instance_id", "background_path", F.col("num_events").cast("long").alias("num_events"), F.array_join(names, "|").alias("event_names"))


@query(o.GEN_NARRATIVE)
def gen_narrative(spark, sf_dir):
    rows = generate.narrative(spark, _clips(spark, sf_dir).where("kind = 'clue'"), _instances(spark, sf_dir))
    return rows.select(
        "instance_id", "clue_type", "clue_path", "correct_verdict", *[f"clue_{x}_timestamp" for x in "abc"],
        *[r6(f"clue_{x}_timestamp_seconds").alias(f"clue_{x}_s") for x in "abc"], F.array_join("required_reasoning_steps", "|").alias("steps"),
    )


@query(f"SELECT i, {o.ident('anih')} AS instance_id FROM (SELECT event_id AS i FROM events)")
def instance_ids(spark, sf_dir):
    return fixtures.events(spark, sf_dir).select(F.col("event_id").alias("i"), generate.instance_id("anih", F.lit(0), F.col("event_id")).alias("instance_id"))


@query(
    "SELECT c_custkey, 'This is a ' || (30 + c_custkey % 60)::VARCHAR || '-minute panel discussion with ' || (2 + c_custkey % 5)::VARCHAR || ' speakers who have very similar voices. Listen to the entire recording carefully. At timestamp 43:15, a speaker says a single sentence. "
    "Identify which speaker this is (Speaker 1-' || (2 + c_custkey % 5)::VARCHAR || '). Has this speaker spoken previously in the audio? If yes, provide the timestamp of their first appearance in MM:SS format. Answer format: ''Speaker: X, First appearance: MM:SS (or \"Never\")''' AS prompt FROM customer"
)
def prompt_render(spark, sf_dir):
    k = F.col("c_custkey")
    text = prompt("speaker_drift", duration_minutes=30 + k % 60, num_speakers=2 + k % 5, target_timestamp=mmss(F.lit(2595.0)))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", text.alias("prompt"))


# ----------------------------------------------------------------- signals
SIZE = 50


def _tone(spark, sf_dir, n, value):
    """Frames of a formula of the clip ``c`` and the sample number ``k``, a clip
    for each row of ``supplier``."""
    c = F.col("clip_id")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("clip_id"))
    rows = rows.withColumn("frame_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(-(-n // SIZE) - 1).cast("long"))))
    k = F.sequence(F.col("frame_idx") * SIZE, F.least(F.col("frame_idx") * SIZE + SIZE, F.lit(n)) - 1)
    return rows.select("clip_id", "frame_idx", F.transform(k, lambda i: value(c, i)).alias("samples"))


def _tones(spark, sf_dir):
    return _tone(spark, sf_dir, 400, lambda c, k: (1 + c % 2) * 0.7 * F.sin(k * 0.1 + c))


def _fore(spark, sf_dir):
    return _tone(spark, sf_dir, 60, lambda c, k: F.when(c % 6 == 5, 0.0).otherwise(0.5 * F.cos(k * 0.3 + c)))


def _flat(frames):
    return signal.samples(frames, SIZE).select("clip_id", "pos", r6("v").alias("v"))


@query(o.RMS)
def rms(spark, sf_dir):
    return signal.rms(_tones(spark, sf_dir)).select("clip_id", r6("rms").alias("rms"))


@query(o.PEAK)
def peak_normalise(spark, sf_dir):
    return _flat(signal.normalise(_tones(spark, sf_dir)))


@query(o.RESAMPLED)
def resample_tones(spark, sf_dir):
    """From 100 samples a second to 64."""
    frames = _tones(spark, sf_dir).select("clip_id", F.lit(100).alias("rate"), F.lit(400).cast("long").alias("length"), "frame_idx", "samples")
    return _flat(resample(frames, SIZE, 64))


@query(o.MIX)
def mix_snr(spark, sf_dir):
    return _flat(signal.mix_snr(_tones(spark, sf_dir), _fore(spark, sf_dir), 37 + 61 * (F.col("clip_id") % 6), SIZE))


@query(o.ANIH_AUDIO)
def anih_audio(spark, sf_dir):
    return _flat(signal.anih_audio(_tones(spark, sf_dir), _fore(spark, sf_dir), 120 + 31 * (F.col("clip_id") % 6), 970, 80, SIZE))


@query(o.NARRATIVE_AUDIO)
def narrative_audio(spark, sf_dir):
    return _flat(signal.narrative_audio(_tones(spark, sf_dir), _fore(spark, sf_dir), 15 + 21 * (F.col("clip_id") % 6), 330, 100, SIZE))


@query(o.DRIFT_AUDIO)
def drift_audio(spark, sf_dir):
    """Panels of three turns of two seconds at 100 Hz, of neighbouring clips."""
    clips = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    k, n = F.col("s_suppkey").cast("long"), clips.count()
    turns = clips.select(k.alias("instance_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("ord"))
    turns = turns.withColumns({"speaker_id": (F.col("instance_id") + F.col("ord")) % n, "start_s": F.col("ord") * 2.0, "end_s": F.col("ord") * 2.0 + 2.0})
    return _flat(signal.drift_audio(turns, _tones(spark, sf_dir), 100, SIZE, 6.0))


@query(o.SUM)
def soundscape_sum(spark, sf_dir):
    events = _fore(spark, sf_dir).withColumn("event", F.explode(F.sequence(F.lit(0), F.lit(2))))
    events = events.withColumn("samples", F.transform("samples", lambda x: x * (F.col("event") + 1)))
    return _flat(signal.soundscape_audio(_tones(spark, sf_dir), events, 90 + 50 * F.col("event"), 12, SIZE))


@query(o.CONCAT)
def concat_crossfade(spark, sf_dir):
    parts = [(0, 0, 120), (1, 100, 260), (2, 250, 250), (3, 255, 700)]
    places = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(a).alias("start"), F.lit(z).alias("end")) for i, a, z in parts])
    tones = _tones(spark, sf_dir)
    segments = tones.select("clip_id").distinct().select("clip_id", F.col("clip_id").alias("source"), F.explode(places).alias("p")).select("clip_id", "source", "p.*")
    return _flat(signal.concatenate(segments, tones, SIZE, 12, 15))


# ------------------------------------------------------------ joins, runner
@query(o.OVERLAP)
def interval_overlap_join(spark, sf_dir):
    s = F.unix_timestamp("ts").cast("double")
    rows = fixtures.events(spark, sf_dir).select("event_id", "user_id", s.alias("s"), (s + 600 + F.col("event_id") % 7200).alias("e"))
    pairs = overlap_join(rows, rows, ["user_id"]).where("event_id < event_id_r")
    return pairs.select("event_id", "event_id_r", (F.least("e", "e_r") - F.greatest("s", "s_r")).alias("overlap_s"))


@query(o.DEDUPE)
def dedupe_results(spark, sf_dir):
    rows = fixtures.events(spark, sf_dir).withColumn("_o", F.struct("ts", "event_id"))
    return files.last_by(rows, ["user_id", "event_type"], "_o").select("user_id", "event_type", "event_id", "value")


@query()
def mock_runner(spark, sf_dir):
    """Answers of the deterministic model, parsed and with errors as misses."""
    instances = generate.anih(spark, _clips(spark, sf_dir), _instances(spark, sf_dir)).withColumn("audio_path", F.concat(F.lit("data/anih/"), "instance_id", F.lit(".wav")))
    answers = runner.run(instances, "echo").join(instances.select("instance_id", "needle_timestamp", F.col("preceding_sound").alias("gt_sound")), "instance_id")
    return SCORE["anih"](answers.withColumnRenamed("response_text", "response")).select("instance_id", "model", "error", "timestamp_error_seconds", "composite_score")
