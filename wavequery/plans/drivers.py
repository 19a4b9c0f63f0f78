"""The jobs end to end: generate instances, evaluate models, write reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate, generate, report
from ..operators.evaluators import SCORE, long_scores
from ..sources import files
from ..sources.scratch import keep
from . import runner, tasks

#: Instances of a task whose configuration doesn't say how many.
INSTANCES = 10


def chosen(wanted: str | list[str], known: list[str]) -> list[str]:
    """The names of ``known`` that are wanted ("all": each of them); unknown ones
    are skipped."""
    names = known if wanted == "all" else [wanted] if isinstance(wanted, str) else wanted
    return [x for x in names if x in known]


def generate_task(spark: SparkSession, task: str, sources: dict[str, DataFrame], config: dict | None = None, seed: int = 0) -> DataFrame:
    """Instances of a task as they are written: instance_id, task_name,
    audio_path, duration, ground_truth, prompt, metadata."""
    values = config or {}
    own, n = tasks.config(task, **values), int(values.get("num_instances", INSTANCES))
    if task == "anih":
        rows, truth, length = generate.anih(spark, sources["clips"], n, seed, own), ["needle_type", "needle_timestamp", "needle_timestamp_seconds", "preceding_sound", "background_source", "snr_db"], own.background_duration
    elif task == "speaker_drift":
        rows, truth, length = generate.drift(spark, sources["speakers"], n, seed, own), ["target_speaker_id", "first_appearance_timestamp", "target_return_timestamp", "speaker_order"], own.total_duration
    elif task == "soundscape":
        rows, truth, length = generate.soundscape(spark, n, seed, own, sources.get("clips")), ["events", "num_events"], own.duration
    else:
        clues = sources["clips"].where("kind = 'clue'")
        rows, truth, length = generate.narrative(spark, clues, n, seed, own), ["correct_verdict", "clue_type", "key_timestamps", "required_reasoning_steps"], own.duration
    metadata = [c for c in rows.columns if c not in {*truth, "i", "instance_id", "prompt"}]
    as_variant = [F.parse_json(F.to_json(F.struct(*cols) if cols else F.struct(F.lit(seed).alias("seed")))) for cols in (truth, metadata)]
    return rows.select("instance_id", F.lit(task).alias("task_name"), F.concat(F.lit(f"{task}/"), "instance_id", F.lit(".wav")).alias("audio_path"), F.lit(float(length)).alias("duration"), as_variant[0].alias("ground_truth"), "prompt", as_variant[1].alias("metadata"))


def generate_data(spark: SparkSession, config: dict, folder: str, wanted: str | list[str] = "all", split: str = "test") -> dict[str, str]:
    """Generate and save the chosen tasks from the configured sources; task ->
    path."""
    sources, out = files.discover_sources(spark, config.get("data", {})), {}
    for task in chosen(wanted, tasks.list_tasks()):
        out[task] = f"{folder}/{task}_{split}.jsonl"
        files.write_instances(generate_task(spark, task, sources, config.get("tasks", {}).get(task)), out[task])
    return out


#: What each task's evaluator reads of the ground truth, as typed columns.
TRUTH = {
    "anih": [("needle_timestamp", "string", "needle_timestamp"), ("preceding_sound", "string", "gt_sound")],
    "speaker_drift": [("target_speaker_id", "int", "target_speaker_id"), ("first_appearance_timestamp", "string", "first_appearance_timestamp")],
    "soundscape": [("events", "array<struct<event_type:string,start:string,end:string,overlaps:string>>", "true_events")],
    "narrative_coherence": [("correct_verdict", "string", "correct_verdict"), ("key_timestamps", "array<string>", "key_timestamps"), ("required_reasoning_steps", "array<string>", "required_reasoning_steps")],
}


def evaluate(spark: SparkSession, folder: str, wanted_tasks: str | list[str] = "all", wanted_models: str | list[str] = "all", split: str = "test", out: str | None = None, replicates: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Run the chosen models over the instances that are there and score them:
    (scores, responses).  ``out``: a folder for the result documents and their
    summary.  Unknown names and tasks without a file are skipped."""
    scores, responses = [], []
    for task, instances in files.read_splits(spark, chosen(wanted_tasks, tasks.list_tasks()), folder, split).items():
        typed = instances.select("instance_id", "audio_path", "prompt", *[F.expr(f"variant_get(ground_truth, '$.{name}', '{kind}')").alias(to) for name, kind, to in TRUTH[task]])
        for model in chosen(wanted_models, runner.available()):
            answers = runner.run(typed, model)
            if out:  # a model answers once
                answers.write.mode("overwrite").parquet(f"{out}/_answers/{task}_{model}")
                answers = spark.read.parquet(f"{out}/_answers/{task}_{model}")
            rows = typed.drop("audio_path", "prompt").join(answers, "instance_id").withColumnRenamed("response_text", "response")
            scores.append(long_scores(SCORE[task](rows), task, "instance_id"))
            responses.append(answers.select(F.lit(task).alias("task"), "model", "instance_id", F.col("response_text").alias("raw_response"), "latency_ms"))
    if not scores:
        raise FileNotFoundError(f"no instances of the chosen tasks in {folder}, or no chosen model")
    scores, responses = reduce(DataFrame.unionByName, scores), reduce(DataFrame.unionByName, responses)
    if out:
        summary = aggregate.with_intervals(aggregate.summarise(scores), aggregate.poisson_bootstrap(scores, replicates))
        heads = keep(files.result_heads(summary, responses), "heads")
        files.write_results(heads, responses, out)
        files.write_summary(heads, out)
    return scores, responses


def write_report(scores: DataFrame, latencies: DataFrame, folder: str, replicates: int = 10_000) -> None:
    """All tables, chart data and texts of a report.  ``latencies``: model,
    instance_id, latency_ms."""
    spark = scores.sparkSession
    models = sorted(r["model"] for r in scores.select("model").distinct().collect())
    summary = aggregate.summarise(scores)
    summary.write.mode("overwrite").parquet(f"{folder}/_summary")
    summary = spark.read.parquet(f"{folder}/_summary")
    cells = report.main_cells(aggregate.with_intervals(summary, aggregate.poisson_bootstrap(aggregate.primary(scores), replicates)), models)
    best = aggregate.best_models(summary)
    tables = {
        "main_table": cells, "detail_table": report.detail_table(summary, models), "heatmap": report.dense_grid(summary), "radar": report.radar(summary, models),
        "latency_accuracy": report.latency_accuracy(summary, aggregate.mean_latency(latencies)), "failure_breakdown": report.failure_breakdown(summary), "failures": report.failure_rows(scores, latencies),
    }
    for name, df in tables.items():
        files.write_csv(df, f"{folder}/{name}")
    files.write_text(spark, f"{folder}/summary.md", report.summary_markdown(cells, best))
    texts = {"main_table": cells.orderBy("task")} | {f"detail_{task}": tables["detail_table"].where(F.col("task") == task).drop("task").orderBy("metric") for task in report.PRIMARY}
    for name, df in texts.items():  # a table of all tasks, and one for each
        if rows := [r.asDict() for r in df.collect()]:
            files.write_text(spark, f"{folder}/{name}.tex", report.latex(rows, df.columns, name.replace("_", " ").capitalize(), f"tab:{name}"))
