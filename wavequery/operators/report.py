"""Report tables.  Spark pivots numbers; strings are made on the driver, from
tables of tasks by models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregate import best_models, primary
from .evaluators import PRIMARY


def dense_grid(summary: DataFrame) -> DataFrame:
    """Every task with every model, ``mean`` NULL where there is no result.
    Both axes are lists of names, as long as the report's table."""
    tasks, models = summary.select("task").distinct(), summary.agg(F.collect_set("model").alias("models"))
    grid = tasks.join(models).select("task", F.explode("models").alias("model"))
    return grid.join(primary(summary).select("task", "model", "mean"), ["task", "model"], "left")


def main_table(summary: DataFrame, models: list[str]) -> DataFrame:
    """One row a task, one column a model: the mean of the primary metric."""
    return primary(summary).groupBy("task").pivot("model", models).agg(F.first("mean"))


def main_cells(summary: DataFrame, models: list[str]) -> DataFrame:
    """One row a task, one column a model: ``mean [low, high]`` of the primary
    metric, to three digits; a missing interval is [0, 0], a missing result a
    dash.  ``summary`` has ci_lo and ci_hi."""
    text = F.format_string("%.3f [%.3f, %.3f]", "mean", F.coalesce("ci_lo", F.lit(0.0)), F.coalesce("ci_hi", F.lit(0.0)))
    wide = primary(summary).withColumn("cell", text).groupBy("task").pivot("model", models).agg(F.first("cell"))
    return wide.select("task", *[F.coalesce(m, F.lit("—")).alias(m) for m in models])


def radar(summary: DataFrame, models: list[str]) -> DataFrame:
    """One row a model, one column a task: the primary mean, 0 where there is no
    result."""
    tasks = list(PRIMARY)
    wide = primary(summary).where(F.col("model").isin(models)).groupBy("model").pivot("task", tasks).agg(F.first("mean"))
    return wide.select("model", *[F.coalesce(t, F.lit(0.0)).alias(t) for t in tasks])


def scaling(scores: DataFrame, instances: DataFrame, minutes: float = 10) -> DataFrame:
    """Mean primary score by length of the audio, in steps of ``minutes``;
    ``instances``: instance_id, duration in seconds."""
    rows = primary(scores).join(instances.select("instance_id", "duration"), "instance_id")
    return rows.groupBy("task", "model", F.floor(F.col("duration") / (60 * minutes)).alias("step")).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))


def detail_table(summary: DataFrame, models: list[str]) -> DataFrame:
    """One row a task and metric, two columns a model: mean and std."""
    return summary.groupBy("task", "metric").pivot("model", models).agg(F.first("mean").alias("mean"), F.first("std").alias("std"))


def failure_rows(scores: DataFrame, latencies: DataFrame) -> DataFrame:
    """One row an answer, worst first by primary metric; latency -1 if unknown."""
    rows = primary(scores).join(latencies, ["model", "instance_id"], "left")
    rows = rows.select("task", "model", "instance_id", F.coalesce("latency_ms", F.lit(-1.0)).alias("latency_ms"), F.col("value").alias("score"))
    return rows.orderBy(F.asc_nulls_first("score"), "task", "model", "instance_id")


def failure_breakdown(summary: DataFrame) -> DataFrame:
    """The other metrics of each task's best model."""
    best = best_models(summary).select("task", "model")
    return summary.join(best, ["task", "model"]).where("metric <> 'composite_score'").select("task", "model", "metric", "mean")


def latency_accuracy(summary: DataFrame, latency: DataFrame) -> DataFrame:
    """Points of mean latency, in seconds, against the primary metric."""
    points = primary(summary).join(latency, "model")
    return points.select("task", "model", (F.col("avg_latency_ms") / 1000).alias("latency_s"), F.col("mean").alias("accuracy"))


def by_bucket(scores: DataFrame, position, width: float, name: str) -> DataFrame:
    """Mean scores by bucket of a position (depth, duration): an extension."""
    return scores.groupBy(F.floor(position / width).alias(name), "metric").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------ driver strings
def markdown(rows: list[dict], columns: list[str]) -> str:
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    lines += ["| " + " | ".join("—" if r.get(c) is None else f"{r[c]:.3f}" if isinstance(r[c], float) else str(r[c]) for c in columns) + " |" for r in rows]
    return "\n".join(lines) + "\n"


def summary_markdown(cells: DataFrame, best: DataFrame) -> str:
    """The main table and each task's best model; tables of tasks by models."""
    text = "# Results\n\n" + markdown([r.asDict() for r in cells.orderBy("task").collect()], cells.columns)
    lines = [f"- {r['task']}: {r['model']} ({r['score']:.3f})\n" for r in best.orderBy("task").collect()]
    return text + "\n## Best model of each task\n\n" + "".join(lines)


def latex(rows: list[dict], columns: list[str], caption: str = "", label: str = "") -> str:
    def text(v) -> str:
        v = "--" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
        return v.replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")

    body = "\n".join(" & ".join(text(r.get(c)) for c in columns) + r" \\" for r in rows)
    head = " & ".join(text(c) for c in columns) + r" \\"
    note = (f"\\caption{{{caption}}}\n" if caption else "") + (f"\\label{{{label}}}\n" if label else "")
    return f"\\begin{{table}}\n{note}\\begin{{tabular}}{{l{'r' * (len(columns) - 1)}}}\n\\hline\n{head}\n\\hline\n{body}\n\\hline\n\\end{{tabular}}\n\\end{{table}}\n"
