"""Result documents and audio files are written line by line and frame by frame."""

import json

import numpy as np
from pyspark.sql import functions as F

from wavequery.sources import files


def test_result_documents_read_back(spark, tmp_path):
    rows = [("anih", m, f"i{k}", f'says "{k}"\n, or  {{"x": ]', float(k % 3 - 1)) for m in ("a/b", "c") for k in range(25)]
    rows += [("drift", "c", "only", None, None), ("drift", "c", "only", None, None), ("drift", "c", None, "x", 2.0)]
    responses = spark.createDataFrame(rows, "task string, model string, instance_id string, raw_response string, latency_ms double").repartition(5)
    summary = spark.createDataFrame([("anih", "c", "m", 1.0, 0.5, 1.0, 0.1, 0.9), ("anih", "c", "k", 1.0, 0.5, 1.0, None, None)], "task string, model string, metric string, mean double, std double, median double, ci_lo double, ci_hi double")
    heads = files.result_heads(summary, responses)
    files.write_results(heads, responses, str(tmp_path))
    assert sorted(x.name for x in tmp_path.glob("*.json")) == ["anih_a_b_results.json", "anih_c_results.json", "drift_c_results.json"]
    text = json.loads((tmp_path / "anih_c_results.json").read_text())
    assert [p["instance_id"] for p in text["predictions"]] == sorted(f"i{k}" for k in range(25)) and text["metrics"]["m"]["ci_95"] == [0.1, 0.9] and text["metrics"]["k"]["ci_95"] is None
    back = files.read_results(spark, str(tmp_path)).select("task", "model", "num_instances", F.explode("predictions").alias("p")).select("task", "model", "p.*")
    want = sorted(((t, m, i, r, -1.0 if s is None else s) for t, m, i, r, s in rows), key=str)
    assert sorted((tuple(r) for r in back.collect()), key=str) == want
    assert json.loads(files.summary_json(heads))["drift"]["c"]["num_instances"] == 3


def test_a_task_without_answers_has_no_document(spark, tmp_path):
    responses = spark.createDataFrame([], "task string, model string, instance_id string, raw_response string, latency_ms double")
    summary = spark.createDataFrame([], "task string, model string, metric string, mean double, std double, median double, ci_lo double, ci_hi double")
    files.write_results(files.result_heads(summary, responses), responses, str(tmp_path))
    assert not list(tmp_path.glob("*.json"))


def test_many_answers_are_no_row(spark, tmp_path):
    """200,000 answers in one document: the largest row that is made is a line."""
    responses = spark.range(200_000).select(F.lit("anih").alias("task"), F.lit("m").alias("model"), F.lpad(F.col("id").cast("string"), 9, "0").alias("instance_id"), F.repeat(F.lit("answer "), 10).alias("raw_response"), F.lit(1.0).alias("latency_ms"))
    summary = spark.createDataFrame([("anih", "m", "k", 1.0, 0.5, 1.0, None, None)], "task string, model string, metric string, mean double, std double, median double, ci_lo double, ci_hi double")
    heads = files.result_heads(summary, responses)
    assert files._lines(heads, responses).agg(F.max(F.length("value"))).first()[0] < 1000
    files.write_results(heads, responses, str(tmp_path))
    got = files.read_results(spark, str(tmp_path)).select(F.size("predictions").alias("n"), F.element_at("predictions", -1)["instance_id"].alias("last")).first()
    assert (got["n"], got["last"]) == (200_000, "000199999")


def test_audio_is_written_frame_by_frame(spark, tmp_path):
    rng = np.random.default_rng(2)
    clips = {name: rng.uniform(-1, 1, n) for name, n in (("a", 1000), ("b", 333), ("c", 1))}
    rows = [(name, f, x[f * 100 : (f + 1) * 100].tolist()) for name, x in clips.items() for f in range(-(-len(x) // 100))]
    frames = spark.createDataFrame(rows, "clip_id string, frame_idx long, samples array<double>").repartition(4)
    got = {r["clip_id"]: r["n"] for r in files.write_wav(frames, str(tmp_path), 800).collect()}
    assert got == {k: len(x) for k, x in clips.items()} and sorted(x.name for x in tmp_path.iterdir() if not x.name.startswith(".")) == ["a.wav", "b.wav", "c.wav"]
    for name, x in clips.items():
        assert (tmp_path / f"{name}.wav").read_bytes() == files.encode_wav(x, 800)
