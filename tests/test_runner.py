"""Models stay loaded, batches are bounded, failures stay with their rows."""

import os
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from wavequery.plans import runner

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Batched(runner.Model):
    needs = ("log",)

    def load(self):
        with open(self.options["log"], "a") as f:
            f.write(f"{os.getpid()}\n")

    def predict(self, audio_path, prompt):
        if audio_path == "bad":
            raise ValueError("no audio")
        return f"{audio_path} alone"

    def predict_many(self, rows):
        if any(path == "bad" for path, _ in rows):
            raise ValueError("one is bad")
        return [f"{path} of {len(rows)}" for path, _ in rows]


def test_a_worker_loads_once(spark, tmp_path):
    runner.register("batched", Batched)
    df = spark.range(40).select(F.col("id").cast("string").alias("instance_id"), F.concat(F.lit("a"), "id").alias("audio_path"), F.lit("?").alias("prompt"), F.lit(250.0).alias("duration")).repartition(8)
    for _ in range(2):  # another job finds the model where it is
        rows = runner.run(df, "batched", log=f"{tmp_path}/loads").collect()
        assert len(rows) == 40 and all(r["error"] is None and r["latency_ms"] >= 0 for r in rows)
        assert {r["response_text"].split(" of ")[1] for r in rows} <= {"1", "2"}  # 500 of 600 seconds
    loads = (tmp_path / "loads").read_text().split()
    assert len(loads) == len(set(loads))


def test_a_failing_row_fails_alone(spark, tmp_path):
    runner.register("batched", Batched)
    df = spark.createDataFrame([("1", "x", "?"), ("2", "bad", "?"), ("3", "y", "?")], "instance_id string, audio_path string, prompt string").coalesce(1)
    rows = {r["instance_id"]: r for r in runner.run(df, "batched", log=f"{tmp_path}/loads").collect()}
    assert rows["2"]["error"] == "ValueError: no audio" and rows["2"]["response_text"] is None and rows["2"]["latency_ms"] is None
    assert rows["1"]["response_text"] == "x alone" and rows["3"]["response_text"] == "y alone"


def test_batches_are_bounded():
    rows = [(i, s) for i, s in enumerate([100.0, 500.0, 1.0, 900.0, 0.0, 0.0])]
    assert [[x[0] for x in b] for b in runner.bounded(rows, 600.0, 64)] == [[0, 1], [2], [3], [4, 5]]
    assert [len(b) for b in runner.bounded([(0, 0.0)] * 130, 600.0, 64)] == [64, 64, 2]
