"""Sources and sinks: instances as JSON lines, result documents, tables, audio."""

from __future__ import annotations

import io
import json
import struct
import sys
import wave
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.resample import resample
from . import pcm

cloudpickle.register_pickle_by_value(sys.modules[__name__])

INSTANCE = T.StructType(
    [T.StructField(n, t) for n, t in (("instance_id", T.StringType()), ("task_name", T.StringType()), ("audio_path", T.StringType()), ("duration", T.DoubleType()), ("ground_truth", T.VariantType()), ("prompt", T.StringType()), ("metadata", T.VariantType()))]
)
RESULT = "task string, model string, num_instances long, metrics map<string, struct<mean: double, std: double, median: double, ci_95: array<double>>>, avg_latency_ms double, predictions array<struct<instance_id: string, raw_response: string, latency_ms: double>>"


def read_instances(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; ground truth and metadata stay VARIANT until a task types them.
    A line that is no JSON object is an error."""
    return spark.read.schema(INSTANCE).option("mode", "FAILFAST").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_split(spark: SparkSession, task: str, folder: str, split: str = "test") -> DataFrame:
    path = f"{folder}/{task}_{split}.jsonl"
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return read_instances(spark, path)


def read_splits(spark: SparkSession, tasks: list[str], folder: str, split: str = "test") -> dict[str, DataFrame]:
    """Instances of the tasks whose file is there; others are skipped."""
    return {t: read_split(spark, t, folder, split) for t in tasks if exists(spark, f"{folder}/{t}_{split}.jsonl")}


def write_instances(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """All ``*_results.json`` of a folder; of several for one task and model the
    last by path counts."""
    rows = spark.read.schema(RESULT).option("multiLine", True).option("pathGlobFilter", "*_results.json").json(folder)
    rows = rows.withColumn("_path", F.input_file_name())
    return last_by(rows, ["task", "model"], "_path").drop("_path")


def last_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    last = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def result_heads(summary: DataFrame, responses: DataFrame) -> DataFrame:
    """One row a task and model: ``RESULT`` without predictions.  ``summary`` has
    ci_lo and ci_hi; ``responses``: task, model, instance_id, raw_response,
    latency_ms."""
    ci = F.when(F.col("ci_lo").isNotNull(), F.array("ci_lo", "ci_hi"))
    metrics = summary.groupBy("task", "model").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", F.struct("mean", "std", "median", ci.alias("ci_95")).alias("v"))))).alias("metrics"))
    ms = F.col("latency_ms")
    answers = responses.groupBy("task", "model").agg(F.count(F.lit(1)).alias("num_instances"), F.coalesce(F.avg(F.when(ms > 0, ms)), F.lit(0.0)).alias("avg_latency_ms"))
    return answers.join(metrics, ["task", "model"], "left").select("task", "model", "num_instances", "metrics", "avg_latency_ms")


def _lines(heads: DataFrame, responses: DataFrame) -> DataFrame:
    """The documents line by line: (task, model, place, instance_id, value).  A
    document opens with its head, has a line for each answer, and closes."""
    full = {"ignoreNullFields": "false"}
    head = F.to_json(F.struct(*heads.columns), full)
    ends = heads.select("task", "model", F.explode(F.array(F.struct(F.lit(0).alias("place"), F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(', "predictions": [')).alias("value")), F.struct(F.lit(2).alias("place"), F.lit("]}").alias("value")))).alias("x"))
    ends = ends.select("task", "model", "x.place", F.lit(None).cast("string").alias("instance_id"), "x.value")
    answer = F.to_json(F.struct("instance_id", "raw_response", F.coalesce("latency_ms", F.lit(-1.0)).alias("latency_ms")), full)
    first = F.row_number().over(Window.partitionBy("task", "model").orderBy("instance_id", "raw_response", "latency_ms")) == 1
    comma = F.when(first, "").otherwise(",")
    return ends.unionByName(responses.select("task", "model", F.lit(1).alias("place"), F.col("instance_id").cast("string").alias("instance_id"), F.concat(comma, answer).alias("value")))


def write_results(heads: DataFrame, responses: DataFrame, folder: str) -> None:
    """``{task}_{model}_results.json`` in the folder for each head, as
    ``read_results`` reads them; others that are there stay.

    A document is one file, so one task writes it, but line by line from Spark's
    sort: no row or task holds its answers.  Files get their names when all are
    written."""
    spark = heads.sparkSession
    aside = f"{folder}/_results"
    lines = _lines(heads, responses).repartition("task", "model").sortWithinPartitions("task", "model", "place", "instance_id", F.desc(F.col("value").startswith("{")))
    lines.select("task", "model", "value").write.mode("overwrite").option("maxRecordsPerFile", 0).partitionBy("task", "model").text(aside)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(aside).getFileSystem(spark._jsc.hadoopConfiguration())
    for own in fs.globStatus(path(f"{aside}/task=*/model=*/part-*")):  # a short list: tasks by models
        model, task = (unquote(x.getName().partition("=")[2]).replace("/", "_") for x in (own.getPath().getParent(), own.getPath().getParent().getParent()))
        to = path(f"{folder}/{task}_{model}_results.json")
        fs.delete(to, False)
        fs.rename(own.getPath(), to)
    fs.delete(path(aside), True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, by Spark's file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    out.write(bytearray(text.encode()))
    out.close()


def summary_json(heads: DataFrame) -> str:
    """task -> model -> result without predictions; tasks by models in size."""
    out: dict = {}
    for r in heads.select(F.to_json(F.struct(*heads.columns)).alias("j")).collect():
        x = json.loads(r["j"])
        out.setdefault(x["task"], {})[x["model"]] = x
    return json.dumps(out, indent=2, sort_keys=True)


def write_summary(heads: DataFrame, folder: str) -> None:
    write_text(heads.sparkSession, f"{folder}/summary.json", summary_json(heads))


def score_documents(scores: DataFrame) -> DataFrame:
    """The aggregator as rows to write: one JSON document for each answer, with
    its metrics by name; errors without a value are NULL."""
    metrics = F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("metrics")
    return scores.groupBy("task", "model", "instance_id").agg(metrics).select(F.to_json(F.struct("task", "model", "instance_id", "metrics"), {"ignoreNullFields": "false"}).alias("value"))


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files, written by all tasks."""
    df.write.mode("overwrite").option("header", True).csv(path)


# ------------------------------------------------------------------- audio
def decode_wav(raw: bytes, most_seconds: float | None = None) -> tuple[np.ndarray, int]:
    """Mono samples in [-1, 1] and the sample rate of a file in memory; no more
    than ``most_seconds`` are decoded."""
    kind, channels, rate, width, at, n = pcm.header(raw, len(raw))
    n = n if most_seconds is None else min(n, int(np.ceil(most_seconds * rate)))
    return pcm.numbers(raw[at : at + n * width * channels], kind, width, channels), rate


def pcm_16(samples) -> bytes:
    return np.rint(np.clip(np.asarray(samples), -1, 1) * 32767).astype("<i2").tobytes()


def encode_wav(samples, rate: int = 16_000) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(pcm_16(samples))
    return out.getvalue()


def read_pcm(spark: SparkSession, path: str, size: int = 16_000, most_seconds: float | None = None, part_bytes: int = 16 << 20) -> DataFrame:
    """WAV files (one, or all below a folder) as frames of their own rate:
    clip_id, rate, length (samples), frame_idx, samples, error.  Ranges of
    ``part_bytes`` are tasks; no more than ``most_seconds`` of a file are read; a
    file that can't be read is a row with an error."""
    spark.dataSource.register(pcm.PcmSource)
    reader = spark.read.format("pcm").option("frame", size).option("partBytes", part_bytes)
    return (reader if most_seconds is None else reader.option("mostSeconds", most_seconds)).load(path)


def read_audio(spark: SparkSession, path: str, size: int = 16_000, rate: int = 16_000, most_seconds: float | None = None) -> DataFrame:
    """The same files as frames of one rate, clip_id, frame_idx, samples, cut to
    ``most_seconds``; files with errors are left out."""
    return resample(read_pcm(spark, path, size, most_seconds).where("error is null"), size, rate)


def wav_bytes(frames: DataFrame, rate: int = 16_000) -> DataFrame:
    """clip_id and its WAV file as one value; for clips that fit into a row."""

    def one(key, table):
        values = table.sort_by("frame_idx").column("samples").combine_chunks().flatten().to_numpy()
        return pa.table({"clip_id": pa.array([str(key[0].as_py())]), "content": pa.array([encode_wav(values, rate)], pa.binary())})

    return frames.groupBy("clip_id").applyInArrow(one, "clip_id string, content binary")


def write_wav(frames: DataFrame, folder: str, rate: int = 16_000) -> DataFrame:
    """``{clip_id}.wav`` in a folder (of a store that Arrow knows) for each clip:
    clip_id, path and the number of samples.

    A file is one task's, which writes frame by frame as Spark's sort gives them:
    the head, then samples, so memory doesn't grow with a clip.  The number of
    samples, which the head has, is summed before.  A file has another name until
    it is whole, so a task that is repeated does no harm."""
    sizes = frames.groupBy(F.col("clip_id").cast("string").alias("clip_id")).agg(F.sum(F.size("samples")).alias("n"))
    rows = frames.select(F.col("clip_id").cast("string").alias("clip_id"), "frame_idx", "samples").join(sizes, "clip_id")

    def run(batches):
        store, base = arrow_fs.FileSystem.from_uri(folder)
        store.create_dir(base)
        out, at, done = None, None, []

        def close():
            out.close()
            store.move(f"{base}/.{at[0]}.part", f"{base}/{at[0]}.wav")
            done.append((at[0], f"{base}/{at[0]}.wav", at[1]))

        for batch in batches:
            for clip, n, samples in zip(batch.column("clip_id").to_pylist(), batch.column("n").to_pylist(), batch.column("samples")):
                if at is None or clip != at[0]:
                    if at is not None:
                        close()
                    at, out = (clip, n), store.open_output_stream(f"{base}/.{clip}.part")
                    out.write(b"RIFF" + struct.pack("<I", (36 + 2 * n) & 0xFFFFFFFF) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", (2 * n) & 0xFFFFFFFF))
                out.write(pcm_16(np.asarray(samples.values)))
        if at is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["clip_id", "path", "n"])

    return rows.repartition("clip_id").sortWithinPartitions("clip_id", "frame_idx").mapInArrow(run, "clip_id string, path string, n long")


# --------------------------------------------------------------- catalogues
CLIPS = "kind string, category string, path string, duration double"
SPEAKERS = "dataset string, speaker_id string, path string, duration double, gender string, accent string"
STORIES = "source string, path string, duration double, transcript string"


def _audio(spark: SparkSession, folder: str, glob: str = "*.{wav,flac,mp3}") -> DataFrame:
    """Paths below a folder, and their parts; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return files.select("path", F.split("path", "/").alias("parts"))


def _typed(rows: DataFrame, schema: str) -> DataFrame:
    fields = [x.split() for x in schema.split(", ")]
    return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])


def discover(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Clips of a kind (background, needle, clue, event): one folder a category."""
    rows = _audio(spark, folder).select(F.lit(kind).alias("kind"), F.element_at("parts", -2).alias("category"), "path")
    return _typed(rows, CLIPS)


#: How many folders above its files a speaker's own folder is: id/video/file,
#: meeting/speaker/file, speaker/chapter/file.
SPEAKER_LEVEL = {"voxceleb2": 3, "ami": 2, "librispeech": 3}


def speakers(spark: SparkSession, folder: str, dataset: str) -> DataFrame:
    """One row a speaker, with the first of their files."""
    rows = _audio(spark, folder).withColumn("speaker_id", F.try_element_at("parts", F.lit(-SPEAKER_LEVEL[dataset]))).where("speaker_id is not null")
    return _typed(rows.groupBy("speaker_id").agg(F.min("path").alias("path")).withColumn("dataset", F.lit(dataset)), SPEAKERS)


def stories(spark: SparkSession, folder: str, source: str) -> DataFrame:
    """One row a story, its file; a text file of the same name is its transcript."""
    rows = _audio(spark, folder).select(F.lit(source).alias("source"), "path", F.regexp_replace("path", r"\.[^./]+$", "").alias("name"))
    texts = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(folder)
    texts = texts.select(F.regexp_replace("path", r"\.[^./]+$", "").alias("name"), F.col("content").cast("string").alias("transcript"))
    return _typed(rows.join(texts, "name", "left"), STORIES)


def merged(*catalogues: DataFrame) -> DataFrame:
    """One catalogue of several: a union, nothing is overwritten."""
    out = catalogues[0]
    for c in catalogues[1:]:
        out = out.unionByName(c)
    return out.distinct()


#: Configured name -> (table, kind, dataset or source).
SOURCES = {
    "audioset": ("clips", "background"), "fsd50k": ("clips", "background"), "acoustic_clues": ("clips", "clue"), "event_audio": ("clips", "event"), "needles": ("clips", "needle"),
    "voxceleb2": ("speakers", "voxceleb2"), "ami": ("speakers", "ami"), "librispeech": ("speakers", "librispeech"),
    "librivox": ("stories", "librivox"), "spotify_podcasts": ("stories", "spotify_podcasts"), "gigaspeech": ("stories", "gigaspeech"),
}


def discover_sources(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """The tables clips, speakers and stories of all configured paths that are
    there; unknown names and missing paths are left out."""
    readers, schemas = {"clips": discover, "speakers": speakers, "stories": stories}, {"clips": CLIPS, "speakers": SPEAKERS, "stories": STORIES}
    out = {t: [spark.createDataFrame([], s)] for t, s in schemas.items()}
    for name, path in (paths or {}).items():
        if name in SOURCES and path and exists(spark, path):
            table, kind = SOURCES[name]
            out[table].append(readers[table](spark, path, kind))
    return {t: merged(*rows) for t, rows in out.items()}
