"""Models over instances: (instance_id, audio_path, prompt) to responses.

A model is loaded once a worker process and stays for its life, over tasks and
stages.  Rows go to it in batches of bounded seconds of audio; a failing row
carries its error and doesn't end the job.  Real models need weights, and devices
that a resource profile asks for, and are plugged in by ``register``; ``echo`` is
deterministic and serves tests.
"""

from __future__ import annotations

import hashlib
import sys
import time
import types
import zlib
from abc import ABC, abstractmethod

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "instance_id string, model string, response_text string, latency_ms double, error string"


class Model(ABC):
    """What a runner needs: ``load`` once, then ``predict`` each instance.
    ``needs``: options without which there is no such model."""

    needs: tuple[str, ...] = ()

    def __init__(self, **options) -> None:
        self.options = options

    def load(self) -> None:
        """Weights and devices."""

    @abstractmethod
    def predict(self, audio_path: str, prompt: str) -> str: ...

    def predict_many(self, rows: list[tuple[str, str]]) -> list[str] | None:
        """Answers to (audio_path, prompt) of a batch; None: one by one."""
        return None


class Echo(Model):
    """Answers from a checksum of the question; every ``fail``-th one fails."""

    def predict(self, audio_path: str, prompt: str) -> str:
        h = zlib.crc32(f"{audio_path}|{prompt}".encode())
        if h % self.options.get("fail", 10) == 0:
            raise ValueError("no answer")
        return f"Timestamp: {h // 7 % 60:02d}:{h // 11 % 60:02d}, Preceding sound: pages turning"


class Cascaded(Model):
    """Speech recognition, then a language model: ``transcribe(audio_path)`` and
    ``answer(transcript, prompt)``, which bring their own weights."""

    needs = ("transcribe", "answer")

    def predict(self, audio_path: str, prompt: str) -> str:
        return self.options["answer"](self.options["transcribe"](audio_path), prompt)


class Native(Model):
    """A model that hears: ``start()`` loads it where it runs and returns
    ``answer(audio_path, prompt)``."""

    needs = ("start",)

    def load(self) -> None:
        self.answer = self.options["start"]()

    def predict(self, audio_path: str, prompt: str) -> str:
        return self.answer(audio_path, prompt)


class QwenAudio(Native):
    """Qwen2-Audio; weights and package are the caller's."""


class Ltu(Native):
    """Listen, think, understand; weights and package are the caller's."""


MODELS: dict[str, type[Model]] = {"echo": Echo, "cascaded": Cascaded, "qwen_audio": QwenAudio, "ltu": Ltu}


def available() -> list[str]:
    """Models that run without options."""
    return [name for name, model in MODELS.items() if not model.needs]


def register(name: str, model: type[Model]) -> None:
    MODELS[name] = model


def get_model(name: str, **options) -> Model:
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}; there are {', '.join(MODELS)}")
    missing = [x for x in MODELS[name].needs if x not in options]
    if missing:
        raise ValueError(f"model {name!r} needs {', '.join(missing)}")
    return MODELS[name](**options)


#: Seconds of audio, and rows, that a batch has at most (or one row).
SECONDS, ROWS = 600.0, 64


def _loaded(key: str, model: Model) -> Model:
    """The model of this worker process, loaded when it is first asked for."""
    kept = sys.modules.setdefault("_kept_models", types.ModuleType("_kept_models"))
    models = kept.__dict__.setdefault("models", {})
    if key not in models:
        model.load()
        models[key] = model
    return models[key]


def bounded(rows: list[tuple], seconds: float = SECONDS, most: int = ROWS):
    """Batches of rows (the last field: seconds) in order."""
    batch, total = [], 0.0
    for row in rows:
        if batch and (total + row[-1] > seconds or len(batch) == most):
            yield batch
            batch, total = [], 0.0
        batch.append(row)
        total += row[-1]
    if batch:
        yield batch


def answers(model: Model, name: str, rows: list[tuple]) -> list[tuple]:
    """``SCHEMA`` of a batch of (instance_id, audio_path, prompt, seconds).  If a
    batch fails its rows are asked one by one; a row of a batch takes its share of
    the batch's time."""
    began = time.perf_counter()
    try:
        texts = model.predict_many([(path, prompt) for _, path, prompt, _ in rows])
    except Exception:
        texts = None
    if texts is not None:
        each = (time.perf_counter() - began) * 1000 / len(rows)
        return [(i, name, text, each, None) for (i, *_), text in zip(rows, texts, strict=True)]
    out = []
    for i, path, prompt, _ in rows:
        began = time.perf_counter()
        try:
            out.append((i, name, model.predict(path, prompt), (time.perf_counter() - began) * 1000, None))
        except Exception as e:  # the row is a miss, the job goes on
            out.append((i, name, None, None, f"{type(e).__name__}: {e}"))
    return out


def run(instances: DataFrame, name: str, *, profile=None, seconds: float = SECONDS, **options) -> DataFrame:
    """Responses of a model to instance_id, audio_path and prompt, and duration
    (seconds) where there is one.  ``profile``: a ``ResourceProfile`` for the
    stage, with the devices that the model needs."""
    model = get_model(name, **options)
    key = hashlib.sha256(cloudpickle.dumps((name, options))).hexdigest()
    length = F.coalesce(F.col("duration").cast("double"), F.lit(0.0)) if "duration" in instances.columns else F.lit(0.0)

    def answer(batches):
        own = _loaded(key, model)
        for batch in batches:
            rows = list(zip(batch.instance_id, batch.audio_path, batch.prompt, batch.duration))
            out = [x for some in bounded(rows, seconds) for x in answers(own, name, some)]
            yield pd.DataFrame(out, columns=["instance_id", "model", "response_text", "latency_ms", "error"])

    return instances.select("instance_id", "audio_path", "prompt", length.alias("duration")).mapInPandas(answer, SCHEMA, profile=profile)
