"""Tasks: configuration, prompts, the registry."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


# Defaults, names and prompts that instances and answers rely on.
@dataclass(frozen=True)
class AnihConfig:
    background_duration: float = 3600.0
    needle_duration: float = 0.5
    needle_types: tuple[str, ...] = ("glass_shatter", "pen_click", "phone_notification", "door_slam", "keyboard_click")
    insertion_depths: tuple[float, ...] = ()
    snr_db: float = 10.0
    background_sources: tuple[str, ...] = ("library", "office", "lecture")
    preceding_sounds: dict[str, str] = field(default_factory=lambda: {"library": "pages turning", "office": "keyboard typing", "lecture": "professor speaking"})


@dataclass(frozen=True)
class DriftConfig:
    total_duration: float = 3600.0
    num_speakers: int = 5
    target_speaker_id: int = 2
    initial_speech_duration: float = 120.0
    silence_duration: float = 2400.0
    final_speech_time: float = 2595.0
    final_speech_duration: float = 10.0
    speaker_similarity: str = "high"
    dataset_sources: tuple[str, ...] = ("voxceleb2", "ami", "librispeech")


@dataclass(frozen=True)
class SoundscapeConfig:
    duration: float = 1800.0
    num_events: int = 8
    event_types: tuple[str, ...] = (
        "rain_start", "rain_stop", "rain_heavy", "rain_light",
        "wind_start", "wind_stop", "wind_howling",
        "thunder", "siren_approaching", "siren_passing", "siren_receding",
        "dog_barking", "bird_chorus", "traffic_increase", "traffic_decrease",
        "footsteps", "door_open", "door_close", "engine_start", "engine_stop",
        "crowd_cheer", "crowd_applause", "music_start", "music_stop",
    )
    overlap_allowed: bool = True
    min_event_duration: float = 10.0
    max_event_duration: float = 120.0
    dataset_sources: tuple[str, ...] = ("audioset", "fsd50k", "dcase2024", "tut_acoustic_scenes")


@dataclass(frozen=True)
class NarrativeConfig:
    duration: float = 2400.0
    story_sources: tuple[str, ...] = ("librivox", "spotify_podcasts", "gigaspeech")
    clue_types: tuple[str, ...] = ("clock_chime", "distinctive_bell", "unique_bird_call", "train_whistle", "church_bell", "factory_whistle", "ice_cream_truck", "emergency_alert")
    reasoning_depth: int = 3


PROMPTS = {
    "anih": "Listen carefully to the entire audio recording. At what exact timestamp (in MM:SS format) did the {needle_type} occur, and what environmental sound immediately preceded it (within 5 seconds)? Provide your answer as: 'Timestamp: MM:SS, Preceding sound: <description>'",
    "speaker_drift": "This is a {duration_minutes}-minute panel discussion with {num_speakers} speakers who have very similar voices. Listen to the entire recording carefully. At timestamp {target_timestamp}, a speaker says a single sentence. Identify which speaker this is (Speaker 1-{num_speakers}). Has this speaker spoken previously in the audio? If yes, provide the timestamp of their first appearance in MM:SS format. Answer format: 'Speaker: X, First appearance: MM:SS (or \"Never\")'",
    "soundscape": "Listen to this {duration_minutes}-minute environmental recording. Construct a strict chronological timeline of all weather and environmental changes. For each change, specify: (1) the event type, (2) start timestamp (MM:SS), (3) end timestamp (MM:SS) or 'ongoing', (4) any overlapping sounds. Format as a numbered list: '1. Event: rain_start, Start: 02:15, End: 15:30, Overlaps: wind_howling (from 05:00)'",
    "narrative_coherence": "Listen to this {duration_minutes}-minute audio story/podcast carefully. At the beginning, a distinctive acoustic event occurs (Clue A). In the middle, a character references this event as a temporal marker (Clue B). Near the end, a suspect provides an alibi that may contradict the acoustic evidence (Clue C). Question: Does the acoustic evidence from the first half of the recording validate or debunk the suspect's alibi? Walk through the logical chain step-by-step, citing specific timestamps for each clue. Answer format: 'Verdict: Validates/Debunks/Inconclusive. Reasoning: Step 1: ... Step 2: ... Step 3: ...'",
}

CONFIGS = {"anih": AnihConfig, "speaker_drift": DriftConfig, "soundscape": SoundscapeConfig, "narrative_coherence": NarrativeConfig}


def list_tasks() -> list[str]:
    return list(CONFIGS)


def config(task: str, **values):
    """The task's configuration with some values changed; keys that belong to
    the generator (num_instances) or to no field are left out."""
    if task not in CONFIGS:
        raise ValueError(f"unknown task {task!r}; there are {', '.join(CONFIGS)}")
    known = {f.name for f in fields(CONFIGS[task])}
    return replace(CONFIGS[task](), **{k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known})


def create_task_suite(names: list[str] | None = None, configs: dict | None = None) -> dict:
    """Name -> configuration of the tasks, all by default."""
    return {t: config(t, **(configs or {}).get(t, {})) for t in (names or list_tasks())}


def load_config(path: str) -> dict:
    import yaml

    with open(path) as f:
        return yaml.safe_load(f) or {}


def save_config(values: dict, path: str) -> None:
    import yaml

    with open(path, "w") as f:
        yaml.safe_dump(values, f, sort_keys=False)


def prompt(task: str, **values: Column) -> Column:
    """The task's prompt with columns in its places."""
    parts = re.split(r"\{(\w+)\}", PROMPTS[task])
    return F.concat(*[values[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)])
