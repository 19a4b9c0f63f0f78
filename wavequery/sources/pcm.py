"""Wave files as a splittable source.

A Python data source: a partition is a range of a file's bytes.  Each reads the
head of its file (some kilobytes) and then the frames that begin in its range,
so a long file is many tasks, and a limit in seconds skips what is beyond it.
Integers of 8, 16, 24 and 32 bits and 32-bit floats are decoded; anything else,
and a damaged file, is a row with an error and no samples.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "clip_id string, rate int, length long, frame_idx long, samples array<double>, error string"
HEAD, FRAMES_AT_ONCE = 1 << 16, 1 << 20


def header(raw: bytes, size: int) -> tuple[int, int, int, int, int, int]:
    """Kind of number (1 integer, 3 float), channels, rate, bytes of a number,
    where samples begin, and how many there are in a file of ``size`` bytes."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("no wave file")
    at, form = 12, None
    while at + 8 <= len(raw):
        name, n = raw[at : at + 4], int.from_bytes(raw[at + 4 : at + 8], "little")
        if name == b"fmt ":
            form = raw[at + 8 : at + 8 + n]
        if name == b"data":
            if form is None or len(form) < 16:
                raise ValueError("no format before the samples")
            kind, channels, rate, bits = (int.from_bytes(form[a:b], "little") for a, b in ((0, 2), (2, 4), (4, 8), (14, 16)))
            if kind == 0xFFFE and len(form) >= 26:  # extensible: the kind is in its name
                kind = int.from_bytes(form[24:26], "little")
            width = bits // 8
            if (kind, width) not in {(1, 1), (1, 2), (1, 3), (1, 4), (3, 4)} or not channels or not rate:
                raise ValueError(f"format {kind} of {bits} bits isn't read")
            n = min(n, size - at - 8) if n else size - at - 8
            return kind, channels, rate, width, at + 8, n // (width * channels)
        at += 8 + n + n % 2
    raise ValueError("no samples")


def numbers(raw: bytes, kind: int, width: int, channels: int) -> np.ndarray:
    """Mono samples in [-1, 1]."""
    if kind == 3:
        data = np.frombuffer(raw, "<f4").astype(np.float64)
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        data = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000
    else:
        data = np.frombuffer(raw, {1: "u1", 2: "<i2", 4: "<i4"}[width])
    out = data.reshape(-1, channels).astype(np.float64).mean(1)
    if kind == 1:
        out /= 1 << (8 * width - 1)
    return out - 1 if kind == 1 and width == 1 else out


class Part(InputPartition):
    def __init__(self, path: str, size: int, start: int, end: int) -> None:
        self.path, self.size, self.start, self.end = path, size, start, end


class PcmReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.frame = int(options.get("frame", "16000"))
        self.most = float(options["mostseconds"]) if "mostseconds" in options else None
        self.part = int(options.get("partbytes", str(16 << 20)))

    def partitions(self) -> list[InputPartition]:
        store, path = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted((x for x in files if x.type == fs.FileType.File and (x is info or x.path.lower().endswith(".wav"))), key=lambda x: x.path)
        return [Part(x.path, x.size, a, min(a + self.part, x.size)) for x in files for a in range(0, max(1, x.size), self.part)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)

        def rows(frame, values, rate, length, error=None):
            n = len(frame)
            samples = pa.array([None], pa.list_(pa.float64())) if error else pa.ListArray.from_arrays(pa.array(np.append(np.arange(0, len(values), self.frame), len(values)).astype(np.int32)), pa.array(values))
            columns = [pa.array([part.path] * n), pa.array([rate] * n, pa.int32()), pa.array([length] * n, pa.int64()), pa.array(frame, pa.int64()), samples, pa.array([error] * n, pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["clip_id", "rate", "length", "frame_idx", "samples", "error"])

        with store.open_input_file(part.path) as f:
            try:
                kind, channels, rate, width, at, length = header(f.read_at(HEAD, 0), part.size)
            except ValueError as e:
                if part.start == 0:  # once a file
                    yield rows([None], [], None, None, str(e))
                return
            wide = width * channels
            length = length if self.most is None else min(length, int(np.ceil(self.most * rate)))
            # Frames whose first byte is in the range; the head belongs to the first one.
            first, last = (max(0, -(-(x - at) // (wide * self.frame))) for x in (part.start, part.end))
            last = min(last, -(-length // self.frame))
            step = max(1, FRAMES_AT_ONCE // self.frame)
            for a in range(0 if part.start == 0 else first, last, step):
                b = min(a + step, last)
                n = min(length, b * self.frame) - a * self.frame
                values = numbers(f.read_at(n * wide, at + a * self.frame * wide), kind, width, channels)
                yield rows(range(a, b), values, rate, length)


class PcmSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcm"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PcmReader(self.options)
