"""The audio source and the resampling filter."""

import math
import struct
import wave

import numpy as np
import pytest

from wavequery.operators import resample as filters
from wavequery.sources import files, pcm


def written(path, values, rate, width=2, channels=1):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        top = (1 << (8 * width - 1)) - 1
        x = np.rint(np.repeat(values, channels) * top).astype(np.int64)
        if width == 1:
            x += 128
        w.writeframes(b"".join(int(v).to_bytes(width, "little", signed=width > 1) for v in x))


def joined(rows):
    return np.concatenate([r["samples"] for r in sorted(rows, key=lambda r: r["frame_idx"])])


def tone(rate, hertz, seconds):
    return 0.5 * np.sin(2 * np.pi * hertz * np.arange(int(rate * seconds)) / rate)


@pytest.mark.parametrize(("width", "channels"), [(1, 1), (2, 1), (2, 2), (3, 1), (3, 2), (4, 1)])
def test_widths(spark, tmp_path, width, channels):
    values = tone(800, 30, 1.3)
    written(tmp_path / "a.wav", values, 800, width, channels)
    rows = files.read_pcm(spark, str(tmp_path), size=100).collect()
    assert joined(rows) == pytest.approx(values, abs=2.0 ** (2 - 8 * width)) and {r["rate"] for r in rows} == {800} and {r["length"] for r in rows} == {len(values)}


def test_a_long_file_is_many_tasks(spark, tmp_path):
    values = tone(8000, 50, 90)
    written(tmp_path / "hour.wav", values, 8000)
    df = files.read_pcm(spark, str(tmp_path / "hour.wav"), size=1000, part_bytes=200_001)
    assert df.rdd.getNumPartitions() >= 4
    rows = df.collect()
    assert sorted(r["frame_idx"] for r in rows) == list(range(720)) and joined(rows) == pytest.approx(values, abs=1e-4)
    short = files.read_pcm(spark, str(tmp_path / "hour.wav"), size=1000, most_seconds=2.5, part_bytes=200_001).collect()
    assert len(joined(short)) == 20_000


def test_damaged_files_are_rows_with_errors(spark, tmp_path):
    written(tmp_path / "good.wav", tone(800, 30, 1), 800)
    good = (tmp_path / "good.wav").read_bytes()
    (tmp_path / "empty.wav").write_bytes(b"")
    (tmp_path / "text.wav").write_bytes(b"this is no audio at all")
    (tmp_path / "head.wav").write_bytes(good[:20])
    (tmp_path / "law.wav").write_bytes(good[:20] + struct.pack("<H", 7) + good[22:])
    (tmp_path / "cut.wav").write_bytes(good[:-301])
    rows = files.read_pcm(spark, str(tmp_path), size=100).collect()
    bad = {r["clip_id"].rsplit("/", 1)[1] for r in rows if r["error"]}
    assert bad == {"empty.wav", "text.wav", "head.wav", "law.wav"} and all(r["samples"] is None for r in rows if r["error"])
    assert len(joined([r for r in rows if r["clip_id"].endswith("cut.wav")])) == 649
    assert {r["clip_id"].rsplit("/", 1)[1] for r in files.read_audio(spark, str(tmp_path), 100, 800).collect()} == {"good.wav", "cut.wav"}


def slow(values, rate, target):
    """Every output sample by the definition."""
    cut, n = min(1.0, target / rate), round(len(values) * target / rate)
    out = []
    for i in range(n):
        t, total, weights = i * rate / target, 0.0, 0.0
        for k in range(math.ceil(t - filters.ZEROS / cut), math.floor(t + filters.ZEROS / cut) + 1):
            d = t - k
            if abs(d) * cut < filters.ZEROS:
                h = np.sinc(cut * d) * (1 + math.cos(math.pi * d * cut / filters.ZEROS))
                weights += h
                total += h * (values[k] if 0 <= k < len(values) else 0.0)
        out.append(total / weights)
    return np.array(out)


@pytest.mark.parametrize(("rate", "target", "size", "n"), [(100, 64, 50, 333), (64, 100, 40, 200), (441, 160, 60, 700), (100, 100, 30, 75), (3, 2, 40, 41), (100, 64, 50, 1)])
def test_resampling_is_the_convolution(spark, rate, target, size, n):
    values = np.random.default_rng(n).normal(size=n)
    rows = [("c", rate, n, f, values[f * size : (f + 1) * size].tolist()) for f in range(-(-n // size))]
    df = spark.createDataFrame(rows, "clip_id string, rate int, length long, frame_idx long, samples array<double>").repartition(3)
    out = filters.resample(df, size, target).collect()
    got = joined(out) if out else np.zeros(0)
    assert got == pytest.approx(values if rate == target else slow(values, rate, target), abs=1e-9)
    assert all(len(r["samples"]) == size for r in out if r["frame_idx"] < (len(got) - 1) // size)


def test_a_tone_above_the_new_rate_is_gone(spark, tmp_path):
    written(tmp_path / "high.wav", tone(1600, 700, 2), 1600)
    written(tmp_path / "low.wav", tone(1600, 60, 2), 1600)
    rows = files.read_audio(spark, str(tmp_path), 400, 800).collect()
    high, low = (joined([r for r in rows if r["clip_id"].endswith(x)])[50:-50] for x in ("high.wav", "low.wav"))
    assert np.abs(high).max() < 0.003 and np.abs(low).max() == pytest.approx(0.5, abs=0.01)


def test_frames_shorter_than_the_filter_are_an_error(spark):
    df = spark.createDataFrame([("c", 100, 5, 0, [0.0] * 5)], "clip_id string, rate int, length long, frame_idx long, samples array<double>")
    with pytest.raises(Exception, match="shorter than the filter"):
        filters.resample(df, 5, 64).collect()


def test_header_of_a_float_file():
    data = np.array([0.5, -0.25], "<f4").tobytes()
    raw = b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 3, 1, 100, 400, 4, 32) + b"data" + struct.pack("<I", len(data)) + data
    kind, channels, rate, width, at, n = pcm.header(raw, len(raw))
    assert (kind, rate, n) == (3, 100, 2) and pcm.numbers(raw[at:], kind, width, channels).tolist() == [0.5, -0.25]
