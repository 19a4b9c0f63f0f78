"""Functions against plain Python versions, fixed examples, and invariants."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from wavequery.functions import intervals, text
from wavequery.operators import aggregate, evaluators, generate, report, signal, sweep
from wavequery.plans import drivers, runner, tasks
from wavequery.sources import files


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


# ------------------------------------------------------------------ parsing
def test_anih_answer(spark):
    x = one(spark, text.anih_answer(F.col("r")), r="Timestamp: 12:34, Preceding sound: pages turning")
    assert x["timestamp"] == "12:34" and "pages turning" in x["preceding_sound"]
    assert one(spark, text.anih_answer(F.col("r")), r="at 100:30 it was: loud. ok")["timestamp"] == "00:30"
    x = one(spark, text.anih_answer(F.col("r")), r="")
    assert x["timestamp"] is None and x["preceding_sound"] is None


def test_drift_answer(spark):
    x = one(spark, text.drift_answer(F.col("r")), r="Speaker: 3, First appearance: 01:30")
    assert (x["predicted_speaker"], x["first_appearance"]) == (3, "01:30")
    assert one(spark, text.drift_answer(F.col("r")), r="Speaker 99999999999999, first appearance: N/A")["predicted_speaker"] is None
    assert one(spark, text.drift_answer(F.col("r")), r='First appearance: "Never"')["first_appearance"] == '"Never"'


def test_narrative_answer(spark):
    x = one(spark, text.narrative_answer(F.col("r")), r="Verdict: debunks. Step 1: Clock chimes at 05:00. Step 2: Character mentions at 20:00. Step 3: Alibi contradicts.")
    assert x["verdict"] == "Debunks" and x["cited_timestamps"] == ["05:00", "20:00"]
    assert x["reasoning_steps"] == ["Clock chimes at 05:00", "Character mentions at 20:00", "Alibi contradicts"]
    assert one(spark, text.narrative_answer(F.col("r")), r="nothing")["reasoning_steps"] == []


def test_soundscape_answer(spark):
    x = one(spark, text.soundscape_answer(F.col("r")), r="1. Event: rain, Start: 00:10, End: ongoing, Overlaps: wind (from 00:05)\n\n2) dog; 00:20; 00:30\nnoise")
    assert [tuple(e) for e in x] == [("rain", "00:10", "ongoing", "wind (from 00:05)"), ("dog", "00:20", "00:30", "")]


@pytest.mark.parametrize(("s", "want"), [("12:34", 754.0), ("05:00.5", 300.5), ("1:02:03", 62.0), ("100:30", 6030.0), ("12", None), ("a:b", None), ("30 maybe", None), ("01:30, maybe", None), (None, None)])
def test_seconds(spark, s, want):
    assert one(spark, text.seconds(F.col("s")), s=s) == want


def test_mmss_is_unbounded(spark):
    assert one(spark, text.mmss(F.col("s")), s=6030.9) == "100:30"


# ---------------------------------------------------------- matching and LCS
def iou(a, b):
    hull = max(a[2], b[2]) - min(a[1], b[1])
    return max(0.0, min(a[2], b[2]) - max(a[1], b[1])) / hull if hull > 0 else 0.0


def greedy(pred, true):
    used, out = set(), []
    for p in pred:
        best, at = 0.3, -1
        for j, t in enumerate(true):
            if j not in used and p[0].lower() == t[0].lower() and iou(p, t) > best:
                best, at = iou(p, t), j
        used.add(at)
        out.append(at)
    return out


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_matching_and_lcs_at_random(spark):
    rng = random.Random(4)

    def events(n):
        return [(rng.choice(["rain", "Rain", "dog", "wind"]), float(s := rng.randint(0, 30)), float(s + rng.randint(-2, 20))) for _ in range(n)]

    rows = [(i, events(rng.randint(0, 7)), events(rng.randint(0, 7))) for i in range(300)]
    one_event = "array<struct<event_type:string,s:double,e:double>>"
    df = spark.createDataFrame(rows, f"i int, p {one_event}, t {one_event}")
    names = [F.transform(c, lambda x: x["event_type"]) for c in ("p", "t")]
    for r in df.select("i", intervals.greedy_match(F.col("p"), F.col("t")).alias("m"), intervals.lcs_length(*names).alias("n")).collect():
        _, p, t = rows[r["i"]]
        assert r["m"] == greedy(p, t)
        assert r["n"] == lcs([x[0] for x in p], [x[0] for x in t])


def test_overlap_join_is_the_theta_join(spark):
    rng = random.Random(9)
    rows = [(i, rng.randint(0, 2), float(s := rng.randint(0, 50)), s + rng.choice([0.0, 0.5, 3.0, 25.0])) for i in range(80)]
    df = spark.createDataFrame(rows, "i int, k int, s double, e double")
    got = sorted((r["i"], r["i_r"]) for r in sweep.overlap_join(df, df, ["k"]).collect())
    assert got == sorted((a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[3] > a[2] and b[3] > b[2] and a[2] < b[3] and b[2] < a[3])


# ------------------------------------------------------------------ scoring
def anih(spark, response, ts="12:34", sound="pages turning"):
    return evaluators.score_anih(spark.createDataFrame([(response, ts, sound)], "response string, needle_timestamp string, gt_sound string")).first()


def test_anih_scores(spark):
    r = anih(spark, "Timestamp: 12:34, Preceding sound: pages turning")
    assert (r["timestamp_hit_5s"], r["preceding_sound_iou"], r["composite_score"]) == (1.0, 1.0, 1.0)
    r = anih(spark, "Timestamp: 13:00")
    assert (r["timestamp_error_seconds"], r["timestamp_hit_5s"]) == (26.0, 0.0)
    r = anih(spark, "")
    assert r["timestamp_error_seconds"] is None and r["composite_score"] == 0.0


def test_drift_scores(spark):
    rows = [("Speaker: 3, First appearance: 01:30", 2, "01:30"), ("Speaker: 2, First appearance: never", 2, None), ("none", None, "01:30"), ("Speaker: 2, First appearance: x", 2, "01:30")]
    df = spark.createDataFrame(rows, "response string, target_speaker_id int, first_appearance_timestamp string")
    got = [(r["speaker_accuracy"], r["appearance_error_seconds"], r["appearance_hit_5s"], r["joint_accuracy"]) for r in evaluators.score_drift(df).collect()]
    assert got == [(0.0, 0.0, 1.0, 0.0), (1.0, 0.0, 1.0, 1.0), (1.0, None, 0.0, 0.0), (1.0, None, 0.0, 0.0)]


def test_soundscape_scores(spark):
    same = [("rain_start", "00:00", "05:00", ""), ("wind_howling", "02:00", "10:00", "rain_start")]
    schema = "events array<struct<event_type:string,start:string,end:string,overlaps:string>>, true_events array<struct<event_type:string,start:string,end:string,overlaps:string>>"
    a, b, c = evaluators.score_soundscape(spark.createDataFrame([(same, same), (same, []), ([], same)], schema)).collect()
    assert (a["event_f1"], a["timeline_iou"], a["ordering_accuracy"], a["overlap_detection_f1"], a["composite_score"]) == (1.0, 1.0, 1.0, 1.0, 1.0)
    assert (b["event_f1"], b["composite_score"]) == (0.0, None)
    assert (c["event_f1"], c["composite_score"]) == (0.0, 0.0)


def test_narrative_scores(spark):
    steps = ["Identify clock chime", "Note character reference", "Compare alibi"]
    rows = [("Verdict: Debunks. Step 1: Clock chime at 05:00. Step 2: Character at 20:00. Step 3: Alibi contradicts 35:00", "Debunks", ["05:00", "20:00", "35:00"], steps), ("", None, [], [])]
    df = spark.createDataFrame(rows, "response string, correct_verdict string, key_timestamps array<string>, required_reasoning_steps array<string>")
    a, b = evaluators.score_narrative(df).collect()
    assert (a["verdict_accuracy"], a["reasoning_completeness"], a["timestamp_citation_f1"]) == (1.0, 1.0, 1.0)
    assert (b["verdict_accuracy"], b["reasoning_completeness"], b["timestamp_citation_f1"]) == (1.0, 0.0, 0.0)


# --------------------------------------------------------------- aggregates
def scores(spark, values, metric="composite_score"):
    return spark.createDataFrame([("anih", "m", str(i), metric, v) for i, v in enumerate(values)], "task string, model string, instance_id string, metric string, value double")


def test_summary_leaves_missing_errors_out(spark):
    r = aggregate.summarise(scores(spark, [1.0, 3.0, None])).first()
    assert (r["mean"], r["std"], r["median"], r["n"]) == (2.0, 1.0, 2.0, 3)
    assert aggregate.summarise(scores(spark, [None, None])).first()["mean"] == 0.0


@pytest.mark.parametrize("kind", [aggregate.bootstrap, aggregate.poisson_bootstrap])
def test_bootstrap(spark, kind):
    df = scores(spark, [0.5, 0.6, 0.55, 0.58, 0.62, 0.48, 0.52, 0.59, 0.61, 0.57])
    r = kind(df, 500).first()
    assert 0.4 <= r["ci_lo"] <= 0.6 and 0.5 <= r["ci_hi"] <= 0.7 and r["ci_lo"] < r["ci_hi"]
    again = kind(df.repartition(3), 500).first()
    assert (again["ci_lo"], again["ci_hi"]) == pytest.approx((r["ci_lo"], r["ci_hi"]))


def test_poisson_weights_of_equal_values(spark):
    """Against weights drawn one by one with numpy."""
    import numpy as np

    values = [0.0] * 1500 + [1.0] * 4500 + [0.5] * 3 + [0.25]
    r = aggregate.poisson_bootstrap(scores(spark, values)).first()
    v, rng = np.array(values), np.random.default_rng(1)
    w = rng.poisson(1.0, (4000, len(v)))
    low, high = np.quantile(w @ v / w.sum(1), [0.025, 0.975])
    assert (r["ci_lo"], r["ci_hi"]) == pytest.approx((low, high), abs=0.001)


def test_registered_intervals_cover_all_metrics(spark, tmp_path, monkeypatch):
    from datetime import datetime, timedelta

    from wavequery import catalogue
    from wavequery.operators.evaluators import METRICS

    start, kinds = datetime(2024, 1, 1), ["click", "view", "error"]
    rows = [(i, start + timedelta(minutes=37 * i), i % 5, kinds[i % 3], float(i % 9)) for i in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    taken, real = [], aggregate.weigh
    monkeypatch.setattr(aggregate, "weigh", lambda replicates: taken.append(replicates) or real(replicates))
    got = {(r["task"], r["metric"]) for r in catalogue.QUERIES["bootstrap_ci"](spark, str(tmp_path)).collect()}
    assert got == {(t, m) for t in METRICS for m in METRICS[t]} and taken == [10_000]


def test_ranking_breaks_ties_by_name(spark):
    df = scores(spark, [0.5]).unionByName(scores(spark, [0.5]).withColumn("model", F.lit("a")))
    ranks = {r["model"]: r["rank"] for r in aggregate.rank_models(aggregate.summarise(df)).collect()}
    assert ranks == {"a": 1, "m": 2}
    assert aggregate.best_models(aggregate.summarise(df)).first()["model"] == "a"


def test_report_strings():
    rows = [{"task": "anih_x", "m": 0.5}, {"task": "b", "m": None}]
    assert "| anih_x | 0.500 |" in report.markdown(rows, ["task", "m"]) and "—" in report.markdown(rows, ["task", "m"])
    assert r"anih\_x & 0.500 \\" in report.latex(rows, ["task", "m"], "Scores", "t")


def test_main_cells(spark):
    rows = spark.createDataFrame([("anih", "a", "composite_score", 0.5, 0.4, 0.6), ("anih", "b", "composite_score", 0.25, None, None), ("soundscape", "a", "composite_score", 1.0, 1.0, 1.0)], "task string, model string, metric string, mean double, ci_lo double, ci_hi double")
    got = {r["task"]: (r["a"], r["b"], r["c"]) for r in report.main_cells(rows, ["a", "b", "c"]).collect()}
    assert got == {"anih": ("0.500 [0.400, 0.600]", "0.250 [0.000, 0.000]", "—"), "soundscape": ("1.000 [1.000, 1.000]", "—", "—")}
    radar = report.radar(rows, ["a", "b"]).orderBy("model").collect()
    assert [(r["anih"], r["soundscape"], r["speaker_drift"]) for r in radar] == [(0.5, 1.0, 0.0), (0.25, 0.0, 0.0)]


def test_summary_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(0, 1000, 501), "b": np.round(rng.random(400), 1), "c": np.full(7, 1e9 + 0.1), "d": rng.integers(0, 2, 300).astype(float), "e": np.append(rng.random(99), 1e12)}
    rows = [("anih", "m", str(i), k, float(v)) for k, vs in groups.items() for i, v in enumerate(vs)] + [("anih", "m", "x", "a", None)]
    df = spark.createDataFrame(rows, "task string, model string, instance_id string, metric string, value double")
    for r in aggregate.summarise(df).collect():
        v = groups[r["metric"]]
        assert r["median"] == float(np.median(v)) and (r["min"], r["max"], r["n"]) == (v.min(), v.max(), len(v) + (r["metric"] == "a"))
        assert r["mean"] == pytest.approx(v.mean(), rel=1e-12) and r["std"] == pytest.approx(v.std(), rel=1e-6, abs=1e-6)


def test_numbering_and_distinct_picks(spark):
    rows = generate._numbered(spark.range(500).selectExpr("cast(id % 3 as int) AS g", "concat('p', id) AS path"), ["g"], "path").collect()
    for g in range(3):
        own = [r for r in rows if r["g"] == g]
        assert sorted(r["k"] for r in own) == list(range(len(own))) and {r["n"] for r in own} == {len(own)}
    picks = spark.range(300).select(generate._distinct_picks(F.col("id") % 4 + 5, 5, "t", F.col("id")).alias("p"), (F.col("id") % 4 + 5).alias("n")).collect()
    assert all(len(set(r["p"])) == 5 and 0 <= min(r["p"]) and max(r["p"]) < r["n"] for r in picks)
    few = spark.createDataFrame([("ami", f"p{i}") for i in range(4)], "dataset string, speaker_id string")
    assert generate.drift(spark, few, 20).count() == 0


# ------------------------------------------------------- tasks and generators
def test_registry_and_config():
    assert set(tasks.list_tasks()) == {"anih", "speaker_drift", "soundscape", "narrative_coherence"}
    assert tasks.config("anih", background_duration=1800, num_instances=3).background_duration == 1800
    with pytest.raises(ValueError):
        tasks.config("nope")
    suite = tasks.create_task_suite(["anih", "soundscape"], {"soundscape": {"num_events": 3}})
    assert list(suite) == ["anih", "soundscape"] and suite["soundscape"].num_events == 3 and list(tasks.create_task_suite()) == tasks.list_tasks()
    assert drivers.chosen("all", ["a", "b"]) == ["a", "b"] and drivers.chosen(["b", "c"], ["a", "b"]) == ["b"] and drivers.chosen("c", ["a"]) == []


def test_generators_are_deterministic_and_sound(spark):
    people = spark.createDataFrame([("ami", f"p{i}") for i in range(9)], "dataset string, speaker_id string")
    panels = generate.drift(spark, people, 40)
    assert sorted(map(tuple, panels.collect())) == sorted(map(tuple, generate.drift(spark, people.repartition(5), 40).collect()))
    by = {}
    for r in generate.turns(panels).orderBy("instance_id", "ord").collect():
        by.setdefault(r["instance_id"], []).append(r)
    for turns in by.values():
        assert [t["kind"] for t in turns].count("initial") == 5 and turns[-1]["kind"] == "target_return"
        assert all(t["speaker_idx"] != 2 for t in turns if t["kind"] == "middle")
        assert all(abs(a["end_s"] - b["start_s"]) < 1e-6 for a, b in zip(turns, turns[1:]))
    events = generate.soundscape(spark, 30).collect()
    assert len(events) == 30
    for r in events:
        kinds = [e["event_type"] for e in r["events"]]
        assert 6 <= len(kinds) <= 10 and len(set(kinds)) == len(kinds) and kinds[0].startswith(("rain", "wind", "thunder"))
        assert re.fullmatch(r"soundscape_[0-9a-f]{8}", r["instance_id"])


# ------------------------------------------------------------------ signals
def frames(spark, clips):
    rows = [(c, i // 10, values[i : i + 10]) for c, values in clips.items() for i in range(0, len(values), 10)]
    return spark.createDataFrame(rows, "clip_id long, frame_idx long, samples array<double>")


def test_mix_keeps_length_and_sets_the_ratio(spark):
    rng = random.Random(1)
    bg, fg = [rng.uniform(-0.1, 0.1) for _ in range(100)], [rng.uniform(-0.5, 0.5) for _ in range(13)]
    mixed = [0.0] * 100
    for r in signal.samples(signal.mix_snr(frames(spark, {1: bg}), frames(spark, {1: fg}), F.lit(37), 10), 10).collect():
        mixed[r["pos"]] = r["v"]
    added = [m - b for m, b in zip(mixed, bg)]
    assert max(map(abs, added[:37] + added[50:])) < 1e-12
    power = sum(x * x for x in added[37:50]) / sum(x * x for x in bg[37:50])
    assert power == pytest.approx(10.0)


def test_looped_and_fitted_clips(spark):
    clips = {1: [float(i) for i in range(23)], 2: [float(i) for i in range(40)]}
    for n in (7, 10, 23, 57):
        for name, want in (("looped", {c: [v[i % len(v)] for i in range(n)] for c, v in clips.items()}), ("fitted", {c: (v + [0.0] * n)[:n] for c, v in clips.items()})):
            got = {}
            for r in signal.samples(getattr(signal, name)(frames(spark, clips), n, 10), 10).collect():
                got.setdefault(r["clip_id"], {})[r["pos"]] = r["v"]
            assert {c: [x[i] for i in range(n)] for c, x in got.items()} == want and all(len(x) == n for x in got.values())


def test_mix_continues_a_short_background(spark):
    out = signal.samples(signal.mix_snr(frames(spark, {1: [0.1] * 20}), frames(spark, {1: [0.2] * 10}), F.lit(25), 10), 10).collect()
    assert len(out) == 40


def test_wav_round_trip(spark, tmp_path):
    values = [((i * 37) % 200 - 100) / 128 for i in range(250)]
    (tmp_path / "a.wav").write_bytes(files.encode_wav(values, 100))
    got = files.read_audio(spark, str(tmp_path), size=60, rate=100).orderBy("frame_idx").collect()
    back = [x for r in got for x in r["samples"]]
    assert [len(r["samples"]) for r in got] == [60, 60, 60, 60, 10] and max(abs(a - b) for a, b in zip(values, back)) < 1e-4
    again = files.wav_bytes(files.read_audio(spark, str(tmp_path), size=60, rate=100), 100).first()["content"]
    assert files.decode_wav(bytes(again))[1] == 100
    assert sum(len(r["samples"]) for r in files.read_audio(spark, str(tmp_path), size=60, rate=100, most_seconds=1).collect()) == 100


# ------------------------------------------------------------ files and models
def test_instances_and_results_round_trip(spark, tmp_path):
    df = spark.sql("SELECT 'anih_1' AS instance_id, 'anih' AS task_name, 'a.wav' AS audio_path, 3600.0D AS duration, parse_json('{\"t\": \"12:34\"}') AS ground_truth, 'p' AS prompt, parse_json('{}') AS metadata")
    files.write_instances(df, str(tmp_path / "anih_test.jsonl"))
    r = files.read_split(spark, "anih", str(tmp_path)).select("instance_id", F.expr("variant_get(ground_truth, '$.t', 'string')").alias("t")).first()
    assert tuple(r) == ("anih_1", "12:34")
    for name, n in (("a_m_results.json", 1), ("b_m_results.json", 2)):
        (tmp_path / name).write_text('{"task": "anih", "model": "m", "num_instances": %d, "metrics": {"x": {"mean": Infinity, "std": 0.0, "median": 1.0}}}' % n)
    (tmp_path / "summary.json").write_text("{}")
    assert [x["num_instances"] for x in files.read_results(spark, str(tmp_path)).collect()] == [2]


def test_models_of_given_parts(spark):
    df = spark.createDataFrame([("1", "1.wav", "when?")], "instance_id string, audio_path string, prompt string")
    parts = {"transcribe": lambda path: f"text of {path}", "answer": lambda text, prompt: f"{prompt} {text}"}
    assert runner.run(df, "cascaded", **parts).first()["response_text"] == "when? text of 1.wav"
    assert runner.run(df, "ltu", start=lambda: lambda path, prompt: path.upper()).first()["response_text"] == "1.WAV"
    assert runner.available() == ["echo"]
    with pytest.raises(ValueError):
        runner.get_model("qwen_audio")


def test_sources_by_configuration(spark, tmp_path):
    wav = files.encode_wav([0.0] * 10, 100)
    made = {"bg": ["library/a.wav", "office/b.wav"], "vox": ["id1/v1/1.wav", "id1/v2/1.wav", "id2/v1/1.wav"], "ami": ["m1/A/1.wav", "m1/B/1.wav"], "books": ["one.wav", "two.wav"], "clues": ["clock_chime/x.wav"]}
    for folder, names in made.items():
        for name in names:
            path = tmp_path / folder / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(wav)
    (tmp_path / "books" / "one.txt").write_text("once")
    paths = {"audioset": "bg", "voxceleb2": "vox", "ami": "ami", "librivox": "books", "acoustic_clues": "clues", "fsd50k": "missing", "unknown": "bg"}
    got = files.discover_sources(spark, {k: str(tmp_path / v) for k, v in paths.items()})
    assert sorted((r["kind"], r["category"]) for r in got["clips"].collect()) == [("background", "library"), ("background", "office"), ("clue", "clock_chime")]
    assert sorted((r["dataset"], r["speaker_id"]) for r in got["speakers"].collect()) == [("ami", "A"), ("ami", "B"), ("voxceleb2", "id1"), ("voxceleb2", "id2")]
    assert sorted((r["source"], r["transcript"] or "") for r in got["stories"].collect()) == [("librivox", ""), ("librivox", "once")]


def test_jobs_end_to_end(spark, tmp_path):
    wav = files.encode_wav([0.0] * 10, 100)
    for name in [*[f"bg/{c}/{i}.wav" for c in ("library", "office", "lecture") for i in range(3)], *[f"needles/{c}/0.wav" for c in tasks.AnihConfig().needle_types], *[f"clues/{c}/0.wav" for c in tasks.NarrativeConfig().clue_types], *[f"vox/id{i}/v/0.wav" for i in range(7)]]:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(wav)
    config = {
        "data": {"audioset": f"{tmp_path}/bg", "needles": f"{tmp_path}/needles", "acoustic_clues": f"{tmp_path}/clues", "voxceleb2": f"{tmp_path}/vox"},
        "tasks": {"anih": {"num_instances": 12}, "speaker_drift": {"num_instances": 12, "dataset_sources": ["voxceleb2"]}, "soundscape": {"num_instances": 5}},
    }
    paths = drivers.generate_data(spark, config, f"{tmp_path}/data")
    assert {t: files.read_split(spark, t, f"{tmp_path}/data").count() for t in paths} == {"anih": 12, "speaker_drift": 12, "soundscape": 5, "narrative_coherence": 10}
    assert files.read_split(spark, "soundscape", f"{tmp_path}/data").selectExpr("variant_get(metadata, '$.background_path', 'string') AS p").where("p like '%/bg/%'").count() == 5
    with pytest.raises(FileNotFoundError):
        drivers.evaluate(spark, f"{tmp_path}/none")
    scores, responses = drivers.evaluate(spark, f"{tmp_path}/data", ["anih", "soundscape", "no such task"], ["echo", "no such model"], out=f"{tmp_path}/out", replicates=50)
    assert scores.select("task").distinct().count() == 2 and responses.count() == 17
    got = {r["task"]: r for r in files.read_results(spark, f"{tmp_path}/out").collect()}
    assert {t: (r["model"], r["num_instances"], len(r["predictions"])) for t, r in got.items()} == {"anih": ("echo", 12, 12), "soundscape": ("echo", 5, 5)}
    mean = {(r["task"], r["metric"]): r["mean"] for r in aggregate.summarise(scores).collect()}
    assert all(r["metrics"][m]["mean"] == pytest.approx(mean[t, m]) for t, r in got.items() for m in r["metrics"])
    assert set(json.loads((tmp_path / "out" / "summary.json").read_text())) == {"anih", "soundscape"}
    latencies = responses.select("model", "instance_id", F.coalesce("latency_ms", F.lit(-1.0)).alias("latency_ms"))
    drivers.write_report(scores, latencies, f"{tmp_path}/report", 50)
    assert "| anih |" in (tmp_path / "report" / "summary.md").read_text() and "tabular" in (tmp_path / "report" / "main_table.tex").read_text()
    assert spark.read.option("header", True).csv(f"{tmp_path}/report/failures").count() == 17
    docs = [json.loads(r["value"]) for r in files.score_documents(scores).collect()]
    assert len(docs) == 17 and all("composite_score" in d["metrics"] for d in docs)


def test_an_hour_of_audio(spark, tmp_path):
    import wave

    import numpy as np

    with wave.open(str(tmp_path / "long.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(16_000)
        w.writeframes(np.tile(np.arange(-8000, 8000, dtype="<i2").repeat(2), 3600).tobytes())
    frames = files.read_audio(spark, str(tmp_path / "long.wav"), rate=8_000, size=8_000)
    r = frames.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("samples")).alias("samples"), F.min(F.array_min("samples")).alias("low")).first()
    assert (r["n"], r["samples"]) == (3600, 8_000 * 3600) and r["low"] == pytest.approx(-8000 / 32768, rel=0.2)  # the filter swings over at the jumps
    assert files.read_audio(spark, str(tmp_path / "long.wav"), most_seconds=2.5).count() == 3


def test_runner_captures_errors(spark):
    df = spark.createDataFrame([(str(i), f"{i}.wav", "when?") for i in range(60)], "instance_id string, audio_path string, prompt string")
    rows = runner.run(df, "echo", fail=3).collect()
    assert len(rows) == 60 and any(r["error"] for r in rows) and all((r["error"] is None) == (r["response_text"] is not None) for r in rows)
    with pytest.raises(ValueError):
        runner.get_model("nope")


def test_streaming_scores_equal_the_batch(spark, tmp_path):
    from wavequery.streaming import scoring

    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) AS ts, 'm' AS model, '12:34' AS needle_timestamp, 'x' AS gt_sound, concat('Timestamp: 12:', lpad(id % 60, 2, '0')) AS response FROM range(180)")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = scoring.windowed_scores(scoring.read_responses(spark, str(tmp_path / "in"), rows.schema.simpleString()[7:-1].replace(":", " ")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("scores").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["window"]["start"], r["n"], round(r["composite"], 9)) for r in spark.table("scores").collect())
    want = sorted((r["window"]["start"], r["n"], round(r["composite"], 9)) for r in scoring.windowed_scores(rows).collect())
    assert got == want and sum(x[1] for x in got) == 180
