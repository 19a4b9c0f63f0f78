"""DuckDB SQL for the queries of the catalogue, written apart from the engine."""

from __future__ import annotations

from .sources import fixtures

TS = r"(\d{1,2}:\d{2}(?:\.\d+)?)"
EVENT = r"Event[:\s]+([^,]+),\s*Start[:\s]+([^,]+),\s*End[:\s]+([^,]+)(?:,\s*Overlaps[:\s]+(.*))?"
NUMBERED = r"(\d+)[\.\:\)]\s*([^,]+)[,\;]\s*([^,]+)[,\;]\s*([^,]+)"
STOP = "['the','a','an','and','or','but','is','was','at','in','on','to','for','of','with','by']"


def on_events(sql: str) -> str:
    return sql.format(events="events")


def r6(x: str) -> str:
    return f"round({x} + 1e-9, 6)"


def hit(text: str, pattern: str, group: int, options: str = "") -> str:
    o = f", '{options}'" if options else ""
    return f"CASE WHEN regexp_matches({text}, '{pattern}'{o}) THEN regexp_extract({text}, '{pattern}', {group}{o}) END"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def secs(ts: str) -> str:
    a, b = f"trim(split_part({ts}, ':', 1))", f"trim(split_part({ts}, ':', 2))"
    return f"CASE WHEN regexp_matches({a}, '^[+-]?\\d+$') AND regexp_matches({b}, '^[+-]?(\\d+(\\.\\d*)?|\\.\\d+)$') THEN try_cast({a} AS BIGINT) * 60 + try_cast({b} AS DOUBLE) END"


def words(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '\\s+'), lambda w: w <> ''))"


ANIH_PARSED = f"""
SELECT event_id, model, needle_timestamp, gt_sound, nullif(regexp_extract(response, '{TS}', 1), '') AS "timestamp",
       coalesce({strip(hit('response', r'[Pp]receding\s+sound[:\s]+([^.\n]+)', 1))}, {strip(hit('response', r'(?:sound|was)[:\s]+([^.\n]+)', 1, 'i'))}) AS preceding_sound
FROM ({on_events(fixtures.ANIH)})
"""

ANIH_SCORES = f"""
SELECT event_id, model, err AS timestamp_error_seconds, CASE WHEN err <= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS timestamp_hit_1s,
       CASE WHEN err <= 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS timestamp_hit_5s, iou AS preceding_sound_iou,
       0.7::DOUBLE * CASE WHEN err <= 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + 0.3::DOUBLE * iou AS composite_score
FROM (
  SELECT event_id, model, abs({secs('"timestamp"')} - {secs('needle_timestamp')})::DOUBLE AS err,
         coalesce(len(list_intersect({words('preceding_sound')}, {words('gt_sound')}))::DOUBLE / nullif(len(list_distinct(list_concat({words('preceding_sound')}, {words('gt_sound')}))), 0), 0) AS iou
  FROM ({ANIH_PARSED})
)
"""

DRIFT_PARSED = f"""
SELECT event_id, model, target_speaker_id, first_appearance_timestamp,
       try_cast({hit('response', r'[Ss]peaker[:\s]+(\d+)', 1)} AS INTEGER) AS predicted_speaker,
       CASE WHEN lower(fa) NOT IN ('never', 'none', 'n/a') THEN fa END AS first_appearance
FROM (SELECT *, {strip(hit('response', r'[Ff]irst\s+appearance[:\s]+([^\.\n]+)', 1))} AS fa FROM ({on_events(fixtures.DRIFT)}))
"""

DRIFT_SCORES = f"""
SELECT *, speaker_accuracy * appearance_hit_5s AS joint_accuracy FROM (
  SELECT event_id, model, CASE WHEN predicted_speaker IS NOT DISTINCT FROM target_speaker_id THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS speaker_accuracy,
         err AS appearance_error_seconds, CASE WHEN err <= 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS appearance_hit_5s
  FROM (SELECT *, CASE WHEN first_appearance IS NULL AND first_appearance_timestamp IS NULL THEN 0.0::DOUBLE
                       WHEN first_appearance IS NOT NULL AND first_appearance_timestamp IS NOT NULL
                       THEN abs({secs('first_appearance')} - {secs('first_appearance_timestamp')})::DOUBLE END AS err FROM ({DRIFT_PARSED}))
)
"""

SOUND_INSTANCES = f"""
SELECT instance_id, model, string_agg(line, chr(10) ORDER BY ord) AS response FROM ({on_events(fixtures.SOUNDSCAPE)}) GROUP BY instance_id, model
"""

SOUND_PARSED = f"""
SELECT instance_id, model, row_number() OVER (PARTITION BY instance_id ORDER BY n) AS i, event_type, "start", "end", "overlaps" FROM (
  SELECT instance_id, model, n,
         {strip(f"CASE WHEN e THEN regexp_extract(line, '{EVENT}', 1, 'i') ELSE regexp_extract(line, '{NUMBERED}', 2) END")} AS event_type,
         {strip(f"CASE WHEN e THEN regexp_extract(line, '{EVENT}', 2, 'i') ELSE regexp_extract(line, '{NUMBERED}', 3) END")} AS "start",
         {strip(f"CASE WHEN e THEN regexp_extract(line, '{EVENT}', 3, 'i') ELSE regexp_extract(line, '{NUMBERED}', 4) END")} AS "end",
         CASE WHEN e THEN {strip(f"regexp_extract(line, '{EVENT}', 4, 'i')")} ELSE '' END AS "overlaps"
  FROM (
    SELECT *, regexp_matches(line, '{EVENT}', 'i') AS e FROM (
      SELECT instance_id, model, unnest(range(len(string_split(response, chr(10))))) AS n, {strip("unnest(string_split(response, chr(10)))")} AS line FROM ({SOUND_INSTANCES})
    ) WHERE line <> ''
  ) WHERE e OR regexp_matches(line, '{NUMBERED}')
)
"""


def span(start: str, end: str) -> str:
    s = f"coalesce({secs(start)}, 0)::DOUBLE"
    return f"{s} AS s, CASE WHEN lower({end}) = 'ongoing' THEN {s} + 10 ELSE coalesce({secs(end)}, 0)::DOUBLE END AS e"


def iou(s1: str, e1: str, s2: str, e2: str) -> str:
    return f"CASE WHEN greatest({e1}, {e2}) - least({s1}, {s2}) > 0 THEN greatest(0, least({e1}, {e2}) - greatest({s1}, {s2})) / (greatest({e1}, {e2}) - least({s1}, {s2})) ELSE 0 END"


#: One row per predicted event: j is the matched true event (1-based) or NULL.
SOUND_MATCHED = f"""
WITH RECURSIVE p AS (SELECT instance_id, model, i, event_type, "overlaps", {span('"start"', '"end"')} FROM ({SOUND_PARSED})),
t AS (SELECT instance_id, ord AS j, event_type, overlap_names AS "overlaps", {span('start_ts', 'end_ts')} FROM ({on_events(fixtures.SOUNDSCAPE)})),
c AS (SELECT * FROM (SELECT p.instance_id, p.i, t.j, {iou('p.s', 'p.e', 't.s', 't.e')} AS iou FROM p JOIN t ON p.instance_id = t.instance_id AND lower(p.event_type) = lower(t.event_type)) WHERE iou > 0.3),
m AS (
  SELECT DISTINCT instance_id, 0::BIGINT AS i, []::BIGINT[] AS used, NULL::BIGINT AS j FROM p
  UNION ALL
  SELECT instance_id, i, CASE WHEN j IS NULL THEN used ELSE list_append(used, j) END, j FROM (
    SELECT p.instance_id, p.i, any_value(m.used) AS used, arg_min(c.j, (-c.iou, c.j)) FILTER (c.j IS NOT NULL AND NOT list_contains(m.used, c.j)) AS j
    FROM m JOIN p ON p.instance_id = m.instance_id AND p.i = m.i + 1 LEFT JOIN c ON c.instance_id = p.instance_id AND c.i = p.i
    GROUP BY p.instance_id, p.i
  )
)
SELECT m.instance_id, p.model, m.i, m.j, c.iou, p.event_type AS p_type, t.event_type AS t_type, p."overlaps" AS p_overlaps, t."overlaps" AS t_overlaps, t.s AS t_s
FROM m JOIN p ON p.instance_id = m.instance_id AND p.i = m.i LEFT JOIN c ON c.instance_id = m.instance_id AND c.i = m.i AND c.j = m.j
LEFT JOIN t ON t.instance_id = m.instance_id AND t.j = m.j
"""


SOUND_SEQUENCES = f"""
SELECT instance_id, list(p_type ORDER BY i) AS a, list(t_type ORDER BY i) AS b, list(t_type ORDER BY t_s, i) AS c FROM ({SOUND_MATCHED}) WHERE j IS NOT NULL GROUP BY instance_id
"""

LCS = f"""
WITH RECURSIVE q AS MATERIALIZED ({SOUND_SEQUENCES}),
l AS (
  SELECT instance_id, a, b, c, 0::BIGINT AS x, list_transform(range(len(b) + 1), lambda z: 0::BIGINT) AS o1, list_transform(range(len(c) + 1), lambda z: 0::BIGINT) AS o2 FROM q
  UNION ALL
  SELECT instance_id, a, b, c, x + 1,
         list_prepend(0::BIGINT, list_transform(range(1, len(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN a[x + 1] = b[k] THEN o1[k] + 1 ELSE o1[k + 1] END)))),
         list_prepend(0::BIGINT, list_transform(range(1, len(c) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN a[x + 1] = c[k] THEN o2[k] + 1 ELSE o2[k + 1] END))))
  FROM l WHERE x < len(a)
)
SELECT instance_id, len(a) AS k, o1[len(b) + 1] AS lcs, o2[len(c) + 1] AS lcs_strict FROM l WHERE x = len(a)
"""

OVERLAPS = """
CASE WHEN coalesce(t_overlaps, '') <> '' THEN len(list_intersect(list_distinct(CASE WHEN p_overlaps = '' THEN [] ELSE string_split(p_overlaps, ', ') END), list_distinct(string_split(t_overlaps, ', '))))::DOUBLE / len(list_distinct(string_split(t_overlaps, ', ')))
     WHEN coalesce(p_overlaps, '') = '' THEN 1.0 ELSE 0.0 END
"""

SOUND_SCORES = f"""
WITH m AS MATERIALIZED ({SOUND_MATCHED}),
g AS (SELECT instance_id, count(*) AS n, count(j) AS k, avg(iou) FILTER (j IS NOT NULL) AS iou, avg({OVERLAPS}) FILTER (j IS NOT NULL) AS ov FROM m GROUP BY instance_id),
t AS (SELECT instance_id, any_value(model) AS model, count(*) AS n FROM ({on_events(fixtures.SOUNDSCAPE)}) GROUP BY instance_id),
l AS ({LCS}),
s AS (
  SELECT t.instance_id, t.model, coalesce(2.0::DOUBLE * coalesce(g.k, 0) / nullif(coalesce(g.n, 0) + t.n, 0), 0) AS event_f1, coalesce(g.iou, 0)::DOUBLE AS timeline_iou,
         coalesce(l.lcs::DOUBLE / l.k, 0)::DOUBLE AS ordering_accuracy, coalesce(l.lcs_strict::DOUBLE / l.k, 0)::DOUBLE AS ordering_accuracy_strict, coalesce(g.ov, 0)::DOUBLE AS overlap_detection_f1
  FROM t LEFT JOIN g ON t.instance_id = g.instance_id LEFT JOIN l ON t.instance_id = l.instance_id
)
SELECT *, 0.3::DOUBLE * event_f1 + 0.3::DOUBLE * timeline_iou + 0.2::DOUBLE * ordering_accuracy + 0.2::DOUBLE * overlap_detection_f1 AS composite_score FROM s
"""

NARRATIVE_PARSED = f"""
SELECT event_id, model, correct_verdict, [t_a, t_b, t_c] AS keys, [r_a, r_b, r_c] AS steps_true,
       CASE WHEN v <> '' THEN upper(v[1]) || lower(v[2:]) END AS verdict,
       list_filter(list_transform(regexp_split_to_array(response, '[Ss]tep\\s+\\d+[:\\s]+')[2:], lambda x: regexp_replace({strip('x')}, '\\.+$', '')), lambda x: x <> '') AS reasoning_steps,
       regexp_extract_all(response, '{TS}', 1) AS cited_timestamps
FROM (SELECT *, regexp_extract(response, 'verdict[:\\s]+(Validates|Debunks|Inconclusive)', 1, 'i') AS v FROM ({on_events(fixtures.NARRATIVE)}))
"""

NARRATIVE_SCORES = f"""
WITH p AS ({NARRATIVE_PARSED}),
w AS (
  SELECT *, list_transform(steps_true, lambda t: list_filter({words('t')}, lambda x: NOT list_contains({STOP}, x))) AS tw,
         list_transform(reasoning_steps, lambda t: list_filter({words('t')}, lambda x: NOT list_contains({STOP}, x))) AS pw,
         list_distinct(cited_timestamps) AS ct, list_distinct(keys) AS kt
  FROM p
),
s AS (
  SELECT event_id, model, CASE WHEN verdict IS NOT DISTINCT FROM correct_verdict THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS verdict_accuracy,
         len(list_filter(tw, lambda t: len(t) > 0 AND len(list_filter(pw, lambda q: len(list_intersect(q, t))::DOUBLE / len(t) >= 0.3)) > 0))::DOUBLE / len(tw) AS reasoning_completeness,
         CASE WHEN len(ct) > 0 THEN len(list_intersect(ct, kt))::DOUBLE / len(ct) ELSE 0.0::DOUBLE END AS timestamp_citation_precision,
         len(list_intersect(ct, kt))::DOUBLE / len(kt) AS timestamp_citation_recall
  FROM w
),
f AS (
  SELECT *, CASE WHEN timestamp_citation_precision + timestamp_citation_recall > 0
            THEN 2 * timestamp_citation_precision * timestamp_citation_recall / (timestamp_citation_precision + timestamp_citation_recall) ELSE 0.0::DOUBLE END AS timestamp_citation_f1 FROM s
)
SELECT *, 0.4::DOUBLE * verdict_accuracy + 0.4::DOUBLE * reasoning_completeness + 0.2::DOUBLE * timestamp_citation_f1 AS composite_score FROM f
"""

METRICS = {
    "anih": (ANIH_SCORES, "event_id", ["timestamp_error_seconds", "timestamp_hit_1s", "timestamp_hit_5s", "preceding_sound_iou", "composite_score"]),
    "speaker_drift": (DRIFT_SCORES, "event_id", ["speaker_accuracy", "appearance_error_seconds", "appearance_hit_5s", "joint_accuracy"]),
    "soundscape": (SOUND_SCORES, "instance_id", ["event_f1", "timeline_iou", "ordering_accuracy", "overlap_detection_f1", "composite_score"]),
    "narrative_coherence": (NARRATIVE_SCORES, "event_id", ["verdict_accuracy", "reasoning_completeness", "timestamp_citation_precision", "timestamp_citation_recall", "timestamp_citation_f1", "composite_score"]),
}


def rounded(sql: str, keys: list[str], names: list[str]) -> str:
    return f"SELECT {', '.join(keys)}, {', '.join(f'{r6(n)} AS {n}' for n in names)} FROM ({sql})"


def long(task: str) -> str:
    sql, key, names = METRICS[task]
    rows = ", ".join(f"struct_pack(metric := '{n}', value := {n}::DOUBLE)" for n in names)
    return f"SELECT '{task}' AS task, model, {key}::VARCHAR AS instance_id, u.metric AS metric, u.value AS value FROM (SELECT model, {key}, unnest([{rows}]) AS u FROM ({sql}))"


LONG = " UNION ALL ".join(long(t) for t in METRICS)

SUMMARY = f"""
SELECT task, model, metric, coalesce(avg(value), 0) AS mean, coalesce(stddev_pop(value), 0) AS std, coalesce(median(value), 0) AS median, min(value) AS min, max(value) AS max, count(*) AS n
FROM ({LONG}) GROUP BY task, model, metric
"""

PRIMARY = f"SELECT * FROM ({SUMMARY}) WHERE metric = CASE task WHEN 'speaker_drift' THEN 'joint_accuracy' ELSE 'composite_score' END"

RANKED = f"SELECT task, model, mean AS score, row_number() OVER (PARTITION BY task ORDER BY mean DESC, model) AS rank FROM ({PRIMARY})"

LATENCY = "SELECT 'm' || (event_id % 4)::VARCHAR AS model, coalesce(avg(ms) FILTER (ms > 0), 0) AS avg_latency_ms FROM (SELECT *, CASE WHEN event_type = 'error' THEN -1.0::DOUBLE ELSE value END AS ms FROM events) GROUP BY 1"

MODELS = ["m0", "m1", "m2", "m3"]


def h32(*parts: str) -> str:
    """32 bits of the md5 of parts joined by ':'."""
    key = " || ':' || ".join(f"({p})::VARCHAR" for p in parts)
    return f"('0x' || substr(md5({key}), 1, 8))::BIGINT"


# --------------------------------------------------------------- generators
def uniform(low: float, high: float, *key: str) -> str:
    return f"({float(low)!r}::DOUBLE + {float(high) - float(low)!r}::DOUBLE * ({h32(*key)} / 4294967296.0::DOUBLE))"


def one_of(values, *key: str) -> str:
    return f"({list(values)!r})[{h32(*key)} % {len(values)} + 1]"


def clock(s: str) -> str:
    return f"format('{{:02d}}:{{:02d}}', floor(({s}) / 60)::BIGINT, floor(({s}) % 60)::BIGINT)"


def ident(task: str) -> str:
    return f"'{task}_' || substr(md5('{task}:0:' || i::VARCHAR), 1, 8)"


#: One instance a row of ``part``, one clip a row of ``supplier``.
INSTANCES = "(SELECT p_partkey AS i FROM part)"
SUPPLIERS = "(SELECT s_suppkey AS clip_id FROM supplier)"

CLIPS = """
SELECT 'background' AS kind, (['library', 'office'])[p_partkey % 2 + 1] AS category, 'bg/' || lpad(p_partkey::VARCHAR, 9, '0') || '.wav' AS path FROM part
UNION ALL SELECT DISTINCT 'needle', (['glass_shatter', 'pen_click', 'door_slam'])[p_size % 3 + 1], 'needle/' || (p_size % 3)::VARCHAR || '.wav' FROM part
UNION ALL SELECT DISTINCT 'clue', (['clock_chime', 'church_bell', 'train_whistle', 'ice_cream_truck'])[p_size % 4 + 1], 'clue/' || (p_size % 4)::VARCHAR || '.wav' FROM part
"""

_ANIH_KEY = ("'anih'", "0", "i")
GEN_ANIH = f"""
WITH clips AS ({CLIPS}), b AS (SELECT category, path, row_number() OVER (PARTITION BY category ORDER BY {h32('path')} % 1024, path) - 1 AS k, count(*) OVER (PARTITION BY category) AS n FROM clips WHERE kind = 'background'),
r AS (SELECT i, {one_of(('library', 'office', 'lecture'), *_ANIH_KEY, "'source'")} AS background_source, {one_of(('glass_shatter', 'pen_click', 'phone_notification', 'door_slam', 'keyboard_click'), *_ANIH_KEY, "'needle'")} AS needle_type,
  {uniform(30, 3570, *_ANIH_KEY, "'depth'")} AS at_s, {h32(*_ANIH_KEY, "'clip'")} AS pick FROM {INSTANCES} AS t)
SELECT {ident('anih')} AS instance_id, needle_type, background_source, b.path AS background_path, n.path AS needle_path, {r6('at_s')} AS at_s, {clock('at_s')} AS needle_timestamp,
  CASE background_source WHEN 'library' THEN 'pages turning' WHEN 'office' THEN 'keyboard typing' ELSE 'professor speaking' END AS preceding_sound,
  'Listen carefully to the entire audio recording. At what exact timestamp (in MM:SS format) did the ' || replace(needle_type, '_', ' ') || ' occur, and what environmental sound immediately preceded it (within 5 seconds)? Provide your answer as: ''Timestamp: MM:SS, Preceding sound: <description>''' AS prompt
FROM r JOIN b ON b.category = r.background_source AND b.k = r.pick % b.n JOIN clips n ON n.kind = 'needle' AND n.category = r.needle_type
"""

SPEAKERS = "SELECT (['voxceleb2', 'ami', 'librispeech'])[c_custkey % 3 + 1] AS dataset, c_name AS speaker_id FROM customer"

_DRAW = [h32("'speaker_drift'", "0", "i", "'speaker'", str(j)) for j in range(5)]
#: Five different numbers: each is moved past the smaller ones that were taken.
GEN_DRIFT = f"""
WITH s AS ({SPEAKERS}), z AS (SELECT dataset, count(*) AS n FROM s GROUP BY dataset HAVING count(*) >= 5),
q AS (SELECT dataset, speaker_id, row_number() OVER (PARTITION BY dataset ORDER BY {h32('speaker_id')} % 1024, speaker_id) - 1 AS k FROM s),
r AS (SELECT i, {one_of(('voxceleb2', 'ami', 'librispeech'), "'speaker_drift'", '0', 'i', "'dataset'")} AS dataset FROM {INSTANCES} AS t),
d AS (SELECT i, dataset, [{', '.join(f'{x} % (n - {j})' for j, x in enumerate(_DRAW))}] AS d FROM r JOIN z USING (dataset)),
p2 AS (SELECT i, dataset, d, [d[1], d[2] + (d[2] >= d[1])::INT] AS t FROM d),
a3 AS (SELECT *, list_sort(t) AS l, d[3] + (d[3] >= list_sort(t)[1])::INT AS x FROM p2),
p3 AS (SELECT i, dataset, d, list_append(t, x + (x >= l[2])::INT) AS t FROM a3),
a4 AS (SELECT *, list_sort(t) AS l, d[4] + (d[4] >= list_sort(t)[1])::INT AS x FROM p3),
b4 AS (SELECT *, x + (x >= l[2])::INT AS y FROM a4),
p4 AS (SELECT i, dataset, d, list_append(t, y + (y >= l[3])::INT) AS t FROM b4),
a5 AS (SELECT *, list_sort(t) AS l, d[5] + (d[5] >= list_sort(t)[1])::INT AS x FROM p4),
b5 AS (SELECT *, x + (x >= l[2])::INT AS y FROM a5),
c5 AS (SELECT *, y + (y >= l[3])::INT AS z FROM b5),
p5 AS (SELECT i, dataset, list_append(t, z + (z >= l[4])::INT) AS t FROM c5),
e AS (SELECT i, dataset, unnest(t) AS k, unnest(range(1, 6)) AS ord FROM p5)
SELECT i, {ident('speaker_drift')} AS instance_id, dataset, list(speaker_id ORDER BY ord) AS speaker_order FROM e JOIN q USING (dataset, k) GROUP BY i, dataset
"""

GEN_TURNS = f"""
WITH d AS ({GEN_DRIFT}), t AS (SELECT d.i, instance_id, speaker_order, k FROM d, range(47) AS r(k)),
x AS (SELECT *, CASE WHEN k < 5 THEN k WHEN k = 46 THEN 2 ELSE ([0, 1, 3, 4])[{h32("'turns'", '0', 'i', 'k')} % 4 + 1] END AS who,
  CASE WHEN k < 5 THEN k * 24.0::DOUBLE WHEN k = 46 THEN 2595.0::DOUBLE ELSE 120.0::DOUBLE + (k - 5) * (2475.0::DOUBLE / 41) END AS s, CASE WHEN k < 5 THEN 24.0::DOUBLE WHEN k = 46 THEN 10.0::DOUBLE ELSE 2475.0::DOUBLE / 41 END AS len FROM t)
SELECT instance_id, k AS ord, who AS speaker_idx, speaker_order[who + 1] AS speaker_id, {r6('s')} AS start_s, {r6('s + len')} AS end_s, CASE WHEN k < 5 THEN 'initial' WHEN k = 46 THEN 'target_return' ELSE 'middle' END AS kind FROM x
"""

EVENT_TYPES = (
    "rain_start", "rain_stop", "rain_heavy", "rain_light", "wind_start", "wind_stop", "wind_howling", "thunder", "siren_approaching", "siren_passing", "siren_receding", "dog_barking",
    "bird_chorus", "traffic_increase", "traffic_decrease", "footsteps", "door_open", "door_close", "engine_start", "engine_stop", "crowd_cheer", "crowd_applause", "music_start", "music_stop",
)

_SK = ("'soundscape'", "0", "i", "t")
GEN_SOUNDSCAPE = f"""
WITH e AS (SELECT i, t, ({list(EVENT_TYPES)!r})[t + 1] AS event_type, {h32(*_SK)} AS lot FROM {INSTANCES} AS a, range(24) AS b(t)),
f AS (SELECT i, arg_min(t, (lot, t)) AS f FROM e WHERE t < 8 GROUP BY i),
o AS (SELECT e.*, CASE WHEN t = f THEN 0 ELSE row_number() OVER (PARTITION BY e.i ORDER BY (t = f)::INT, lot, t) END AS ord FROM e JOIN f USING (i)),
l AS (SELECT *, {uniform(10, 120, *_SK, "'length'")} AS len FROM o WHERE ord < 6 + {h32("'soundscape'", '0', 'i', "'count'")} % 5),
s AS (SELECT *, coalesce(sum(CASE WHEN ord = 0 THEN 0.3::DOUBLE * len ELSE len END) OVER (PARTITION BY i ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM l),
w AS (SELECT *, least(s + len, 1800) AS e, list(struct_pack(event_type, s)) OVER (PARTITION BY i ORDER BY ord ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS recent FROM s WHERE s < 1800)
SELECT i, ord, event_type, {r6('s')} AS start_s, {r6('e')} AS end_s, {clock('s')} AS "start", CASE WHEN e < 1800 THEN {clock('e')} ELSE 'ongoing' END AS "end",
  CASE WHEN len(recent) > 0 AND {h32(*_SK, "'overlap'")} % 100 < 40 THEN recent[{h32(*_SK, "'which'")} % len(recent) + 1].event_type || ' (from ' || {clock(f"recent[{h32(*_SK, chr(39) + 'which' + chr(39))} % len(recent) + 1].s")} || ')' ELSE '' END AS overlap_names
FROM w
"""

#: With one background for each, of all.
GEN_SOUNDSCAPES = f"""
WITH b AS (SELECT path, row_number() OVER (ORDER BY {h32('path')} % 1024, path) - 1 AS k, count(*) OVER () AS n FROM ({CLIPS}) WHERE kind = 'background')
SELECT {ident('soundscape')} AS instance_id, b.path AS background_path, num_events, event_names
FROM (SELECT i, count(*) AS num_events, string_agg(event_type || ' ' || "start", '|' ORDER BY floor(start_s), ord) AS event_names FROM ({GEN_SOUNDSCAPE}) GROUP BY i) x
JOIN b ON b.k = {h32("'soundscape'", "0", "x.i", "'background'")} % b.n
"""

_NK = ("'narrative_coherence'", "0", "i")
GEN_NARRATIVE = f"""
WITH c AS (SELECT category, min(path) AS path FROM ({CLIPS}) WHERE kind = 'clue' GROUP BY category),
r AS (SELECT i, {one_of(('clock_chime', 'distinctive_bell', 'unique_bird_call', 'train_whistle', 'church_bell', 'factory_whistle', 'ice_cream_truck', 'emergency_alert'), *_NK, "'clue'")} AS clue_type,
  {uniform(.05, .15, *_NK, "'a'")} * 2400 AS a, {uniform(.35, .55, *_NK, "'b'")} * 2400 AS b, {uniform(.8, .95, *_NK, "'c'")} * 2400 AS c, {one_of(('Validates', 'Debunks'), *_NK, "'verdict'")} AS correct_verdict FROM {INSTANCES} AS t)
SELECT {ident('narrative_coherence')} AS instance_id, clue_type, c.path AS clue_path, correct_verdict, {clock('a')} AS clue_a_timestamp, {clock('b')} AS clue_b_timestamp, {clock('r.c')} AS clue_c_timestamp,
  {r6('a')} AS clue_a_s, {r6('b')} AS clue_b_s, {r6('r.c')} AS clue_c_s,
  'Identify the ' || replace(clue_type, '_', ' ') || ' at ' || {clock('a')} || '|Note the character''s reference to the ' || replace(clue_type, '_', ' ') || ' at ' || {clock('b')} || '|Compare suspect''s alibi at ' || {clock('r.c')} || ' with acoustic evidence' AS steps
FROM r JOIN c ON c.category = r.clue_type
"""

# ------------------------------------------------------------------ signals
#: Clips of 400 samples at 100 Hz: sin(0.1 k + clip), twice as loud for odd clips.
TONES = f"SELECT clip_id, k, (1 + clip_id % 2) * 0.7::DOUBLE * sin(k * 0.1::DOUBLE + clip_id) AS v FROM {SUPPLIERS} AS c, range(400) AS s(k)"
FORE = f"SELECT clip_id, k, CASE WHEN clip_id % 6 = 5 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE * cos(k * 0.3::DOUBLE + clip_id) END AS v FROM {SUPPLIERS} AS c, range(60) AS s(k)"

RMS = f"SELECT clip_id, {r6('sqrt(avg(v * v))')} AS rms FROM ({TONES}) GROUP BY clip_id"
PEAK = f"SELECT clip_id, k AS pos, {r6('v * CASE WHEN m > 1 THEN 0.95::DOUBLE / m ELSE 1 END')} AS v FROM (SELECT *, max(abs(v)) OVER (PARTITION BY clip_id) AS m FROM ({TONES}))"
#: 400 samples at 100 to 256 at 64: a sinc of 16 crossings a side under a Hann window, at times 25 n / 16.
RESAMPLED = f"""
WITH x AS ({TONES}), h AS (
  SELECT n, k, CASE WHEN d = 0 THEN 2.0::DOUBLE ELSE sin(pi() * 0.64::DOUBLE * d) / (pi() * 0.64::DOUBLE * d) * (1 + cos(pi() * 0.64::DOUBLE * d / 16)) END AS h
  FROM (SELECT n, k, n * 25 / 16.0::DOUBLE - k AS d FROM range(256) AS a(n), range(-30, 430) AS b(k)) WHERE abs(d) * 0.64::DOUBLE < 16
), w AS (SELECT n, sum(h) AS total FROM h GROUP BY n)
SELECT clip_id, n AS pos, {r6('sum(x.v * h.h / w.total)')} AS v FROM h JOIN w USING (n) JOIN x ON x.k = h.k GROUP BY clip_id, n
"""
#: The foreground of clip c starts at sample 37 + 61 (c mod 6): the last passes the end.
MIX = f"""
WITH b AS MATERIALIZED ({TONES}), f AS MATERIALIZED (SELECT clip_id, k + 37 + 61 * (clip_id % 6) AS k, v FROM ({FORE})), n AS MATERIALIZED (SELECT clip_id, min(k) AS a, max(k) AS z, sum(v * v) AS e FROM f GROUP BY clip_id),
g AS (SELECT b.clip_id, sum(v * v) AS e FROM b JOIN n ON n.clip_id = b.clip_id AND k BETWEEN a AND z GROUP BY b.clip_id)
SELECT p.clip_id, p.k AS pos, {r6("coalesce(b.v, 0) + coalesce(f.v, 0) * CASE WHEN n.e > 0 AND coalesce(g.e, 0) > 0 THEN 10 ** 0.5::DOUBLE * sqrt(g.e / n.e) ELSE 1 END")} AS v
FROM (SELECT clip_id, k FROM {SUPPLIERS} AS c, range(450) AS s(k) WHERE k < 400 OR clip_id % 6 = 5) p LEFT JOIN b USING (clip_id, k) LEFT JOIN f USING (clip_id, k) JOIN n ON n.clip_id = p.clip_id LEFT JOIN g ON g.clip_id = p.clip_id
"""
SUM = f"""
WITH x AS (SELECT clip_id, k, v FROM (SELECT clip_id, k + 400 * r AS k, v FROM ({TONES}), range(2) AS t(r)) WHERE k < 600
  UNION ALL SELECT clip_id, k + 90 + 50 * e, v * (e + 1) FROM ({FORE}), range(3) AS t(e)), s AS (SELECT clip_id, k, sum(v) AS v FROM x WHERE k < 600 GROUP BY clip_id, k), m AS (SELECT clip_id, max(abs(v)) AS m FROM s GROUP BY clip_id)
SELECT clip_id, k AS pos, {r6('v * CASE WHEN m > 1 THEN 0.95::DOUBLE / m ELSE 1 END')} AS v FROM s JOIN m USING (clip_id)
"""
#: Segments: (ord, start, end) = (0, 0, 120), (1, 100, 260), (2, 250, 250), (3, 255, 700), all of the clip's own tone; fades of 15 samples.
CONCAT = f"""
WITH RECURSIVE seg AS (SELECT * FROM (VALUES (0, 0, 120), (1, 100, 260), (2, 250, 250), (3, 255, 600)) AS s(o, a, z)),
l AS (
  SELECT 0 AS o, clip_id, k, 0.0::DOUBLE AS v FROM {SUPPLIERS} AS c, range(600) AS s(k)
  UNION ALL
  SELECT l.o + 1, l.clip_id, l.k,
    CASE WHEN z <= a THEN l.v ELSE l.v * CASE WHEN a > 0 AND l.k >= greatest(0, a - 15) AND l.k < a THEN 1 - (l.k - greatest(0, a - 15)) / (a - greatest(0, a - 15) - 1)::DOUBLE ELSE 1 END
      + CASE WHEN l.k >= a AND l.k < z AND l.k - a < 400 THEN (1 + l.clip_id % 2) * 0.7::DOUBLE * sin((l.k - a) * 0.1::DOUBLE + l.clip_id) * CASE WHEN a > 0 AND l.k < a + least(15, z - a) THEN (l.k - a) / (least(15, z - a) - 1)::DOUBLE ELSE 1 END ELSE 0 END END
  FROM l JOIN seg ON seg.o = l.o
), r AS (SELECT clip_id, k, v, max(abs(v)) OVER (PARTITION BY clip_id) AS m FROM l WHERE o = 4)
SELECT clip_id, k AS pos, {r6('v * CASE WHEN m > 1 THEN 0.95::DOUBLE / m ELSE 1 END')} AS v FROM r
"""


def mixed_audio(background: str, foreground: str, fore_n: int, at: str, snr_db: float) -> str:
    """A background with a foreground continued to fore_n samples from ``at`` on."""
    return f"""
WITH b AS MATERIALIZED ({background}), f AS MATERIALIZED (SELECT c.clip_id, s.k + {at} AS k, coalesce(x.v, 0) AS v FROM {SUPPLIERS} AS c CROSS JOIN range({fore_n}) AS s(k) LEFT JOIN ({foreground}) x ON x.clip_id = c.clip_id AND x.k = s.k),
n AS MATERIALIZED (SELECT clip_id, min(k) AS a, max(k) AS z, sum(v * v) AS e FROM f GROUP BY clip_id), g AS (SELECT b.clip_id, sum(v * v) AS e FROM b JOIN n ON n.clip_id = b.clip_id AND k BETWEEN a AND z GROUP BY b.clip_id)
SELECT b.clip_id, b.k AS pos, {r6(f"b.v + coalesce(f.v, 0) * CASE WHEN n.e > 0 AND g.e > 0 THEN 10 ** ({snr_db / 20!r}::DOUBLE) * sqrt(g.e / n.e) ELSE 1 END")} AS v
FROM b LEFT JOIN f USING (clip_id, k) JOIN n ON n.clip_id = b.clip_id JOIN g ON g.clip_id = b.clip_id
"""


#: A tone looped to 970 samples with 80 samples of foreground; a story cut to 330 with 100.
ANIH_AUDIO = mixed_audio(f"SELECT clip_id, k + 400 * r AS k, v FROM ({TONES}), range(3) AS t(r) WHERE k + 400 * r < 970", FORE, 80, "120 + 31 * (c.clip_id % 6)", 10.0)
NARRATIVE_AUDIO = mixed_audio(f"SELECT clip_id, k, v FROM ({TONES}) WHERE k < 330", FORE, 100, "15 + 21 * (c.clip_id % 6)", 5.0)

#: Three turns of 2 s at 100 Hz, of the clip's own tone and of the next two; fades of 1 sample.
DRIFT_AUDIO = f"""
WITH n AS (SELECT count(*) AS n FROM supplier), p AS (SELECT c.clip_id, o, (c.clip_id + o) % n.n AS source, 200 * o AS a FROM {SUPPLIERS} AS c, range(3) AS t(o), n),
x AS (SELECT p.clip_id, t.k + a AS k, CASE WHEN o > 0 AND t.k = 0 THEN 0.0::DOUBLE ELSE t.v END AS v FROM p JOIN ({TONES}) t ON t.clip_id = p.source AND t.k < 200)
SELECT clip_id, k AS pos, {r6('v * CASE WHEN m > 1 THEN 0.95::DOUBLE / m ELSE 1 END')} AS v FROM (SELECT *, max(abs(v)) OVER (PARTITION BY clip_id) AS m FROM x)
"""
OVERLAP = f"""
WITH x AS (SELECT event_id, user_id, event_type, epoch(date_trunc('second', ts))::DOUBLE AS s, epoch(date_trunc('second', ts))::DOUBLE + 600 + event_id % 7200 AS e FROM events)
SELECT a.event_id AS event_id, b.event_id AS event_id_r, least(a.e, b.e) - greatest(a.s, b.s) AS overlap_s FROM x a JOIN x b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e AND a.event_id < b.event_id
"""
DEDUPE = "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"

# ---------------------------------------------------------------- bootstrap
_WORDS = "18446744073709551616::UHUGEINT"
_GOLDEN = "11400714819323198485::UHUGEINT"


def _plus(a: str, b: str) -> str:
    """a + b * golden ratio, modulo 2^64."""
    return f"((({a})::UHUGEINT + ({b})::UHUGEINT * {_GOLDEN}) % {_WORDS})::UBIGINT"


def _mixed(x: str) -> str:
    """The finishing steps of a 64-bit counter; a list of one binds what is used twice."""
    for shift, factor in ((30, 13787848793156543929), (27, 10723151780598845931)):
        x = f"list_transform([{x}], lambda y: ((xor(y, y >> {shift})::UHUGEINT * {factor}::UHUGEINT) % {_WORDS})::UBIGINT)[1]"
    return f"list_transform([{x}], lambda y: xor(y, y >> 31))[1]"


def bootstrap_draws(replicates: int, confidence: float = 0.95) -> str:
    """A state is a node of a replicate's tree while its binomial number is
    counted: draws left, rest of the probability, draws below so far."""
    tail = (1 - confidence) / 2
    word = _mixed(_plus("node_seed", "((step::UBIGINT << 40) + j::UBIGINT)"))
    zeros = f"coalesce(list_sum(list_transform(range((m + 63) // 64), lambda j: bit_count({word} & (18446744073709551615::UBIGINT >> (64 - least(64, m - 64 * j))::UBIGINT)))), 0)::BIGINT"
    child = "(node * 2 + c.child)::UBIGINT"
    return f"""
WITH RECURSIVE v AS (
  SELECT task, model, metric, q, c, sum(c) OVER (PARTITION BY task, model, metric ORDER BY q)::BIGINT AS u
  FROM (SELECT task, model, metric, round(value / 0.000001::DOUBLE)::BIGINT AS q, count(*)::BIGINT AS c FROM ({LONG}) WHERE value IS NOT NULL GROUP BY ALL)
), g AS MATERIALIZED (
  SELECT task, model, metric, ('0x' || substr(md5(task || ':' || model || ':' || metric), 1, 15))::UBIGINT AS seed,
         list(q ORDER BY q) AS qs, list_prepend(0::BIGINT, list(u ORDER BY q)) AS upto, sum(c)::BIGINT AS n, count(*)::BIGINT AS d
  FROM v GROUP BY task, model, metric
), s AS (
  SELECT task, model, metric, rep, seed, {_mixed(_plus('seed', '1'))} AS node_seed, 1::UBIGINT AS node, 0::BIGINT AS lo, d AS hi, n AS total, 0 AS step, n AS m, upto[d // 2 + 1] AS rest, 0::BIGINT AS below
  FROM (SELECT * REPLACE ({_mixed(_plus('seed', 'rep'))} AS seed) FROM g, range({replicates}) AS r(rep))
  UNION ALL
  SELECT task, model, metric, rep, seed,
         CASE WHEN done THEN {_mixed(_plus('seed', child))} ELSE node_seed END,
         CASE WHEN done THEN {child} ELSE node END,
         CASE WHEN done AND c.child = 1 THEN mid ELSE lo END, CASE WHEN done AND c.child = 0 THEN mid ELSE hi END,
         CASE WHEN done THEN CASE c.child WHEN 0 THEN below ELSE total - below END ELSE total END,
         CASE WHEN done THEN 0 ELSE step + 1 END,
         CASE WHEN done THEN CASE c.child WHEN 0 THEN below ELSE total - below END ELSE m END,
         CASE WHEN NOT done THEN rest WHEN c.child = 0 THEN upto[(lo + mid) // 2 + 1] - upto[lo + 1] ELSE upto[(mid + hi) // 2 + 1] - upto[mid + 1] END,
         CASE WHEN done THEN 0 ELSE below END
  FROM (
    SELECT *, m = 0 OR rest = 0 AS done FROM (
      SELECT * REPLACE (below + CASE WHEN one THEN zeros ELSE 0 END AS below, CASE WHEN one THEN m - zeros ELSE zeros END AS m, 2 * rest - CASE WHEN one THEN whole ELSE 0 END AS rest) FROM (
        SELECT s.*, g.upto, (lo + hi) // 2 AS mid, g.upto[hi + 1] - g.upto[lo + 1] AS whole, 2 * rest >= g.upto[hi + 1] - g.upto[lo + 1] AS one, {zeros} AS zeros
        FROM s JOIN g USING (task, model, metric) WHERE hi - lo > 1 AND total > 0
      )
    )
  ), (VALUES (0), (1)) AS c(child) WHERE done OR c.child = 0
), t AS (
  SELECT task, model, metric, rep, sum(total * g.qs[lo + 1])::BIGINT AS total, any_value(g.n) AS n FROM s JOIN g USING (task, model, metric) WHERE hi - lo = 1 GROUP BY ALL
)
SELECT task, model, metric, n, {r6(f"quantile_cont(total, {tail!r}) / n * 0.000001::DOUBLE")} AS ci_lo, {r6(f"quantile_cont(total, {1 - tail!r}) / n * 0.000001::DOUBLE")} AS ci_hi FROM t GROUP BY task, model, metric, n
"""
