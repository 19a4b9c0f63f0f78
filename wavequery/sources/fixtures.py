"""Inputs of the evaluation queries, derived from the table ``events``.

Each is SQL that Spark and DuckDB read alike, with ``{events}`` for the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def mmss(x: str) -> str:
    return f"lpad(cast(cast(floor(({x}) / 60) as bigint) as string), 2, '0') || ':' || lpad(cast(({x}) % 60 as string), 2, '0')"


ANIH = f"""
SELECT event_id, model, gt_sound, {mmss('ts_true')} AS needle_timestamp,
       CASE event_id % 5
         WHEN 3 THEN 'I heard nothing.'
         WHEN 2 THEN 'At ' || {mmss('ts_pred')} || ' the sound was ' || p_sound || '.'
         ELSE 'Timestamp: ' || {mmss('ts_pred')} || ', Preceding sound: ' || p_sound || chr(10) || 'more text'
       END AS response
FROM (
  SELECT event_id, 'm' || cast(event_id % 4 as string) AS model,
         30 + (event_id * 37) % 3540 AS ts_true,
         30 + (event_id * 37) % 3540 + (event_id * 7) % 13 - 6 AS ts_pred,
         CASE event_type WHEN 'click' THEN 'keyboard typing' WHEN 'view' THEN 'pages turning' WHEN 'error' THEN 'professor speaking' ELSE 'ambient noise' END AS gt_sound,
         CASE cast(floor(value) as bigint) % 3 WHEN 0 THEN 'pages turning' WHEN 1 THEN 'loud keyboard typing' ELSE 'ambient noise' END AS p_sound
  FROM {{events}}
) AS x
"""

DRIFT = f"""
SELECT event_id, 'm' || cast(event_id % 4 as string) AS model, cast(1 + user_id % 5 as int) AS target_speaker_id,
       CASE WHEN event_id % 11 <> 0 THEN {mmss('60 + event_id % 7 * 10')} END AS first_appearance_timestamp,
       CASE event_id % 6
         WHEN 1 THEN 'Speaker: ' || p || ', First appearance: Never'
         WHEN 2 THEN 'Speaker: ' || p || ', First appearance: "Never"'
         WHEN 3 THEN 'Speaker ' || p || ', first appearance: 01:30, maybe'
         WHEN 4 THEN 'I do not know.'
         WHEN 5 THEN 'It was speaker ' || p || '.'
         ELSE 'Speaker: ' || p || ', First appearance: ' || {mmss('60 + event_id % 9 * 10')}
       END AS response
FROM (SELECT *, cast(1 + (user_id + event_id % 3) % 5 as string) AS p FROM {{events}}) AS x
"""


def _soundscape(key: str = "") -> str:
    """``key``: a column that goes through, the same in all rows of an instance."""
    return f"""
SELECT {key}instance_id, model, ord, event_type, {mmss('start_s')} AS start_ts,
       CASE WHEN event_id % 7 = 0 THEN 'ongoing' ELSE {mmss('start_s + dur')} END AS end_ts,
       CASE WHEN event_id % 3 = 0 THEN 'rain_start' ELSE '' END AS overlap_names,
       CASE WHEN event_id % 9 = 4 THEN '' ELSE
         CASE WHEN event_id % 4 = 3
           THEN cast(ord as string) || '. ' || p_type || ', ' || p_start || ', ' || p_end
           ELSE cast(ord as string) || '. Event: ' || p_type || ', Start: ' || p_start || ', End: ' || p_end ||
                CASE WHEN event_id % 6 < 3 THEN ', Overlaps: ' || CASE WHEN event_id % 6 = 0 THEN 'rain_start, wind' ELSE 'wind' END ELSE '' END
         END || CASE WHEN event_id % 8 = 5 THEN chr(10) || '  ' || chr(10) || '9) ' || event_type || '; ' || p_start || '; ' || p_end ELSE '' END
       END AS line
FROM (
  SELECT *, CASE WHEN event_id % 10 = 3 THEN upper(event_type) ELSE event_type END AS p_type,
         {mmss('greatest(0, start_s + event_id % 25 - 12)')} AS p_start,
         CASE WHEN event_id % 7 = 0 THEN 'ongoing' ELSE {mmss('greatest(0, start_s + event_id % 25 - 12) + dur')} END AS p_end
  FROM (
    SELECT {key}event_id, event_type, 'u' || cast(user_id as string) || '_' || day || '_' || cast(cast(floor((n - 1) / 8) as bigint) as string) AS instance_id,
           'm' || cast(user_id % 4 as string) AS model, (n - 1) % 8 + 1 AS ord, start_s, dur
    FROM (
      SELECT {key}event_id, event_type, user_id, cast(cast(ts as date) as string) AS day,
             row_number() OVER (PARTITION BY {key}user_id, cast(ts as date) ORDER BY ts, event_id) AS n,
             (hour(ts) * 60 + minute(ts)) % 1800 AS start_s, 10 + event_id % 111 AS dur
      FROM {{events}}
    ) AS w
  ) AS x
) AS y
"""


#: One row per true event; its prediction is in the last columns.  An instance
#: has eight events of a user and day, or what is left of them.
SOUNDSCAPE = _soundscape()

NARRATIVE = f"""
SELECT event_id, 'm' || cast(event_id % 4 as string) AS model, correct_verdict, t_a, t_b, t_c, r_a, r_b, r_c,
       CASE event_id % 7 WHEN 6 THEN 'No idea.' ELSE
         CASE WHEN event_id % 7 = 5 THEN 'verdict: ' || lower(p_verdict) ELSE 'Verdict: ' || p_verdict END || '. Reasoning:' ||
         CASE WHEN event_id % 4 >= 1 THEN ' Step 1: Identify the bell at ' || t_a || '.' ELSE '' END ||
         CASE WHEN event_id % 4 >= 2 THEN ' Step 2: A character notes it at ' || CASE WHEN event_id % 3 = 0 THEN '11:11' ELSE t_b END || '..' ELSE '' END ||
         CASE WHEN event_id % 4 >= 3 THEN ' step 3: Nothing fits' ELSE '' END
       END AS response
FROM (
  SELECT *, {mmss('s_a')} AS t_a, {mmss('s_b')} AS t_b, {mmss('s_c')} AS t_c,
         'Identify the distinctive bell at ' || {mmss('s_a')} AS r_a,
         'Note the reference of the character to the bell at ' || {mmss('s_b')} AS r_b,
         'Compare the alibi at ' || {mmss('s_c')} || ' with acoustic evidence' AS r_c
  FROM (
    SELECT event_id, CASE event_id % 2 WHEN 0 THEN 'Validates' ELSE 'Debunks' END AS correct_verdict,
           CASE event_id % 3 WHEN 0 THEN 'Validates' WHEN 1 THEN 'Debunks' ELSE 'Inconclusive' END AS p_verdict,
           120 + (event_id * 13) % 240 AS s_a, 840 + (event_id * 29) % 480 AS s_b, 1920 + (event_id * 31) % 360 AS s_c
    FROM {{events}}
  ) AS x
) AS y
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def table(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, events=events(spark, sf_dir))


def soundscape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """instance_id, model, true_events and response: eight rows per instance at
    most are gathered.

    Events are shuffled once, by user and day: they are numbered and gathered
    where they are then.  Those without either have no instance and one key, so
    that they still meet.  Rows are few bytes here and much work later, so Spark
    isn't left to join partitions by their bytes."""
    day = F.when(F.col("user_id").isNotNull() & F.col("ts").isNotNull(), F.xxhash64("user_id", F.col("ts").cast("date")))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 4 * spark.sparkContext.defaultParallelism)
    placed = events(spark, sf_dir).withColumn("at", day).repartition(parts, "at")
    rows = spark.sql(_soundscape("at, "), events=placed)
    # One list of events with their lines: each is gathered and sorted once.
    event = F.struct(F.col("event_type"), F.col("start_ts").alias("start"), F.col("end_ts").alias("end"), F.col("overlap_names").alias("overlaps"))
    lists = rows.groupBy("at", "instance_id", "model").agg(F.sort_array(F.collect_list(F.struct("ord", event.alias("event"), "line"))).alias("t"))
    return lists.select("instance_id", "model", F.col("t.event").alias("true_events"), F.array_join("t.line", "\n").alias("response"))
