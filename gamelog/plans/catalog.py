"""Registered queries: each runs an operator of the engine over the given tables.

``QUERIES[name]`` is ``(spark, sf_dir) -> DataFrame``; ``ORACLE[name]`` is the same question in
plain SQL over the raw tables (DuckDB dialect), used as the correctness oracle. Column names
and types of both sides match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gamelog.operators import replay, serve
from gamelog.plans.oracle import EV_CTE, GM_CTE, NEWEST_CTE
from gamelog.plans.registry import BATCH_ORACLE, BATCH_QUERIES, ORACLE, QUERIES, register  # noqa: F401
from gamelog.sources import testdata as td

# ---- fixed values: query parameters ----
REPLAY_SINCE = "2024-01-05 00:00:00"
REPLAY_UNTIL = "2024-01-20 00:00:00"
REPLAY_SPEED = 10.0
TOP_K = 5  # fewer than most games have, so that rows are cut
# ---- end of fixed values ----


def _ev(spark, sf):
    return td.events_table(spark, sf)


def _gm(spark, sf):
    return td.games_table(spark, sf)


# ------------------------------------------------------------------ serving (Q1-Q6)


@register("latest_per_active_game", f"""
WITH {EV_CTE}, {GM_CTE}, {NEWEST_CTE}
SELECT game_pk, home_team, away_team, status, pitch.i AS event_id, pitch.t AS event_time,
       pitch.s AS source_time, pitch.n AS ingest_time, pitch.p AS payload
FROM newest""")
def q_latest_per_active_game(spark, sf):
    return serve.latest_pitch_per_active_game(_ev(spark, sf), _gm(spark, sf))


@register("recent_pitches_per_game", f"""
WITH {EV_CTE}
SELECT game_pk, event_id, event_time, source_time, ingest_time, payload,
       CAST(row_number() OVER (PARTITION BY game_pk ORDER BY event_time DESC, event_id DESC)
            AS BIGINT) AS rank, least(count(*) OVER (PARTITION BY game_pk), {TOP_K}) AS count
FROM ev WHERE sport = 'mlb' AND event_type = 'pitch'
QUALIFY rank <= {TOP_K}""")
def q_recent_pitches_per_game(spark, sf):
    return serve.recent_pitches_per_game(_ev(spark, sf), TOP_K)


@register("recent_events_per_game", f"""
WITH {EV_CTE}
SELECT game_pk, event_id, event_time, source_time, ingest_time, payload,
       CAST(row_number() OVER (PARTITION BY game_pk ORDER BY event_time DESC, event_id DESC)
            AS BIGINT) AS rank, least(count(*) OVER (PARTITION BY game_pk), {TOP_K}) AS count
FROM ev WHERE sport = 'mlb'
QUALIFY rank <= {TOP_K}""")
def q_recent_events_per_game(spark, sf):
    return serve.recent_events_per_game(_ev(spark, sf), TOP_K)


def _iso_sql(col: str) -> str:
    return (f"CASE WHEN epoch_us({col}) % 1000000 = 0 THEN strftime({col}, '%Y-%m-%dT%H:%M:%S') "
            f"ELSE strftime({col}, '%Y-%m-%dT%H:%M:%S.%f') END || '+00:00'")


@register("response_rows", f"""
WITH {EV_CTE}, {GM_CTE}, {NEWEST_CTE}
SELECT game_pk, home_team, away_team, status, pitch.i AS event_id,
       {_iso_sql('pitch.t')} AS event_time, {_iso_sql('pitch.s')} AS source_time,
       {_iso_sql('pitch.n')} AS ingest_time, CAST(json(pitch.p) AS VARCHAR) AS payload
FROM newest""")
def q_response_rows(spark, sf):
    return serve.shape_rows(serve.latest_pitch_per_active_game(_ev(spark, sf), _gm(spark, sf)))


# ------------------------------------------------------------------ replay (R1-R3)


@register("replay_ordered_range", f"""
WITH {EV_CTE}
SELECT game_pk, event_id, event_time, payload,
       CAST(row_number() OVER (PARTITION BY game_pk ORDER BY event_time, event_id) - 1
            AS BIGINT) AS seq
FROM ev
WHERE event_type = 'pitch' AND event_time >= TIMESTAMP '{REPLAY_SINCE}'
  AND event_time <= TIMESTAMP '{REPLAY_UNTIL}'""")
def q_replay_ordered_range(spark, sf):
    rows = replay.replay_sequence(_ev(spark, sf), since=F.lit(REPLAY_SINCE).cast("timestamp_ntz"),
                                  until=F.lit(REPLAY_UNTIL).cast("timestamp_ntz"))
    return rows.select("game_pk", "event_id", "event_time", "payload", "seq")


@register("replay_schedule", f"""
WITH {EV_CTE},
p AS (SELECT game_pk, event_id, event_time,
             lag(event_time) OVER w AS prev_time,
             first_value(event_time) OVER w AS first_time,
             CAST(row_number() OVER w - 1 AS BIGINT) AS seq
      FROM ev WHERE event_type = 'pitch'
      WINDOW w AS (PARTITION BY game_pk ORDER BY event_time, event_id))
SELECT game_pk, event_id, event_time, seq,
       CASE WHEN prev_time IS NOT NULL THEN greatest(
         CAST(epoch_us(event_time) - epoch_us(prev_time) AS DOUBLE) / 1e6 / CAST({REPLAY_SPEED} AS DOUBLE),
         CAST(0 AS DOUBLE)) END AS wait_s,
       CAST(epoch_us(event_time) - epoch_us(first_time) AS DOUBLE) / 1e6 / CAST({REPLAY_SPEED} AS DOUBLE)
         AS release_offset_s
FROM p""")
def q_replay_schedule(spark, sf):
    return replay.replay_schedule(_ev(spark, sf), speed=REPLAY_SPEED)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_latest_per_active_game(spark, sf_dir)


# The remaining query families register themselves on import.
from gamelog.plans import ids_queries, ingest_queries, log_queries, metric_queries, table_queries  # noqa: E402,F401
