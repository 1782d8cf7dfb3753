"""Queries over landed documents: schedule keys, pitch and game-state extraction, the
publish cursor and the games upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gamelog.functions.times import to_ntz
from gamelog.operators import cursor, extract, writes
from gamelog.plans.oracle import FEED_CTE, GM_CTE
from gamelog.plans.registry import FIXED_NOW, register
from gamelog.sources import testdata as td

NOW_SQL = f"TIMESTAMP '{FIXED_NOW}'"
PITCH_OUT = ["event_id", "event_type", "sport", "game_pk", "event_time", "source_time",
             "ingest_time", "at_bat_index", "pitch_number", "inning", "inning_half", "batter_id",
             "batter_name", "pitcher_id", "pitcher_name", "pitch_type", "pitch_type_description",
             "start_speed_mph", "end_speed_mph", "spin_rate_rpm", "balls", "strikes", "outs",
             "call_code", "call_description", "is_in_play", "is_strike", "is_ball", "valid",
             "play_pos", "event_pos"]
# what the event's own JSON text says
RAW_OUT = {"raw_pitch_number": "$.pitchNumber", "raw_type": "$.details.type.code", "raw_spin": "$.pitchData.breaks.spinRate"}


def _now():
    return F.lit(FIXED_NOW).cast("timestamp")


def pitches(spark: SparkSession, sf: str) -> DataFrame:
    return extract.extract_pitches(td.feed_documents(spark, sf), _now())


def _ntz(df: DataFrame, cols=("event_time", "source_time", "ingest_time", "updated_at",
                              "start_time")) -> DataFrame:
    for c in cols:
        if c in df.columns:
            df = df.withColumn(c, to_ntz(F.col(c)))
    return df


# Flat pitches of the feed documents (mirrors extract.extract_pitches on feed_documents).
PITCHES_CTE = f"""{FEED_CTE},
px AS (
  SELECT doc_id, 0 AS play_pos, event_pos,
    CASE WHEN NOT (l_returnflag = 'R' AND l_linestatus = 'F') THEN CAST(l_linenumber AS VARCHAR) END AS raw_pitch_number,
    l_returnflag || l_linestatus AS raw_type,
    CASE WHEN l_returnflag <> 'R' THEN CAST(l_partkey AS VARCHAR) || '.0' END AS raw_spin, 'mlb:' || game_pk || ':pitch:' || CAST(o_orderkey AS VARCHAR) || ':'
           || CAST(pn AS VARCHAR) AS event_id,
    'pitch' AS event_type, 'mlb' AS sport, game_pk,
    CASE WHEN l_linestatus <> 'O' THEN l_shipdate ELSE coalesce(meta_ts, {NOW_SQL}) END AS event_time,
    coalesce(meta_ts, {NOW_SQL}) AS source_time, {NOW_SQL} AS ingest_time,
    CAST(o_orderkey AS INTEGER) AS at_bat_index, CAST(pn AS INTEGER) AS pitch_number,
    CAST(floor(o_totalprice / 100000) + 1 AS INTEGER) AS inning,
    CASE o_orderstatus WHEN 'F' THEN 'top' WHEN 'O' THEN 'bottom' END AS inning_half,
    o_custkey * 10 AS batter_id, 'Batter ' || CAST(o_custkey AS VARCHAR) AS batter_name,
    o_orderkey + 1000000 AS pitcher_id, 'Pitcher ' || CAST(o_orderkey AS VARCHAR) AS pitcher_name,
    l_returnflag || l_linestatus AS pitch_type,
    CASE WHEN l_returnflag <> 'A' THEN 'type ' || l_returnflag END AS pitch_type_description,
    70.0 + l_quantity / 2 AS start_speed_mph,
    CASE WHEN l_discount <= 0.05 THEN 70.0 + l_quantity / 2 - 8 END AS end_speed_mph,
    CASE WHEN l_returnflag <> 'R' THEN CAST(l_partkey AS DOUBLE) END AS spin_rate_rpm,
    CAST(least(l_linenumber - 1, 3) AS INTEGER) AS balls,
    CAST(least(floor(l_quantity / 20), 2) AS INTEGER) AS strikes,
    CAST(floor((l_linenumber + 1) / 3) AS INTEGER) AS outs,
    l_linestatus AS call_code,
    CASE WHEN l_linestatus = 'F' THEN 'Called' END AS call_description,
    CASE WHEN l_discount > 0.02 THEN l_discount > 0.05 END AS is_in_play,
    l_tax > 0.04 AS is_strike,
    CASE WHEN l_tax > 0 THEN l_tax <= 0.04 END AS is_ball,
    game_pk <> '' AS valid
  FROM fl WHERE l_returnflag <> 'N' AND pn IS NOT NULL)"""


@register("extract_pitches", f"""
WITH {PITCHES_CTE}
SELECT {", ".join([*PITCH_OUT, *RAW_OUT])} FROM px""")
def q_extract_pitches(spark, sf):
    raw = [F.get_json_object("raw_payload_json", path).alias(n) for n, path in RAW_OUT.items()]
    return _ntz(pitches(spark, sf).select(*PITCH_OUT, *raw))


STATE_OUT = ["event_id", "event_type", "sport", "game_pk", "event_time", "source_time",
             "ingest_time", "status", "home_team", "away_team", "home_score", "away_score",
             "inning", "inning_half", "valid"]

STATES_CTE = f"""{FEED_CTE},
st AS (
  SELECT doc_id, CAST(o_custkey AS VARCHAR) AS payload_pk, 'mlb:' || game_pk || ':game:state:' ||
      CASE WHEN meta_ts IS NULL THEN '{FIXED_NOW.replace(' ', 'T')}+00:00'
           WHEN o_orderstatus = 'P' THEN strftime(meta_ts, '%Y-%m-%dT%H:%M:%S')
           ELSE strftime(meta_ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS event_id,
    'game_state' AS event_type, 'mlb' AS sport, game_pk,
    o_orderdate AS event_time, coalesce(meta_ts, {NOW_SQL}) AS source_time,
    {NOW_SQL} AS ingest_time,
    CASE o_orderstatus WHEN 'O' THEN 'In Progress' WHEN 'F' THEN 'Final' ELSE 'Warmup' END AS status,
    'Home ' || CAST(o_custkey AS VARCHAR) AS home_team, 'Away ' || o_orderpriority AS away_team,
    CAST(length(o_orderpriority) AS INTEGER) AS home_score, chunk AS away_score,
    CAST(floor(o_totalprice / 100000) + 1 AS INTEGER) AS inning,
    CASE o_orderstatus WHEN 'F' THEN 'top' WHEN 'O' THEN 'bottom' END AS inning_half,
    game_pk <> '' AS valid
  FROM docs)"""


@register("extract_game_state", f"""
WITH {STATES_CTE}
SELECT {", ".join(STATE_OUT)} FROM st""")
def q_extract_game_state(spark, sf):
    states = extract.extract_game_state(td.feed_documents(spark, sf), _now())
    return _ntz(states.select(*STATE_OUT))


@register("upsert_games", f"""
WITH {STATES_CTE}, {GM_CTE},
inc AS (SELECT DISTINCT ON (game_pk) * FROM st WHERE valid
        ORDER BY game_pk, source_time DESC, event_id DESC, doc_id DESC)
SELECT coalesce(i.game_pk, g.game_pk) AS game_pk, coalesce(g.sport, i.sport) AS sport,
       CASE WHEN i.game_pk IS NOT NULL THEN nullif(i.status, '') ELSE g.status END AS status,
       CASE WHEN i.game_pk IS NOT NULL THEN nullif(i.home_team, '') ELSE g.home_team END AS home_team,
       CASE WHEN i.game_pk IS NOT NULL THEN nullif(i.away_team, '') ELSE g.away_team END AS away_team,
       CASE WHEN i.game_pk IS NOT NULL THEN i.event_time ELSE g.start_time END AS start_time,
       CASE WHEN i.game_pk IS NOT NULL THEN {NOW_SQL} ELSE g.updated_at END AS updated_at,
       i.payload_pk, i.status AS payload_status
FROM gm g FULL OUTER JOIN inc i ON g.game_pk = i.game_pk""")
def q_upsert_games(spark, sf):
    states = extract.extract_game_state(td.feed_documents(spark, sf), _now())
    states = states.filter("valid").withColumn("event_time", to_ntz(F.col("event_time")))
    out = writes.upsert_games(td.games_table(spark, sf), states, F.lit(FIXED_NOW),
                              order=("source_time", "event_id", "doc_id"))
    stored = {"payload_pk": "$.gameData.game.pk", "payload_status": "$.gameData.status.detailedState"}
    return _ntz(out.select("*", *[F.get_json_object("payload", p).alias(n) for n, p in stored.items()]).drop("payload"))


# ------------------------------------------------------------ schedule S1-S5

SCHED_CTE = """sg AS (
  SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_custkey END AS gk,
    CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN NULL
         ELSE CASE c_mktsegment WHEN 'BUILDING' THEN 'I' WHEN 'MACHINERY' THEN 'P'
                                WHEN 'FURNITURE' THEN 'F' WHEN 'AUTOMOBILE' THEN 'IH' END END AS code,
    CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN NULL
         ELSE CASE c_mktsegment WHEN 'BUILDING' THEN 'Live' WHEN 'MACHINERY' THEN 'Live'
                                WHEN 'FURNITURE' THEN 'Final' END END AS abstract
  FROM customer),
lv AS (SELECT *, coalesce(code, '') IN ('I', 'IR', 'IH', 'IO', 'IP')
                 OR coalesce(abstract, '') = 'Live' AS live FROM sg)"""


def _schedule_games(spark, sf):
    return extract.schedule_games(td.schedule_documents(spark, sf))


@register("schedule_live_keys", f"""
WITH {SCHED_CTE}
SELECT DISTINCT CAST(gk AS VARCHAR) AS game_pk FROM lv WHERE live AND coalesce(gk, 0) <> 0""")
def q_schedule_live_keys(spark, sf):
    return extract.live_game_keys(_schedule_games(spark, sf))


@register("newly_live", f"""
WITH {SCHED_CTE}, {GM_CTE}
SELECT DISTINCT CAST(gk AS VARCHAR) AS game_pk FROM lv WHERE live AND coalesce(gk, 0) <> 0
  AND CAST(gk AS VARCHAR) NOT IN (SELECT game_pk FROM gm WHERE status = 'In Progress')""")
def q_newly_live(spark, sf):
    keys = extract.live_game_keys(_schedule_games(spark, sf))
    return extract.newly_live(keys, td.tracked_games(spark, sf))


@register("live_counts", f"""
WITH {SCHED_CTE}
SELECT count(*) AS total_games, count(*) FILTER (WHERE live) AS live_games FROM lv""")
def q_live_counts(spark, sf):
    return extract.live_counts(_schedule_games(spark, sf))


# ------------------------------------------------------------ cursor C1-C5

CURSOR_CTE = """cur AS (
  SELECT CAST(o_custkey AS VARCHAR) AS game_pk, CAST(min(o_orderkey) AS INTEGER) AS last_at_bat_index,
         3 AS last_pitch_number,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(o_custkey) AS updated_at
  FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey),
mk AS (
  SELECT p.*, c.last_at_bat_index IS NOT NULL
           AND (p.at_bat_index, p.pitch_number) <= (c.last_at_bat_index, c.last_pitch_number)
           AS skip
  FROM px p LEFT JOIN cur c ON c.game_pk = p.game_pk)"""


def _marked(spark, sf):
    return cursor.mark_published(pitches(spark, sf), td.cursor_table(spark, sf))


@register("cursor_filter", f"""
WITH {PITCHES_CTE}, {CURSOR_CTE}
SELECT event_id, game_pk, at_bat_index, pitch_number FROM mk WHERE NOT skip""")
def q_cursor_filter(spark, sf):
    kept = cursor.cursor_filter(pitches(spark, sf), td.cursor_table(spark, sf))
    return kept.select("event_id", "game_pk", "at_bat_index", "pitch_number")


@register("cursor_counts", f"""
WITH {PITCHES_CTE}, {CURSOR_CTE}
SELECT game_pk, count(*) FILTER (WHERE NOT skip) AS published,
       count(*) FILTER (WHERE skip) AS skipped
FROM mk GROUP BY game_pk""")
def q_cursor_counts(spark, sf):
    return cursor.cursor_counts(_marked(spark, sf))


# Documents with several plays (mirrors testdata.poll_documents).
POLL_CTE = f"""li AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_orderkey, l_partkey, l_suppkey,
      l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
      l_shipdate) - 1 AS li_pos
  FROM lineitem),
od AS (SELECT o_orderkey, o_custkey, o_orderdate,
         (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // {td.POLL_PLAYS} AS part FROM orders),
pl AS (
  SELECT *, li_pos // 64 AS chunk, CAST(li_pos % 64 AS INTEGER) AS event_pos,
         CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F'
              THEN CASE WHEN l_quantity > 45 THEN NULL ELSE l_linenumber - 1 END ELSE l_linenumber END AS pn
  FROM li JOIN od ON l_orderkey = o_orderkey),
px AS (
  SELECT CASE WHEN o_custkey <> 0 THEN CAST(o_custkey AS VARCHAR) ELSE '' END AS game_pk,
         CAST(o_orderkey AS INTEGER) AS at_bat_index, CAST(pn AS INTEGER) AS pitch_number, event_pos, l_returnflag, l_linestatus, l_shipdate,
         o_custkey || '/' || part || '/' || chunk AS doc_id,
         CAST(dense_rank() OVER (PARTITION BY o_custkey, part, chunk ORDER BY o_orderkey) - 1 AS INTEGER) AS play_pos,
         max(o_orderdate) OVER (PARTITION BY o_custkey, part, chunk) AS source_time
  FROM pl)"""


@register("extract_new_pitches", f"""
WITH {POLL_CTE}, {CURSOR_CTE}
SELECT 'mlb:' || game_pk || ':pitch:' || at_bat_index || ':' || pitch_number AS event_id, game_pk, doc_id,
       play_pos, event_pos, at_bat_index, pitch_number, source_time,
       CASE WHEN l_linestatus <> 'O' THEN l_shipdate ELSE source_time END AS event_time
FROM mk WHERE NOT skip AND l_returnflag <> 'N' AND pitch_number IS NOT NULL AND at_bat_index % {td.POLL_NAMELESS} <> 0""")
def q_extract_new_pitches(spark, sf):
    new = extract.extract_new_pitches(td.poll_documents(spark, sf), td.cursor_table(spark, sf), _now())
    return _ntz(new.select("event_id", "game_pk", "doc_id", "play_pos", "event_pos", "at_bat_index", "pitch_number",
                           "source_time", "event_time"))


ADVANCE_CTE = f"""adv AS (
  SELECT game_pk,
         arg_max(at_bat_index, (source_time, doc_id, 0, event_pos)) AS last_at_bat_index,
         arg_max(pitch_number, (source_time, doc_id, 0, event_pos)) AS last_pitch_number,
         {NOW_SQL} AS updated_at
  FROM mk WHERE NOT skip GROUP BY game_pk),
newcur AS (
  SELECT * FROM cur WHERE game_pk NOT IN (SELECT game_pk FROM adv)
  UNION ALL SELECT * FROM adv)"""

ADVANCE_ORDER = ("source_time", "doc_id", "play_pos", "event_pos")


def _new_cursors(spark, sf):
    kept = cursor.cursor_filter(pitches(spark, sf), td.cursor_table(spark, sf))
    adv = cursor.cursor_advance(kept, _now(), order=ADVANCE_ORDER)
    return cursor.apply_cursor(td.cursor_table(spark, sf), adv)


@register("cursor_advance", f"""
WITH {PITCHES_CTE}, {CURSOR_CTE}, {ADVANCE_CTE}
SELECT * FROM newcur""")
def q_cursor_advance(spark, sf):
    return _ntz(_new_cursors(spark, sf))


@register("cursor_staleness", f"""
WITH {PITCHES_CTE}, {CURSOR_CTE}, {ADVANCE_CTE}
SELECT game_pk, CAST(epoch_us({NOW_SQL}) - epoch_us(updated_at) AS DOUBLE) / 1e6 AS staleness_s
FROM newcur""")
def q_cursor_staleness(spark, sf):
    return cursor.cursor_staleness(_new_cursors(spark, sf), _now())
