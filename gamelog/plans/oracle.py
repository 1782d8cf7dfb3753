"""SQL restatement of the test-table adapters, for the DuckDB oracle.

Each ``*_CTE`` mirrors one function of ``gamelog.sources.testdata`` row by row; the oracle
queries start ``WITH`` these and then state the operator's semantics in plain SQL.
"""

from __future__ import annotations

from gamelog.sources.schemas import TERMINAL_STATUSES
from gamelog.sources.testdata import _raw_text_sql

TERMINAL_SQL = ", ".join(f"'{s}'" for s in TERMINAL_STATUSES)

EV_CTE = """ev AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id,
         CASE WHEN event_type = 'purchase' THEN 'pitch' ELSE event_type END AS event_type,
         'mlb' AS sport,
         CAST(user_id AS VARCHAR) AS game_pk,
         ts AS event_time,
         ts + to_seconds(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS source_time,
         ts + to_seconds(CAST(json_extract_string(props, '$.k') AS INTEGER))
            + to_milliseconds(CAST(floor(value * 1000) AS BIGINT)) AS ingest_time,
         props AS payload
  FROM events)"""

GM_CTE = """gm AS (
  SELECT CAST(c_custkey AS VARCHAR) AS game_pk,
         CASE WHEN c_nationkey = 0 THEN 'nfl' ELSE 'mlb' END AS sport,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'In Progress' WHEN 'MACHINERY' THEN 'Warmup'
              WHEN 'FURNITURE' THEN 'Final' WHEN 'AUTOMOBILE' THEN 'Postponed' END AS status,
         c_name AS home_team,
         'Nation ' || CAST(c_nationkey AS VARCHAR) AS away_team,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(c_custkey) AS start_time,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(c_custkey) AS updated_at,
         CAST(NULL AS VARCHAR) AS payload
  FROM customer)"""

# Newest pitch of each open game: the greatest (time, id) of the game's pitches, beside every game
# of the sport whose status is known and not terminal.
NEWEST_CTE = f"""newest AS (
  SELECT gm.game_pk, any_value(home_team) AS home_team, any_value(away_team) AS away_team,
         any_value(status) AS status,
         max({{'t': event_time, 'i': event_id, 's': source_time, 'n': ingest_time, 'p': ev.payload}})
           FILTER (event_type = 'pitch' AND ev.sport = 'mlb') AS pitch
  FROM gm LEFT JOIN ev USING (game_pk)
  WHERE gm.sport = 'mlb' AND coalesce(status NOT IN ({TERMINAL_SQL}), FALSE)
  GROUP BY gm.game_pk)"""

# Raw log fields of one lineitem row (before wire encoding), with the log position.
RAW_CTE = """rf AS (
  SELECT *,
         CAST(l_orderkey % 4 AS INTEGER) AS partition,
         CAST(l_orderkey AS VARCHAR) AS r_game_pk,
         l_linenumber AS r_at_bat_index,
         CAST(floor(l_quantity / 10) AS INTEGER) AS r_pitch_number,
         CASE WHEN l_linestatus <> 'O' THEN CAST(floor(l_quantity / 10) AS INTEGER) + 1 END AS r_inning,
         CASE WHEN l_returnflag <> 'N' THEN CAST(floor((l_linenumber + 1) / 3) AS INTEGER) END AS r_outs,
         l_shipdate AS r_event_time,
         l_shipdate + INTERVAL 1 HOUR AS r_source_time,
         l_shipdate + INTERVAL 1 HOUR + to_seconds(l_linenumber) AS r_ingest_time,
         CAST(l_quantity AS INTEGER) AS defect,
         l_orderkey * 268435456 + CAST('0x' || substr(md5(concat_ws('|', l_partkey, l_suppkey, l_linenumber,
             CAST(round(l_extendedprice * 100) AS BIGINT), CAST(epoch(l_shipdate) AS BIGINT))), 1, 7) AS BIGINT)
           AS "offset"
  FROM lineitem)"""

from gamelog.sources.schemas import EVENT_TYPES, SPORTS  # noqa: E402


def _name_case(col: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN {k} THEN '{v}'" for k, v in mapping.items())
    return f"CASE {col} {whens} END"


def _num_case(col: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN '{v}' THEN {k}" for k, v in mapping.items())
    return f"CASE {col} {whens} END"


EVENT_TYPE_NAME_SQL = _name_case("event_type_number", EVENT_TYPES)
SPORT_NAME_SQL = _name_case("sport_number", SPORTS)
EVENT_TYPE_NUMBER_SQL = _num_case("event_type", EVENT_TYPES)

_ISO_Z = "strftime({c}, '%Y-%m-%dT%H:%M:%SZ')"

# Wire text of a raw record (mirrors testdata._wire_value).
WIRE_TEXT_SQL = """CASE WHEN defect = 8 THEN 'not json {' WHEN defect = 9 THEN NULL ELSE
  '{"spine":{"event_id":"' || CASE WHEN defect = 1 THEN '' ELSE 'mlb:' || r_game_pk || ':pitch:'
      || CAST(r_at_bat_index AS VARCHAR) || ':' || CAST(r_pitch_number AS VARCHAR) END || '"'
  || ',"event_type":' || CASE WHEN defect = 2 THEN '0' WHEN defect = 10 THEN '99' ELSE '1' END
  || ',"sport":' || CASE WHEN defect = 3 THEN '0' ELSE '1' END
  || ',"game_pk":"' || CASE WHEN defect = 4 THEN '' ELSE r_game_pk END || '"'
  || CASE WHEN defect <> 5 THEN ',"event_time":"' || """ + _ISO_Z.format(c="r_event_time") + """ || '"' ELSE '' END
  || CASE WHEN defect <> 6 THEN ',"source_time":"' || """ + _ISO_Z.format(c="r_source_time") + """ || '"' ELSE '' END
  || CASE WHEN defect <> 7 THEN ',"ingest_time":"' || """ + _ISO_Z.format(c="r_ingest_time") + """ || '"' ELSE '' END
  || '}'
  || ',"at_bat_index":' || CAST(r_at_bat_index AS VARCHAR)
  || ',"pitch_number":' || CAST(r_pitch_number AS VARCHAR)
  || coalesce(',"inning":' || CAST(r_inning AS VARCHAR), '')
  || coalesce(',"outs":' || CAST(r_outs AS VARCHAR), '')
  || ',"pitch_type":"' || l_returnflag || l_linestatus || '"'
  || ',"start_speed_mph":' || CAST(CAST(l_quantity AS INTEGER) + 60 AS VARCHAR)
  || coalesce(',"raw_payload_json":"' || """ + _raw_text_sql() + """ || '"', '')
  || '}' END"""

# Decoded and validated raw records (mirrors logs.decode_pitches + validate.validate).
VAL_CTE = f"""val AS (
  SELECT defect, partition, "offset", 'raw' AS topic, r_game_pk AS key_text, {WIRE_TEXT_SQL} AS value_text,
    defect <> 8 AS decoded,
    CASE WHEN defect IN (8, 9) THEN NULL WHEN defect = 1 THEN ''
         ELSE 'mlb:' || r_game_pk || ':pitch:' || CAST(r_at_bat_index AS VARCHAR) || ':'
              || CAST(r_pitch_number AS VARCHAR) END AS event_id,
    CASE WHEN defect IN (2, 8, 9) THEN 0 WHEN defect = 10 THEN 99 ELSE 1 END AS event_type_number,
    CASE WHEN defect IN (3, 8, 9) THEN 0 ELSE 1 END AS sport_number,
    CASE WHEN defect IN (8, 9) THEN NULL WHEN defect = 4 THEN '' ELSE r_game_pk END AS game_pk,
    CASE WHEN defect IN (5, 8, 9) THEN NULL ELSE r_event_time END AS event_time,
    CASE WHEN defect IN (6, 8, 9) THEN NULL ELSE r_source_time END AS source_time,
    CASE WHEN defect IN (7, 8, 9) THEN NULL ELSE r_ingest_time END AS ingest_time,
    CASE WHEN defect IN (8, 9) THEN NULL ELSE r_at_bat_index END AS at_bat_index,
    CASE WHEN defect IN (8, 9) THEN NULL ELSE r_pitch_number END AS pitch_number,
    CASE WHEN defect IN (8, 9) THEN NULL ELSE r_inning END AS inning,
    CASE WHEN defect IN (8, 9) THEN NULL ELSE r_outs END AS outs,
    CASE WHEN defect IN (8, 9) THEN NULL ELSE l_returnflag || l_linestatus END AS pitch_type,
    CASE WHEN defect IN (8, 9) THEN NULL ELSE CAST(CAST(l_quantity AS INTEGER) + 60 AS DOUBLE) END
      AS start_speed_mph
  FROM rf),
cls AS (
  SELECT *, {EVENT_TYPE_NAME_SQL} AS event_type, {SPORT_NAME_SQL} AS sport,
    CASE WHEN NOT decoded THEN 'decode'
         WHEN coalesce(event_id, '') = '' OR event_type_number = 0 OR sport_number = 0
           OR coalesce(game_pk, '') = '' OR event_time IS NULL OR source_time IS NULL
           OR ingest_time IS NULL OR defect = 13 THEN 'value'
         WHEN ({EVENT_TYPE_NAME_SQL}) IS NULL OR ({SPORT_NAME_SQL}) IS NULL THEN 'value' END
      AS error_kind,
    CASE WHEN NOT decoded THEN 'decode failed: malformed record'
         WHEN coalesce(event_id, '') = '' THEN 'spine validation failed: spine.event_id is empty'
         WHEN event_type_number = 0 THEN 'spine validation failed: spine.event_type is unspecified'
         WHEN sport_number = 0 THEN 'spine validation failed: spine.sport is unspecified'
         WHEN coalesce(game_pk, '') = '' THEN 'spine validation failed: spine.game_pk is empty'
         WHEN event_time IS NULL THEN 'spine validation failed: spine.event_time is missing'
         WHEN source_time IS NULL THEN 'spine validation failed: spine.source_time is missing'
         WHEN ingest_time IS NULL THEN 'spine validation failed: spine.ingest_time is missing'
         WHEN ({EVENT_TYPE_NAME_SQL}) IS NULL OR ({SPORT_NAME_SQL}) IS NULL
           THEN 'write-path poison pill: unknown_enum event_type=' || CAST(event_type_number AS VARCHAR)
                || ' sport=' || CAST(sport_number AS VARCHAR)
         WHEN defect = 13 THEN 'write-path poison pill: raw_payload_json is not valid JSON' END AS error_message
  FROM val),
cl AS (
  SELECT *, CASE WHEN error_kind IS NULL THEN NULL
                 WHEN error_kind IN ('decode', 'value') THEN 'PoisonPillError'
                 ELSE 'TransientError' END AS error_class
  FROM cls),
good AS (SELECT * FROM cl WHERE error_kind IS NULL)"""

LOG_CTES = f"{RAW_CTE}, {VAL_CTE}"

# Feed documents flattened to one row per lineitem (mirrors testdata.feed_documents).
FEED_CTE = """li AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_orderkey, l_partkey, l_suppkey,
      l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
      l_shipdate) - 1 AS li_pos
  FROM lineitem),
fl AS (
  SELECT li.*, o.*,
    CAST(o_orderkey AS VARCHAR) || '/' || CAST(CAST(floor(li_pos / 64) AS BIGINT) AS VARCHAR) AS doc_id,
    CAST(li_pos % 64 AS INTEGER) AS event_pos,
    CASE WHEN o_custkey <> 0 THEN CAST(o_custkey AS VARCHAR) ELSE '' END AS game_pk,
    CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderdate END AS meta_ts,
    CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F'
         THEN CASE WHEN l_quantity > 45 THEN NULL ELSE l_linenumber - 1 END
         ELSE l_linenumber END AS pn
  FROM li JOIN orders o ON li.l_orderkey = o.o_orderkey),
docs AS (SELECT DISTINCT doc_id, o_orderkey, o_custkey, o_orderstatus, o_orderpriority,
                o_orderdate, o_totalprice, game_pk, meta_ts,
                CAST(floor(li_pos / 64) AS INTEGER) AS chunk
         FROM fl)"""
