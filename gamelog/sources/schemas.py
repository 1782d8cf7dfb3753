"""Schemas of every frame the engine reads or writes.

Times are TimestampType (UTC session). Optional fields are nullable: absent is NULL, zero stays 0.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D, B, TS = (T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(),
                     T.BooleanType(), T.TimestampType())


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(f[0], f[1], f[2] if len(f) > 2 else True) for f in fields])


# ---- fixed values: enum numbers and short names of the wire contract ----
SPORTS = {0: "unspecified", 1: "mlb", 2: "nfl"}
EVENT_TYPES = {
    0: "unspecified",
    1: "pitch",
    2: "atbat_start",
    3: "atbat_end",
    4: "pickoff",
    5: "mound_visit",
    6: "pitching_change",
    7: "substitution",
    8: "defensive_shift",
    9: "inning_state",
    10: "game_state",
    11: "nfl_play",
}
# Statuses that end a game for the serving queries.
TERMINAL_STATUSES = ("Final", "Game Over", "Completed Early", "Postponed", "Cancelled")
# Schedule status codes of the "in progress" family.
LIVE_STATUS_CODES = ("I", "IR", "IH", "IO", "IP")
# Cumulative histogram bounds (seconds) for processing durations.
DURATION_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
# Recent-pitches result size: default and maximum.
RECENT_DEFAULT_LIMIT = 100
RECENT_MAX_LIMIT = 500
# Terminal outcome labels.
OUTCOME_WRITTEN, OUTCOME_DUPLICATE, OUTCOME_DLQ = "written", "duplicate", "dlq"
POISON, TRANSIENT = "PoisonPillError", "TransientError"
# Where a log record comes from.
LIVE, REPLAYED = "live", "replay"
# ---- end of fixed values ----

SPINE_FIELDS = ["event_id", "event_type", "sport", "game_pk", "event_time", "source_time",
                "ingest_time"]

SPINE = _struct(("event_id", S), ("event_type", S), ("sport", S), ("game_pk", S),
                ("event_time", TS), ("source_time", TS), ("ingest_time", TS))

PITCH_FIELDS = [
    ("at_bat_index", I), ("pitch_number", I), ("inning", I), ("inning_half", S),
    ("batter_id", L), ("batter_name", S), ("pitcher_id", L), ("pitcher_name", S),
    ("pitch_type", S), ("pitch_type_description", S), ("start_speed_mph", D),
    ("end_speed_mph", D), ("spin_rate_rpm", D), ("balls", I), ("strikes", I), ("outs", I),
    ("call_code", S), ("call_description", S), ("is_in_play", B), ("is_strike", B),
    ("is_ball", B), ("raw_payload_json", S),
]
PITCH_COLUMNS = [name for name, _ in PITCH_FIELDS]

# Flat pitch event: spine columns followed by the pitch columns.
PITCH = T.StructType(list(SPINE.fields) + [T.StructField(n, t, True) for n, t in PITCH_FIELDS])

GAME_STATE = T.StructType(list(SPINE.fields) + [
    T.StructField(n, t, True) for n, t in [
        ("status", S), ("home_team", S), ("away_team", S), ("home_score", I),
        ("away_score", I), ("inning", I), ("inning_half", S), ("raw_payload_json", S)]])

CONTEXT_FIELDS = ["home_score", "away_score", "runner_on_first", "runner_on_second",
                  "runner_on_third", "inning", "outs"]
CONTEXT = _struct(("game_pk", S), ("home_score", I), ("away_score", I),
                  ("runner_on_first", B), ("runner_on_second", B), ("runner_on_third", B),
                  ("inning", I), ("outs", I))
CONTEXT_DEFAULTS = {"home_score": 0, "away_score": 0, "runner_on_first": False,
                    "runner_on_second": False, "runner_on_third": False, "inning": 0, "outs": 0}

ENRICHED = _struct(("spine", SPINE), ("pitch", PITCH), ("home_score", I), ("away_score", I),
                   ("runner_on_first", B), ("runner_on_second", B), ("runner_on_third", B))

CURSOR = _struct(("game_pk", S), ("last_at_bat_index", I), ("last_pitch_number", I),
                 ("updated_at", TS))

DEAD_LETTER = _struct(("original_payload_b64", S), ("error_class", S), ("error_message", S),
                      ("source_topic", S), ("source_partition", I), ("source_offset", L),
                      ("first_seen_ts", S), ("attempts", I))

# Log record in the shape of a Kafka source row.
LOG_RECORD = _struct(("key", T.BinaryType()), ("value", T.BinaryType()), ("topic", S),
                     ("partition", I), ("offset", L), ("timestamp", TS))

EVENTS_TABLE = _struct(("event_id", S, False), ("event_type", S, False), ("sport", S, False),
                       ("game_pk", S, False), ("event_time", TS, False),
                       ("source_time", TS, False), ("ingest_time", TS, False),
                       ("payload", S, False))

GAMES_TABLE = _struct(("game_pk", S, False), ("sport", S, False), ("status", S),
                      ("home_team", S), ("away_team", S), ("start_time", TS),
                      ("updated_at", TS, False), ("payload", S))

_SCHEDULE_GAME = _struct(("gamePk", L),
                         ("status", _struct(("statusCode", S), ("abstractGameState", S))))
SCHEDULE = _struct(("dates", T.ArrayType(_struct(("games", T.ArrayType(_SCHEDULE_GAME))))))

PLAY_EVENT = _struct(
    ("isPitch", B), ("pitchNumber", I), ("index", I), ("startTime", S),
    ("details", _struct(("type", _struct(("code", S), ("description", S))),
                        ("call", _struct(("code", S), ("description", S))),
                        ("isInPlay", B), ("isStrike", B), ("isBall", B))),
    ("count", _struct(("balls", I), ("strikes", I), ("outs", I))),
    ("pitchData", _struct(("startSpeed", D), ("endSpeed", D),
                          ("breaks", _struct(("spinRate", D))))))

_PLAY = _struct(
    ("about", _struct(("atBatIndex", I), ("inning", I), ("halfInning", S))),
    ("matchup", _struct(("batter", _struct(("id", L), ("fullName", S))),
                        ("pitcher", _struct(("id", L), ("fullName", S))))),
    ("playEvents", T.ArrayType(S)))  # each event as its own JSON text, parsed as PLAY_EVENT

_FEED_HEAD = [
    ("gamePk", L),
    ("metaData", _struct(("timeStamp", S))),
    ("gameData", _struct(("game", _struct(("pk", L))),
                         ("status", _struct(("detailedState", S))),
                         ("teams", _struct(("home", _struct(("name", S))),
                                           ("away", _struct(("name", S))))),
                         ("datetime", _struct(("dateTime", S))))),
]
_LINESCORE = ("linescore", _struct(("currentInning", I), ("inningHalf", S),
                                   ("teams", _struct(("home", _struct(("runs", I))),
                                                     ("away", _struct(("runs", I)))))))

# Typed view of a live feed.
FEED = _struct(*_FEED_HEAD, ("liveData", _struct(
    _LINESCORE, ("plays", _struct(("allPlays", T.ArrayType(_PLAY)))))))
