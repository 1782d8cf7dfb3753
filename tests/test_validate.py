"""Decode, spine validation, error classes and dead letters (V1-V6)."""

import base64
import json

from pyspark.sql import functions as F

from gamelog.operators import validate
from gamelog.sources import logs

SPINE = {"event_id": "mlb:1:pitch:0:1", "event_type": 1, "sport": 1, "game_pk": "1",
         "event_time": "2024-07-15T22:45:10Z", "source_time": "2024-07-15T23:05:12Z",
         "ingest_time": "2024-07-15T23:05:13Z"}


def _rec(spine=None, drop=(), raw=None, **fields):
    if raw is not None:
        return raw
    sp = dict(SPINE, **(spine or {}))
    for k in drop:
        sp.pop(k)
    return json.dumps({"spine": sp, "at_bat_index": 0, "pitch_number": 1, **fields})


def _log(spark, values):
    rows = [(b"1", None if v is None else v.encode(), "raw", 0, i) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "key binary, value binary, topic string, partition int, offset long") \
        .withColumn("timestamp", F.current_timestamp())


def _validated(spark, values):
    return validate.validate(logs.decode_pitches(_log(spark, values))).orderBy("offset").collect()


def test_valid_record(spark):
    r = _validated(spark, [_rec(inning=3)])[0]
    assert r.error_kind is None and r.event_type == "pitch" and r.sport == "mlb" and r.inning == 3


def test_first_failing_rule_wins(spark):
    values = [
        _rec({"event_id": ""}, game_pk=""),
        _rec({"event_type": 0, "sport": 0}),
        _rec({"sport": 0}),
        _rec({"game_pk": ""}, drop=("event_time",)),
        _rec(drop=("event_time", "source_time")),
        _rec(drop=("source_time",)),
        _rec(drop=("ingest_time",)),
    ]
    got = [r.error_message for r in _validated(spark, values)]
    prefix = "spine validation failed: spine."
    assert got == [prefix + "event_id is empty", prefix + "event_type is unspecified",
                   prefix + "sport is unspecified", prefix + "game_pk is empty",
                   prefix + "event_time is missing", prefix + "source_time is missing",
                   prefix + "ingest_time is missing"]


def test_undecodable_null_and_empty(spark):
    rows = _validated(spark, ["\x00\x01garbage", None, "", '{"spine": "not an object"}'])
    assert rows[0].error_kind == "decode" and rows[0].error_message.startswith("decode failed")
    assert rows[1].decoded and rows[1].error_message.endswith("event_id is empty")
    assert rows[2].decoded and rows[2].error_message.endswith("event_id is empty")
    assert rows[3].error_kind == "decode"
    assert {r.error_class for r in rows} == {"PoisonPillError"}


def test_unknown_enum_is_quarantined(spark):
    r = _validated(spark, [_rec({"event_type": 99})])[0]
    assert r.error_kind == "value" and "unknown_enum" in r.error_message and r.event_type is None


def test_classify_kind(spark):
    df = spark.createDataFrame([("decode",), ("value",), ("timeout",), (None,)], "k string")
    got = [r.c for r in df.select(validate.classify_kind(F.col("k")).alias("c")).collect()]
    assert got == ["PoisonPillError", "PoisonPillError", "TransientError", None]


def test_dead_letter_envelope(spark):
    v = validate.validate(logs.decode_pitches(_log(spark, ["bad {", None, _rec()])))
    letters = validate.dead_letters(validate.bad_records(v), F.lit("2024-07-16T00:00:00+00:00"))
    rows = letters.orderBy("source_offset").collect()
    assert len(rows) == 2
    assert base64.b64decode(rows[0].original_payload_b64) == b"bad {"
    assert rows[1].original_payload_b64 == ""
    assert (rows[0].source_topic, rows[0].source_partition, rows[0].attempts, rows[0].key) == \
        ("raw", 0, 1, bytearray(b"1"))
    env = json.loads(validate.envelope_json(letters).collect()[0].value)
    assert set(env) == {"original_payload_b64", "error_class", "error_message", "source_topic",
                        "source_partition", "source_offset", "first_seen_ts", "attempts"}


def test_enricher_drops_undecodable_and_empty_game(spark):
    d = logs.decode_pitches(_log(spark, ["bad {", _rec({"game_pk": ""}), _rec(drop=("event_time",))]))
    kept = validate.enrichable(d).collect()
    assert len(kept) == 1 and kept[0].event_time is None
