"""Payload codec (P1-P7)."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from fixtures import NOW, docs_frame, feed
from gamelog.functions.enums import event_type_name, event_type_number, short_name, sport_name
from gamelog.functions.times import iso_utc, parse_upstream_time
from gamelog.operators import extract, payload


def _pitches(spark):
    return extract.extract_pitches(docs_frame(spark, feed()), F.lit(NOW))


def test_payload_shape(spark):
    p = _pitches(spark)
    d = json.loads(p.filter("pitch_number = 4").select(payload.pitch_payload(p).alias("j")).collect()[0].j)
    assert list(d)[:7] == ["event_id", "event_type", "sport", "game_pk", "event_time",
                           "source_time", "ingest_time"]
    assert d["event_type"] == "pitch" and d["sport"] == "mlb"
    assert d["event_time"] == "2025-04-02T17:06:05+00:00"
    assert d["raw_payload"]["pitchNumber"] == 4 and "raw_payload_json" not in d


def test_absent_optionals_omitted_and_zero_kept(spark):
    p = _pitches(spark).filter("at_bat_index = 11 AND pitch_number = 5")
    d = json.loads(p.select(payload.pitch_payload(p).alias("j")).collect()[0].j)
    assert "is_in_play" not in d and "spin_rate_rpm" not in d
    assert d["outs"] == 0 and d["at_bat_index"] == 11


def test_round_trip(spark):
    p = _pitches(spark)
    rows = payload.events_row(p)
    back = payload.payload_to_pitch(rows).orderBy("event_id").collect()
    orig = p.orderBy("event_id").collect()
    for a, b in zip(orig, back):
        for c in ("event_id", "event_type", "sport", "game_pk", "event_time", "source_time",
                  "ingest_time", "at_bat_index", "pitch_number", "inning", "inning_half",
                  "start_speed_mph", "is_strike", "outs", "call_code"):
            assert a[c] == b[c], c
        assert json.loads(b.raw_payload_json) == json.loads(a.raw_payload_json)


def test_unknown_and_null_keys_skipped(spark):
    df = spark.createDataFrame([('{"event_id": "x", "bogus": 1, "inning": null}',)], "payload string")
    r = payload.payload_to_pitch(df).collect()[0]
    assert r.event_id == "x" and r.inning is None and r.raw_payload_json is None


@pytest.mark.parametrize("raw, back", [("null", None), ("", None), (None, None), ("[1,null]", "[1,null]")])
def test_raw_null_comes_back_unset(spark, raw, back):
    p = _pitches(spark).limit(1).withColumn("raw_payload_json", F.lit(raw).cast("string"))
    assert payload.payload_to_pitch(payload.events_row(p)).collect()[0].raw_payload_json == back


def test_empty_raw_payload_is_json_null(spark):
    p = _pitches(spark).limit(1).withColumn("raw_payload_json", F.lit(""))
    d = json.loads(p.select(payload.pitch_payload(p).alias("j")).collect()[0].j)
    assert "raw_payload" in d and d["raw_payload"] is None


def test_iso_text(spark):
    df = spark.createDataFrame([(datetime(2024, 7, 15, 23, 5, 12, tzinfo=timezone.utc),),
                                (datetime(2024, 7, 15, 23, 5, 12, 120000, tzinfo=timezone.utc),)],
                               "t timestamp")
    got = [r.s for r in df.select(iso_utc("t").alias("s")).collect()]
    assert got == ["2024-07-15T23:05:12+00:00", "2024-07-15T23:05:12.120000+00:00"]


def test_time_parse(spark):
    df = spark.createDataFrame([("2024-07-15T23:05:12.000Z",), ("2024-07-15T23:05:12",),
                                ("20240715_230512",), ("",), (None,)], "s string")
    got = [r.t for r in df.select(parse_upstream_time("s").alias("t")).collect()]
    assert got[:3] == [datetime(2024, 7, 15, 23, 5, 12)] * 3 and got[3:] == [None, None]


def test_enum_names(spark):
    df = spark.createDataFrame([(1, 1), (10, 2), (0, 0), (99, 7)], "t int, s int")
    got = df.select(event_type_name("t").alias("a"), sport_name("s").alias("b"),
                    event_type_number(event_type_name("t")).alias("c")).collect()
    assert [(r.a, r.b, r.c) for r in got] == [("pitch", "mlb", 1), ("game_state", "nfl", 10),
                                              ("unspecified", "unspecified", 0), (None, None, None)]
    full = spark.createDataFrame([("SPORT_MLB",), ("EVENT_TYPE_PITCH",)], "n string")
    r = full.select(short_name("n", "Sport").alias("a"), short_name("n", "EventType").alias("b")).collect()
    assert r[0].a == "mlb" and r[1].b == "pitch"
