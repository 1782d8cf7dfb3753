"""Replay ordering and pacing (R1-R3, F10)."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gamelog.operators import replay

EV = "event_id string, event_type string, sport string, game_pk string, event_time timestamp, payload string"
T0 = datetime(2024, 7, 15, 22, 0)


def _events(spark, offsets, game="1"):
    rows = [(f"mlb:{game}:pitch:{i}:1", "pitch", "mlb", game, T0 + timedelta(seconds=s), "{}")
            for i, s in enumerate(offsets)]
    return spark.createDataFrame(rows, EV)


def test_waits_are_gaps_over_speed(spark):
    out = replay.replay_schedule(_events(spark, [0, 6, 7, 31]), speed=4).orderBy("seq").collect()
    assert [r.wait_s for r in out] == [None, 1.5, 0.25, 6.0]
    assert [r.release_offset_s for r in out] == [0.0, 1.5, 1.75, 7.75]
    assert out[-1].seq == 3


def test_equal_times_wait_zero(spark):
    out = replay.replay_schedule(_events(spark, [0, 0]), speed=1).orderBy("seq").collect()
    assert out[1].wait_s == 0.0


def test_empty(spark):
    assert replay.replay_schedule(_events(spark, [0]).limit(0), speed=1).count() == 0


@pytest.mark.parametrize("speed", [0, -1])
def test_speed_must_be_positive(spark, speed):
    with pytest.raises(ValueError, match="speed must be > 0"):
        replay.replay_schedule(_events(spark, [0]), speed=speed)


def test_bounds_inclusive_and_no_sport_filter(spark):
    ev = _events(spark, [0, 10, 20, 30]).withColumn("sport", F.lit("nfl"))
    got = replay.replay_sequence(ev, game_pk="1", since=T0 + timedelta(seconds=10),
                                 until=T0 + timedelta(seconds=20)).orderBy("seq").collect()
    assert [r.event_id for r in got] == ["mlb:1:pitch:1:1", "mlb:1:pitch:2:1"]
    assert [r.seq for r in got] == [0, 1]


def test_republish_round_trip(spark):
    from gamelog.operators import payload, validate
    from gamelog.sources import logs
    pitches = spark.createDataFrame(
        [("mlb:1:pitch:0:1", "pitch", "mlb", "1", T0, T0, T0, 0, 1, 3),
         ("mlb:1:pitch:0:2", "pitch", "mlb", "1", T0 + timedelta(seconds=5), T0, T0, 0, 2, None)],
        "event_id string, event_type string, sport string, game_pk string, event_time timestamp, "
        "source_time timestamp, ingest_time timestamp, at_bat_index int, pitch_number int, inning int")
    events = payload.events_row(pitches)
    recs = replay.republish(events, "raw", game_pk="1")
    assert recs.count() == 2
    log = recs.withColumn("timestamp", F.current_timestamp())
    back = validate.validate(logs.decode_pitches(log)).orderBy("offset").collect()
    assert [r.event_id for r in back] == ["mlb:1:pitch:0:1", "mlb:1:pitch:0:2"]
    assert back[0].error_kind is None and back[0].inning == 3 and back[1].inning is None
    assert back[1].event_time == T0 + timedelta(seconds=5)


def test_written_replay_keeps_each_games_order(spark, scratch):
    from gamelog.operators.payload import events_row
    from gamelog.sources import logs
    rows = [(f"mlb:{g}:pitch:{i}:1", "pitch", "mlb", str(g), T0 + timedelta(seconds=97 * i % 50), T0, T0, i, 1)
            for g in range(3) for i in range(40)]
    p = spark.createDataFrame(rows, "event_id string, event_type string, sport string, game_pk string, "
                                    "event_time timestamp, source_time timestamp, ingest_time timestamp, "
                                    "at_bat_index int, pitch_number int")
    events = events_row(p).repartition(7)
    logs.write_log(replay.republish(events, "raw"), scratch + "/log")
    back = spark.read.parquet(scratch + "/log").withColumn("timestamp", F.current_timestamp())
    got = logs.decode_pitches(back).orderBy("partition", "offset").collect()
    for g in range(3):
        mine = [(r.event_time, r.event_id) for r in got if r.game_pk == str(g)]
        assert mine == sorted(mine) and len(mine) == 40
    one = replay.ordered_history(events, game_pk="1").collect()
    assert [(r.event_time, r.event_id) for r in one] == sorted((r.event_time, r.event_id) for r in one)
