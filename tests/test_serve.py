"""Serving queries (Q1-Q6) on the F9 cases."""

from datetime import datetime

import pytest

from gamelog.operators import serve

EV = "event_id string, event_type string, sport string, game_pk string, event_time timestamp, " \
     "source_time timestamp, ingest_time timestamp, payload string"
GM = "game_pk string, sport string, status string, home_team string, away_team string, " \
     "start_time timestamp, updated_at timestamp, payload string"
T = datetime(2024, 7, 15, 22, 0)


def _t(m):
    return datetime(2024, 7, 15, 22, m)


def _events(spark):
    rows = [
        ("mlb:1:pitch:9:1", "pitch", "mlb", "1", _t(5), _t(5), _t(5), '{"n": 1}'),
        ("mlb:1:pitch:10:1", "pitch", "mlb", "1", _t(5), _t(5), _t(5), '{"n": 2}'),
        ("mlb:1:pitch:8:1", "pitch", "mlb", "1", _t(4), _t(4), _t(4), "{}"),
        ("mlb:1:ab_end:10", "atbat_end", "mlb", "1", _t(9), _t(9), _t(9), "{}"),
        ("nfl:1:play:1", "pitch", "nfl", "1", _t(9), _t(9), _t(9), "{}"),
        ("mlb:3:pitch:1:1", "pitch", "mlb", "3", _t(1), _t(1), _t(1), "{}"),
    ]
    return spark.createDataFrame(rows, EV)


def _games(spark):
    rows = [("1", "mlb", "In Progress", "H1", "A1", T, _t(1), None),
            ("2", "mlb", "Warmup", "H2", "A2", T, _t(2), None),
            ("3", "mlb", "Final", "H3", "A3", T, _t(3), None),
            ("4", "mlb", None, "H4", "A4", T, _t(4), None),
            ("5", "nfl", "In Progress", "H5", "A5", T, _t(5), None)]
    return spark.createDataFrame(rows, GM)


def test_latest_per_active_game(spark):
    rows = serve.latest_pitch_per_active_game(_events(spark), _games(spark)).collect()
    assert [r.game_pk for r in rows] == ["2", "1"]
    # equal event_time: text order puts "...:9:1" after "...:10:1"
    assert rows[1].event_id == "mlb:1:pitch:9:1"
    assert rows[0].event_id is None and rows[0].payload is None


def test_recent_pitches_order_and_limits(spark):
    ev = _events(spark)
    got = [r.event_id for r in serve.pitches_for_game(ev, "1", 500).collect()]
    assert got == ["mlb:1:pitch:9:1", "mlb:1:pitch:10:1", "mlb:1:pitch:8:1"]
    assert serve.pitches_for_game(ev, "1", 1).count() == 1
    assert serve.pitches_for_game(ev, "nope").count() == 0
    for bad in (0, 501):
        with pytest.raises(ValueError):
            serve.pitches_for_game(ev, "1", bad)


def test_events_for_game_all_types(spark):
    got = [r.event_id for r in serve.events_for_game(_events(spark), "1").collect()]
    assert got[0] == "mlb:1:ab_end:10" and len(got) == 4


def test_recent_per_game_matches_single_game(spark):
    ev = _events(spark)
    many = serve.recent_pitches_per_game(ev, 2).filter("game_pk = '1'").orderBy("rank").collect()
    assert [r.event_id for r in many] == [r.event_id for r in serve.pitches_for_game(ev, "1", 2).collect()]


def test_shape_rows(spark):
    rows = serve.shape_rows(serve.pitches_for_game(_events(spark), "1", 1)).collect()
    assert rows[0].event_time == "2024-07-15T22:05:00+00:00" and rows[0].payload == '{"n":1}'
