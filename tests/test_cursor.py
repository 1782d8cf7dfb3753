"""Publish cursor (C1-C5): boundaries around cursor (8, 2)."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gamelog.operators import cursor

PAIRS = [(7, 12), (8, 1), (8, 2), (8, 5), (9, 0), (30, 1)]


def _pitches(spark, game="g", pairs=PAIRS):
    rows = [(game, ab, n, 0, i) for i, (ab, n) in enumerate(pairs)]
    return spark.createDataFrame(rows, "game_pk string, at_bat_index int, pitch_number int, "
                                       "play_pos int, event_pos int")


def _cursors(spark):
    return spark.createDataFrame([("g", 8, 2, datetime(2024, 1, 1))],
                                 "game_pk string, last_at_bat_index int, last_pitch_number int, "
                                 "updated_at timestamp")


def test_filter_boundaries(spark):
    kept = cursor.cursor_filter(_pitches(spark), _cursors(spark))
    assert sorted((r.at_bat_index, r.pitch_number) for r in kept.collect()) == [(8, 5), (9, 0), (30, 1)]


def test_no_cursor_keeps_all(spark):
    kept = cursor.cursor_filter(_pitches(spark, game="other"), _cursors(spark))
    assert kept.count() == len(PAIRS)


def test_counts(spark):
    c = cursor.cursor_counts(cursor.mark_published(_pitches(spark), _cursors(spark))).collect()[0]
    assert (c.published, c.skipped) == (3, 3)


@pytest.mark.parametrize("mode,expected", [("feed_order", (9, 0)), ("max", (30, 1))])
def test_advance_modes(spark, mode, expected):
    # feed order: (30, 1) arrives before (9, 0)
    pub = _pitches(spark, pairs=[(8, 5), (30, 1), (9, 0)])
    adv = cursor.cursor_advance(pub, F.lit(datetime(2024, 7, 16)), mode=mode).collect()[0]
    assert (adv.last_at_bat_index, adv.last_pitch_number) == expected


def test_apply_cursor_and_staleness(spark):
    adv = cursor.cursor_advance(_pitches(spark, game="h", pairs=[(1, 1)]),
                                F.lit(datetime(2024, 1, 1, 0, 0, 30)))
    new = cursor.apply_cursor(_cursors(spark), adv)
    assert sorted(r.game_pk for r in new.collect()) == ["g", "h"]
    st = {r.game_pk: r.staleness_s for r in
          cursor.cursor_staleness(new, F.lit(datetime(2024, 1, 1, 0, 1, 0))).collect()}
    assert st == {"g": 60.0, "h": 30.0}


def test_delete_cursor(spark):
    from gamelog.operators.writes import delete_keys
    gone = spark.createDataFrame([("g",)], "game_pk string")
    assert delete_keys(_cursors(spark), gone, "game_pk").count() == 0
