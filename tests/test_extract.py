"""Feed and schedule extraction (E1-E3, S1-S5) on inline documents."""

import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from fixtures import (DELETE, GAME, NOW, PLAYS, POLLED, SPLITTER, STARTS, docs_frame, expected_pitches, feed, naive,
                      variant)
from gamelog.operators import extract


def _pitches(spark, *feeds):
    return extract.extract_pitches(docs_frame(spark, *feeds), F.lit(NOW)).orderBy(
        "doc_id", "play_pos", "event_pos").collect()


PLAY0 = "liveData__plays__allPlays__0__"
EVENT0 = PLAY0 + "playEvents__0__"
KEYS = [k for k, _, _ in expected_pitches()]


def test_pitches_in_feed_order(spark):
    rows = _pitches(spark, feed())
    assert [(r.event_id, r.play_pos, r.event_pos) for r in rows] == expected_pitches()


def test_fields_and_presence(spark):
    full, bare, *_, speed_only = _pitches(spark, feed())
    play, source = PLAYS[0], SPLITTER
    assert (full.event_type, full.sport, full.game_pk) == ("pitch", "mlb", str(GAME))
    assert full.event_time == naive(STARTS + timedelta(seconds=65))
    assert (full.source_time, full.ingest_time) == (naive(POLLED), naive(NOW))
    assert (full.pitch_type, full.pitch_type_description) == tuple(source["details"]["type"].values())
    assert (full.call_code, full.call_description) == tuple(source["details"]["call"].values())
    assert (full.start_speed_mph, full.end_speed_mph, full.spin_rate_rpm) == (88.25, 80.5, 1411.0)
    assert (full.is_in_play, full.is_strike, full.is_ball) == (False, True, False)
    assert (full.balls, full.strikes, full.outs) == (2, 1, 1)
    assert (full.batter_id, full.batter_name, full.pitcher_id) == (play["batter"], f"batter {play['batter']}", play["pitcher"])
    assert (full.inning, full.inning_half) == (play["inning"], "bottom")
    assert [bare[c] for c in ("is_in_play", "is_strike", "is_ball", "spin_rate_rpm", "end_speed_mph", "balls",
                              "pitch_type_description", "call_description")] == [None] * 8
    assert bare.outs == 0 and bare.pitch_type == "KN"
    assert speed_only.start_speed_mph == 61.0 and speed_only.outs is None and speed_only.inning_half == "top"


def test_raw_payload_keeps_unknown_keys(spark):
    raw = [json.loads(r.raw_payload_json) for r in _pitches(spark, feed())]
    assert raw[0]["venue"] == {"roof": "open"}
    events = feed()["liveData"]["plays"]["allPlays"]
    assert raw == [events[i]["playEvents"][j] for _, i, j in expected_pitches()]


@pytest.mark.parametrize("changes", [{"liveData__plays__allPlays": [], "metaData": DELETE},
                                     {"liveData__plays__allPlays": None}, {"liveData": DELETE}])
def test_feeds_without_plays_give_no_rows(spark, changes):
    assert _pitches(spark, variant(**changes)) == []


def test_pitch_number_falls_back_to_index_and_zero_is_valid(spark):
    first = _pitches(spark, variant(**{EVENT0 + "pitchNumber": DELETE}))[0]
    assert first.pitch_number == 0 and first.event_id.endswith(":pitch:11:0")


def test_event_without_pitch_number_or_index_is_skipped(spark):
    f = variant(**{EVENT0 + "pitchNumber": DELETE, EVENT0 + "index": DELETE})
    assert [r.event_id for r in _pitches(spark, f)] == KEYS[1:]


def test_times_fall_back_to_the_feed_and_then_to_now(spark):
    f = variant(**{EVENT0 + "startTime": DELETE})
    assert _pitches(spark, f)[0].event_time == naive(POLLED)
    f["metaData"] = {}
    first = _pitches(spark, f)[0]
    assert first.source_time == first.event_time == naive(NOW)


def test_compact_feed_time(spark):
    assert _pitches(spark, variant(metaData__timeStamp="20250402_183107"))[0].source_time == naive(POLLED)


def test_game_pk_zero_falls_through_to_game_data(spark):
    assert {r.game_pk for r in _pitches(spark, variant(gamePk=0, gameData__game__pk=905))} == {"905"}


def test_no_game_key_is_invalid(spark):
    rows = _pitches(spark, variant(gamePk=DELETE, gameData__game__pk=0))
    assert {(r.game_pk, r.valid) for r in rows} == {("", False)}


def test_empty_half_inning_is_null(spark):
    assert _pitches(spark, variant(**{PLAY0 + "about__halfInning": ""}))[0].inning_half is None


def test_no_generator_carries_the_document(spark):
    plan = extract.extract_pitches(docs_frame(spark, feed()), F.lit(NOW))._jdf.queryExecution().optimizedPlan().toString()
    generates = [line for line in plan.splitlines() if "Generate posexplode" in line]
    assert len(generates) == 2 and all("value#" not in g for g in generates)
    assert "allPlays" not in generates[0]


def test_game_state(spark):
    st = extract.extract_game_state(docs_frame(spark, feed()), F.lit(NOW)).collect()[0]
    assert st.event_id == f"mlb:{GAME}:game:state:2025-04-02T18:31:07+00:00"
    assert (st.status, st.home_score, st.away_score, st.inning, st.inning_half) == ("In Progress", 5, 0, 3, "top")
    assert st.event_time == naive(STARTS) and (st.home_team, st.away_team) == ("Harbor", "Summit")
    assert st.raw_payload_json is None and json.loads(st.payload) == feed()


def test_game_state_id_without_offset_and_now(spark):
    a, b = (extract.extract_game_state(docs_frame(spark, f), F.lit(NOW)).collect()[0].event_id for f in (
        variant(metaData__timeStamp="20250402_183107"), variant(metaData=DELETE)))
    assert a == f"mlb:{GAME}:game:state:2025-04-02T18:31:07"
    assert b == f"mlb:{GAME}:game:state:2024-07-16T00:00:00+00:00"


def _schedule(spark, games):
    doc = json.dumps({"dates": [{"games": games}]})
    return extract.schedule_games(spark.createDataFrame([(doc,)], "value string"))


@pytest.mark.parametrize("code,abstract,live", [
    ("I", None, True), ("IR", None, True), ("IH", None, True), ("IO", None, True), ("IP", None, True),
    ("S", "Live", True), ("F", "Final", False), (None, None, False)])
def test_live_predicate(spark, code, abstract, live):
    g = _schedule(spark, [{"gamePk": 1, "status": {"statusCode": code, "abstractGameState": abstract}}])
    assert extract.with_live_flag(g).collect()[0].live is live


def test_live_keys_counts_and_newly_live(spark):
    games = [{"gamePk": 1, "status": {"statusCode": "I"}},
             {"gamePk": 1, "status": {"statusCode": "I"}},
             {"status": {"statusCode": "I"}},
             {"gamePk": 2, "status": {"abstractGameState": "Live"}},
             {"gamePk": 3, "status": {"statusCode": "F"}},
             {"gamePk": 4}]
    g = _schedule(spark, games)
    keys = extract.live_game_keys(g)
    assert sorted(r.game_pk for r in keys.collect()) == ["1", "2"]
    c = extract.live_counts(g).collect()[0]
    assert (c.total_games, c.live_games) == (6, 4)
    tracked = spark.createDataFrame([("1",)], "game_pk string")
    assert [r.game_pk for r in extract.newly_live(keys, tracked).collect()] == ["2"]


def test_schedule_without_dates(spark):
    g = extract.schedule_games(spark.createDataFrame([("{}",)], "value string"))
    assert g.count() == 0


def test_new_pitches_are_those_after_the_cursor(spark):
    """Whatever the cursor, the same rows as filtering all pitches, from the new tail only."""
    from gamelog.operators import cursor
    docs = docs_frame(spark, feed(), variant(gamePk=7, gameData__game__pk=7), variant(gamePk=0, gameData__game__pk=0),
                      variant(gamePk=9, liveData__plays__allPlays=None))
    whole = extract.extract_pitches(docs, NOW).cache()
    for at, n in ((10, 9), (11, 3), (11, 4), (11, 5), (11, 6), (12, 0), (13, 1), (13, 2), (99, 0)):
        cursors = spark.createDataFrame([(str(GAME), at, n), ("77", 1, 1)],
                                        "game_pk string, last_at_bat_index int, last_pitch_number int")
        new = extract.extract_new_pitches(docs, cursors, NOW)
        want = cursor.cursor_filter(whole, cursors)
        assert new.columns == whole.columns
        assert sorted(map(str, new.select(*whole.columns).collect())) == sorted(map(str, want.select(*whole.columns).collect()))


def test_a_cumulative_feed_costs_its_new_tail(spark):
    """Rows that come out of the explode nodes: those behind the cursor, not the whole game."""
    play = lambda i: {"about": {"atBatIndex": i, "inning": 1, "halfInning": "top"}, "matchup": {},
                      "playEvents": [{"isPitch": True, "pitchNumber": k, "index": k} for k in range(1, 6)]}
    docs = docs_frame(spark, variant(liveData__plays__allPlays=[play(i) for i in range(400)]))
    cursors = spark.createDataFrame([(str(GAME), 398, 3)], "game_pk string, last_at_bat_index int, last_pitch_number int")
    new = extract.extract_new_pitches(docs, cursors, NOW)
    assert sorted((r.at_bat_index, r.pitch_number) for r in new.collect()) == [(398, 4), (398, 5)] + [(399, k) for k in range(1, 6)]
    plan, rows = new._jdf.queryExecution().executedPlan(), []

    def visit(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return visit(node.executedPlan())
        if node.nodeName() == "Generate":
            rows.append(node.metrics().apply("numOutputRows").value())
        inner = node.children()
        for i in range(inner.size()):
            visit(inner.apply(i))
        if node.nodeName().endswith("QueryStage"):
            visit(node.plan())

    visit(plan)
    # the document, its two plays left, their seven events (once as text, once parsed)
    assert rows and max(rows) == 7 and sum(rows) <= 1 + 2 + 7 + 7
