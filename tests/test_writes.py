"""Insert-if-new (first writer wins), outcomes and the games upsert (W1-W4)."""

from datetime import datetime

from pyspark.sql import functions as F

from gamelog.operators import writes

T0 = datetime(2024, 7, 15, 22, 0)


def _batch(spark, rows):
    return spark.createDataFrame(rows, "event_id string, partition int, offset long, payload string")


def test_first_writer_wins_and_known_ids_skipped(spark):
    batch = _batch(spark, [("a", 0, 5, "late"), ("a", 0, 2, "first"), ("b", 1, 1, "b1"),
                           ("c", 1, 2, "c1")])
    table = spark.createDataFrame([("c",)], "event_id string")
    new = {r.event_id: r.payload for r in writes.insert_if_new(batch, table).collect()}
    assert new == {"a": "first", "b": "b1"}


def test_outcomes(spark):
    batch = _batch(spark, [("a", 0, 5, "x"), ("a", 0, 2, "y"), ("c", 1, 2, "z")])
    table = spark.createDataFrame([("c",)], "event_id string")
    got = {(r.event_id, r.offset): r.outcome for r in writes.write_outcomes(batch, table).collect()}
    assert got == {("a", 2): "written", ("a", 5): "duplicate", ("c", 2): "duplicate"}


def test_hot_key_copies_reduce(spark):
    rows = [("hot", p % 4, i, str(i)) for i, p in enumerate(range(3000))] + [("cold", 0, 1, "c")]
    batch = _batch(spark, rows)
    new = {r.event_id: r.payload for r in
           writes.insert_if_new(batch, spark.createDataFrame([], "event_id string")).collect()}
    assert new == {"hot": "0", "cold": "c"}


GAMES = "game_pk string, sport string, status string, home_team string, away_team string, " \
        "start_time timestamp, updated_at timestamp, payload string"
STATES = "game_pk string, sport string, status string, home_team string, away_team string, " \
         "event_time timestamp, source_time timestamp, event_id string, payload string"


def test_upsert_games(spark):
    existing = spark.createDataFrame(
        [("1", "mlb", "Warmup", "H", "A", T0, T0, "{}"), ("2", "mlb", "Final", "H2", "A2", T0, T0, None)],
        GAMES)
    states = spark.createDataFrame(
        [("1", "nfl", "In Progress", "", "A", T0, datetime(2024, 7, 15, 23), "s1", "doc1"),
         ("1", "nfl", "Final", "H", "A", T0, datetime(2024, 7, 15, 23, 30), "s2", "doc2"),
         ("3", "mlb", "Warmup", "H3", None, T0, datetime(2024, 7, 15, 23), "s3", "doc3")], STATES)
    now = datetime(2024, 7, 16)
    out = {r.game_pk: r for r in writes.upsert_games(existing, states, F.lit(now)).collect()}
    assert out["1"].status == "Final" and out["1"].sport == "mlb" and out["1"].updated_at == now
    assert out["1"].payload == "doc2" and out["3"].payload == "doc3"
    assert out["2"].status == "Final" and out["2"].updated_at == T0 and out["2"].home_team == "H2"
    assert out["3"].sport == "mlb" and out["3"].away_team is None


def test_upsert_blank_text_becomes_null(spark):
    existing = spark.createDataFrame([], GAMES)
    states = spark.createDataFrame([("9", "mlb", "", "", "", T0, T0, "e", None)], STATES)
    r = writes.upsert_games(existing, states, F.lit(datetime(2024, 7, 16))).collect()[0]
    assert (r.status, r.home_team, r.away_team) == (None, None, None)
