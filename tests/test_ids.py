"""Id rules (K1-K13) and payload hashes."""

import hashlib
import json

from pyspark.sql import functions as F

from gamelog.functions import ids
from gamelog.functions.scan import ordered_scan


def _one(spark, col):
    return spark.range(1).select(col.alias("x")).collect()[0].x


def test_formats(spark):
    assert _one(spark, ids.event_id("pitch", F.lit(48213), F.lit(42), F.lit(3))) == "mlb:48213:pitch:42:3"
    assert _one(spark, ids.event_id("pitch", F.lit("48213"), F.lit(0), F.lit(0))) == "mlb:48213:pitch:0:0"
    assert _one(spark, ids.event_id("atbat_start", F.lit(100), F.lit(7))) == "mlb:100:ab_start:7"
    assert _one(spark, ids.event_id("atbat_end", F.lit(100), F.lit(7))) == "mlb:100:ab_end:7"
    assert _one(spark, ids.event_id("pickoff", F.lit(100), F.lit(7), F.lit(0))) == "mlb:100:pickoff:7:0"
    assert _one(spark, ids.event_id("mound_visit", F.lit(100), F.lit(7), F.lit(1))) == "mlb:100:mound_visit:7:1"
    assert _one(spark, ids.event_id("pitching_change", F.lit(100), F.lit(7), F.lit(543037))) == \
        "mlb:100:pitching_change:7:543037"
    assert _one(spark, ids.event_id("substitution", F.lit(100), F.lit(7), F.lit(1), F.lit(2))) == \
        "mlb:100:substitution:7:1:2"
    assert _one(spark, ids.event_id("defensive_shift", F.lit(100), F.lit(7), F.lit(3))) == \
        "mlb:100:defensive_shift:7:3"
    assert _one(spark, ids.event_id("inning_state", F.lit(100), F.lit(5), F.lit("top"), F.lit("start"))) == \
        "mlb:100:inning:5:top:start"
    assert _one(spark, ids.event_id("nfl_play", F.lit("2024_01_KC_BAL"), F.lit(42))) == "nfl:2024_01_KC_BAL:play:42"


def test_ids_unique_per_ordinal(spark):
    a = _one(spark, ids.event_id("pitch", F.lit(1), F.lit(5), F.lit(1)))
    b = _one(spark, ids.event_id("pitch", F.lit(1), F.lit(5), F.lit(2)))
    c = _one(spark, ids.event_id("pitch", F.lit(1), F.lit(6), F.lit(1)))
    d = _one(spark, ids.event_id("pitch", F.lit(2), F.lit(5), F.lit(1)))
    assert len({a, b, c, d}) == 4
    assert _one(spark, ids.event_id("atbat_start", F.lit(1), F.lit(7))) != _one(spark, ids.event_id("atbat_end", F.lit(1), F.lit(7)))


def _py_hash(payload):
    text = json.dumps(payload, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def test_struct_hash_is_key_order_free_and_matches_python(spark):
    h1 = _one(spark, ids.struct_payload_hash(a=F.lit(1), b=F.lit(2)))
    h2 = _one(spark, ids.struct_payload_hash(b=F.lit(2), a=F.lit(1)))
    assert h1 == h2 == _py_hash({"a": 1, "b": 2})
    assert _one(spark, ids.struct_payload_hash(a=F.lit(1), b=F.lit(3))) != h1
    assert _one(spark, ids.struct_payload_hash(s=F.lit("x"), n=F.lit(None).cast("int"))) == \
        _py_hash({"s": "x", "n": None})
    assert len(h1) == 16


def test_game_state_id(spark):
    h = ids.struct_payload_hash(status=F.lit("In Progress"))
    got = _one(spark, ids.event_id("game_state", F.lit(7), F.lit("status"), h))
    assert got == "mlb:7:game:status:" + _py_hash({"status": "In Progress"})


def test_json_text_hash_uses_python_forms(spark):
    texts = ['{"b": 1.0, "a": "é"}', '{"a":"é","b":1.0}', None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.h for r in df.select(ids.json_payload_hash("t").alias("h")).collect()]
    assert got[0] == got[1] == _py_hash({"a": "é", "b": 1.0}) and got[2] is None


def test_ordinals_within_at_bat(spark):
    rows = [("g", 1, pos) for pos in (5, 2, 9)] + [("g", 2, 1)]
    df = spark.createDataFrame(rows, "game_pk string, ab int, pos int")
    out = ordered_scan(df, ["game_pk", "ab"], ["pos"], F.col("pos"), ordinal="k")
    got = {(r.ab, r.pos): r.k for r in out.collect()}
    assert got == {(1, 2): 0, (1, 5): 1, (1, 9): 2, (2, 1): 0}
