"""Rolling context (N1-N5) in batch and streaming form, F7 cases and equivalence."""

import os

from pyspark.sql import functions as F

from gamelog.operators import enrich
from gamelog.sources import logs
from gamelog.sources import testdata as td
from gamelog.operators import validate
from gamelog.sources import tables
from gamelog.sources.schemas import CONTEXT
from gamelog.streaming.enrich import start_enrich

P = "game_pk string, partition int, offset long, event_id string, at_bat_index int, " \
    "pitch_number int, inning int, outs int, event_time timestamp, source_time timestamp, " \
    "ingest_time timestamp"
CTX = "game_pk string, home_score int, away_score int, runner_on_first boolean, " \
      "runner_on_second boolean, runner_on_third boolean, inning int, outs int"


def _p(spark, rows):
    return spark.createDataFrame([(g, 0, o, f"mlb:{g}:pitch:{o}:1", o, 1, inn, outs, None, None, None)
                                  for g, o, inn, outs in rows], P)


def _ctx(spark, rows, stored=None):
    return {(r.game_pk, r.offset): r for r in enrich.rolling_context(_p(spark, rows), stored).collect()}


def test_no_stored_state_starts_at_zero(spark):
    c = _ctx(spark, [("g", 0, None, None)])[("g", 0)]
    assert (c.ctx_inning, c.ctx_outs, c.ctx_home_score, c.ctx_runner_on_first, c.changed) == \
        (0, 0, 0, False, False)


def test_pitch_values_override_and_write(spark):
    stored = spark.createDataFrame([("g", 0, 0, False, False, False, 2, 0)], CTX)
    c = _ctx(spark, [("g", 0, 5, 2)], stored)[("g", 0)]
    assert (c.ctx_inning, c.ctx_outs, c.changed) == (5, 2, True)


def test_same_values_no_write(spark):
    stored = spark.createDataFrame([("g", 0, 0, False, False, False, 3, 1)], CTX)
    assert _ctx(spark, [("g", 0, 3, 1)], stored)[("g", 0)].changed is False


def test_scores_and_runners_carried(spark):
    stored = spark.createDataFrame([("g", 3, 1, True, False, True, 1, 0)], CTX)
    c = _ctx(spark, [("g", 0, 2, 1)], stored)[("g", 0)]
    assert (c.ctx_home_score, c.ctx_away_score, c.ctx_runner_on_first, c.ctx_runner_on_third) == \
        (3, 1, True, True)


def test_zero_outs_counts_and_absent_inning_keeps_last(spark):
    stored = spark.createDataFrame([("g", 0, 0, False, False, False, 4, 2)], CTX)
    c = _ctx(spark, [("g", 0, None, 0), ("g", 1, 6, None), ("g", 2, None, None)], stored)
    assert (c[("g", 0)].ctx_inning, c[("g", 0)].ctx_outs) == (4, 0)
    assert (c[("g", 1)].ctx_inning, c[("g", 1)].ctx_outs) == (6, 0)
    assert (c[("g", 2)].ctx_inning, c[("g", 2)].changed) == (6, False)


def test_chunks_carry_across_borders(spark):
    rows = [("g", o, (o if o % 7 == 0 else None), None) for o in range(50)]
    got = enrich.rolling_context(_p(spark, rows), None, chunk_rows=4).orderBy("offset").collect()
    expected = [o - o % 7 for o in range(50)]
    assert [r.ctx_inning for r in got] == expected


def test_snapshot_and_enriched(spark):
    stored = spark.createDataFrame([("g", 1, 0, False, False, False, 1, 0),
                                    ("old", 5, 5, True, True, True, 9, 2)], CTX)
    pitches = _p(spark, [("g", 0, 3, 1), ("g", 1, None, 2)])
    ctx = enrich.rolling_context(pitches, stored)
    snap = {r.game_pk: r for r in enrich.newest_context(pitches, stored).collect()}
    assert (snap["g"].inning, snap["g"].outs, snap["old"].inning) == (3, 2, 9)
    e = enrich.enriched_rows(ctx).orderBy("offset").collect()
    assert e[0].spine.event_id == "mlb:g:pitch:0:1" and e[0].spine.event_type == "pitch"
    assert e[0].spine.event_time is not None and e[0].pitch.event_id == "mlb:g:pitch:0:1"
    assert e[1].context_outs == 2 and e[1].home_score == 1


def _landed(spark, scratch, raw, parts):
    """``raw`` landed in ``parts`` files, in offset order, so that batches arrive in log order."""
    land = os.path.join(scratch, "raw")
    cuts = raw.approxQuantile("offset", [i / parts for i in range(parts + 1)], 0.0)
    cuts[-1] += 1
    for lo, hi in zip(cuts, cuts[1:]):
        raw.filter((F.col("offset") >= lo) & (F.col("offset") < hi)).coalesce(1).write.mode("append").parquet(land)
    return logs.read_log_stream(spark, land, max_files_per_trigger=1)


def _stream_and_batch(spark, scratch, raw, stored):
    paths = [os.path.join(scratch, n) for n in ("enriched", "ctx", "ck")]
    start_enrich(_landed(spark, scratch, raw, 3), *paths, stored).awaitTermination()
    acc = validate.validate(validate.enrichable(logs.decode_pitches(raw)))
    batch = enrich.enriched_log_records(enrich.enriched_rows(enrich.rolling_context(acc, stored)), "enriched",
                                        keep=enrich.ARRIVAL)
    streamed = spark.read.parquet(paths[0])
    assert streamed.select("batch_id").distinct().count() == 3
    assert streamed.count() == batch.count() > 0
    assert streamed.select(*batch.columns).exceptAll(batch).count() == 0
    snapshot = tables.read_snapshot(spark, paths[1], CONTEXT)
    newest = enrich.newest_context(acc, stored)
    assert snapshot.count() == newest.count() and snapshot.exceptAll(newest.select(*snapshot.columns)).count() == 0


def test_stream_equals_batch_on_every_field(spark, scratch):
    sf = "/root/testdata/sf0.001"
    _stream_and_batch(spark, scratch, td.raw_log(spark, sf), td.stored_context(spark, sf))


def test_stream_equals_batch_with_one_large_game(spark, scratch):
    raw = td.raw_log(spark, "/root/testdata/sf0.001").filter("value IS NOT NULL")
    text = F.col("value").cast("string")
    hot = F.regexp_replace(text, '"game_pk":"[0-9]+"', '"game_pk":"hot"').cast("binary")
    raw = raw.withColumn("value", F.when(F.xxhash64("offset") % 3 == 0, hot).otherwise(F.col("value")))
    raw = raw.withColumn("partition", F.lit(0))
    _stream_and_batch(spark, scratch, raw, None)


def test_context_lookup_defaults_and_state_for_game(spark):
    from gamelog.operators import serve
    stored = spark.createDataFrame([("g", 3, 1, True, False, True, 7, 2)], CTX)
    games = spark.createDataFrame([("g",), ("new",)], "game_pk string")
    got = {r.game_pk: r for r in enrich.context_lookup(stored, games).collect()}
    assert (got["g"].inning, got["g"].home_score, got["g"].runner_on_third) == (7, 3, True)
    assert (got["new"].inning, got["new"].outs, got["new"].runner_on_first) == (0, 0, False)
    assert serve.state_for_game(stored, "g").collect()[0].outs == 2
    assert serve.state_for_game(stored, "none").count() == 0
