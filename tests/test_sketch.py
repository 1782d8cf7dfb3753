"""Quantile sketches, seen intervals and event-time windows: whatever the batches, the same answer."""

import math
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gamelog.operators import metrics
from gamelog.plans.table_queries import _SEEN, take_numbers
from gamelog.sources.keyed import KeyedTable
from gamelog.streaming import latency

T0 = datetime(2024, 7, 15)


@pytest.mark.parametrize("accuracy", [0.01, 0.05])
def test_quantiles_are_within_the_stated_error(spark, accuracy):
    rng = random.Random(3)
    values = {"wide": [rng.lognormvariate(0, 4) for _ in range(3000)], "signed": [rng.gauss(0, 5) for _ in range(2001)] + [0.0] * 50,
              "same": [7.25] * 400, "one": [1e-9], "large": [rng.random() * 1e15 for _ in range(100)]}
    rows = [(g, v) for g, vs in values.items() for v in vs] + [("wide", None), ("wide", float("nan")), ("wide", float("inf"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    halves = [metrics.quantile_sketch(df.filter(F.col("v").isNull() | (F.xxhash64("v") % 2 == b)), ["g"], "v", accuracy)
              for b in (-1, 0, 1)]
    merged = metrics.merge_sketches(halves, ["g"])
    whole = metrics.quantile_sketch(df, ["g"], "v", accuracy)
    assert merged.exceptAll(whole).count() == 0 and whole.exceptAll(merged).count() == 0
    got = {r.g: r for r in metrics.sketch_quantiles(merged, ["g"], accuracy=accuracy).collect()}
    for g, vs in values.items():
        vs = sorted(vs)
        assert got[g].n == len(vs)
        for p, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")):
            exact = vs[math.floor(p * (len(vs) - 1))]
            assert abs(got[g][name] - exact) <= accuracy * abs(exact) * (1 + 1e-9)


def test_gaps_whatever_the_order_of_arrival(spark, scratch):
    rng = random.Random(4)
    rows = [(g, a, n) for g in "xy" for a in (1, 2) for n in rng.sample(range(40), 25)] + [("z", 1, 5)]
    want = sorted(map(tuple, metrics.gap_audit(spark.createDataFrame(
        rows, "game_pk string, at_bat_index int, pitch_number int")).collect()))
    for turn in range(2):
        rng.shuffle(rows)
        table = KeyedTable(os.path.join(scratch, str(turn)), _SEEN, "at_bat", compact_after=1)
        for batch in range(3):
            part = rows[batch * 34:(batch + 1) * 34] + rows[:3]  # some come again
            part = spark.createDataFrame(part, "game_pk string, at_bat_index int, pitch_number int")
            take_numbers(table, part, batch)
            take_numbers(table, part, batch)  # done again
        assert sorted(map(tuple, metrics.gaps_of_intervals(table.read(spark)).collect())) == want


def test_a_late_number_closes_or_splits_a_gap(spark):
    kind = "array<struct<low:int,high:int>>"
    one = lambda *parts: spark.range(1).select(metrics.merge_intervals(*[
        F.lit(None).cast(kind) if p is None else F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")) for a, b in p])
        for p in parts]).alias("s")).first()["s"]
    assert [tuple(x) for x in one([(1, 2), (6, 9)], [(4, 4)])] == [(1, 2), (4, 4), (6, 9)]
    assert [tuple(x) for x in one([(1, 2), (6, 9)], [(3, 5)])] == [(1, 9)]
    assert [tuple(x) for x in one([(1, 9)], [(2, 3)], [(9, 12)])] == [(1, 12)]
    assert [tuple(x) for x in one(None, [(2, 3)])] == [(2, 3)]


def test_stream_equals_batch_and_late_rows_are_counted(spark, scratch):
    rows = [(T0 + timedelta(minutes=7 * i), "pitch" if i % 3 else "pickoff", float(i % 50)) for i in range(200)]
    late = [(T0 + timedelta(minutes=i), "pitch", 1.0) for i in range(5)]
    schema = "event_time timestamp, event_type string, latency_s double"
    land = os.path.join(scratch, "land")
    for i, part in enumerate((rows[:120], rows[120:], late + [(None, "pitch", 1.0)])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{land}/{i}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(land)
        latency.start_windows(stream, os.path.join(scratch, "t"), os.path.join(scratch, "ck"), "latency_s").awaitTermination()
    tables = latency.LatencyTables(os.path.join(scratch, "t"))
    on_time = spark.createDataFrame(rows, schema).select(F.window("event_time", "1 hour").start.alias("window_start"),
                                                         "event_type", "latency_s")
    want = metrics.quantile_sketch(on_time, latency.GROUP, "latency_s")
    got = tables.sketch.read(spark).select(*want.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert [(r.window_start, r.event_type, r.n) for r in tables.late.read(spark).collect()] == [(T0, "pitch", 5)]
    # the last batch done again counts nothing twice
    latency.window_batch(spark.createDataFrame(late, schema), 2, tables, "latency_s")
    assert [r.n for r in tables.late.read(spark).collect()] == [5]


def test_replayed_records_leave_contexts_alone(spark, scratch):
    from gamelog.sources import logs, tables as snapshots
    from gamelog.sources.schemas import CONTEXT
    from gamelog.streaming.enrich import write_enriched_batch
    p = spark.createDataFrame([("g", "mlb:g:pitch:1:1", "pitch", "mlb", T0, 1, 1, 3, 1)],
                              "game_pk string, event_id string, event_type string, sport string, event_time timestamp, "
                              "at_bat_index int, pitch_number int, inning int, outs int").select(
        "*", F.col("event_time").alias("source_time"), F.col("event_time").alias("ingest_time"))
    place = lambda df, at: df.select("*", F.lit(0).alias("partition"), F.lit(at).cast("long").alias("offset"),
                                     F.lit(T0).alias("timestamp"))
    live = place(logs.encode_pitches(p, "raw"), 5)
    again = place(logs.encode_pitches(p.withColumn("inning", F.lit(1)), "raw", source="replay"), 9)
    for batch, records in enumerate((live, again)):
        write_enriched_batch(records, batch, os.path.join(scratch, "e"), os.path.join(scratch, "c"))
    held = snapshots.read_snapshot(spark, os.path.join(scratch, "c"), CONTEXT).collect()
    assert [(r.game_pk, r.inning, r.outs) for r in held] == [("g", 3, 1)]
