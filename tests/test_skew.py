"""Operators stay exact when one key holds a third of all rows."""

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from gamelog.operators import enrich, replay, serve, writes

T0 = datetime(2024, 7, 15, 0, 0)
N = 9000


def _events(spark):
    # game "hot" holds a third of the rows; ids unique; equal times to exercise tie order
    df = spark.range(N).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")).alias("game_pk"),
        F.col("id").cast("string").alias("event_id"),
        F.when(F.col("id") % 7 == 0, F.lit("atbat_end")).otherwise(F.lit("pitch")).alias("event_type"),
        F.lit("mlb").alias("sport"),
        (F.lit(T0) + F.make_dt_interval(secs=(F.col("id") / 4).cast("int"))).alias("event_time"))
    return df.select("*", F.col("event_time").alias("source_time"),
                     F.col("event_time").alias("ingest_time"), F.lit("{}").alias("payload"))


def test_latest_per_game_under_skew(spark):
    ev = _events(spark)
    games = ev.select("game_pk").distinct().select(
        "game_pk", F.lit("mlb").alias("sport"), F.lit("In Progress").alias("status"),
        F.lit("h").alias("home_team"), F.lit("a").alias("away_team"),
        F.lit(T0).alias("start_time"), F.lit(T0).alias("updated_at"), F.lit(None).cast("string").alias("payload"))
    got = {r.game_pk: r.event_id for r in serve.latest_pitch_per_active_game(ev, games).collect()}
    w = Window.partitionBy("game_pk").orderBy(F.col("event_time").desc(), F.col("event_id").desc())
    exp = {r.game_pk: r.event_id for r in
           ev.filter("event_type = 'pitch'").withColumn("r", F.row_number().over(w)).filter("r = 1").collect()}
    assert got == exp and "hot" in got


def test_replay_schedule_under_skew(spark):
    ev = _events(spark)
    out = replay.replay_schedule(ev, speed=4.0).filter("game_pk = 'hot'")
    w = Window.partitionBy("game_pk").orderBy("event_time", "event_id")
    ref = ev.filter("event_type = 'pitch' AND game_pk = 'hot'").select(
        "event_id", (F.row_number().over(w) - 1).cast("long").alias("seq"),
        ((F.unix_micros(F.col("event_time")) - F.unix_micros(F.lag("event_time").over(w))) / 1e6 / 4.0)
        .alias("wait_s"))
    assert out.select("event_id", "seq", "wait_s").exceptAll(ref).count() == 0
    assert out.count() == ref.count() > N // 4


def test_first_writer_under_hot_id(spark):
    rows = spark.range(N).select(
        F.when(F.col("id") % 3 == 0, F.lit("dup")).otherwise(F.col("id").cast("string")).alias("event_id"),
        (F.col("id") % 4).cast("int").alias("partition"), F.col("id").alias("offset"),
        F.col("id").cast("string").alias("payload"))
    new = writes.insert_if_new(rows, spark.createDataFrame([], "event_id string"))
    assert new.filter("event_id = 'dup'").collect()[0].payload == "0"
    assert new.count() == N - N // 3 + 1
    outcomes = writes.write_outcomes(rows, spark.createDataFrame([], "event_id string"))
    assert outcomes.filter("outcome = 'written'").count() == N - N // 3 + 1


def test_rolling_context_under_hot_game(spark):
    p = spark.range(N).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.lit("cold")).alias("game_pk"),
        F.lit(0).alias("partition"), F.col("id").alias("offset"),
        F.col("id").cast("string").alias("event_id"), F.lit(1).alias("at_bat_index"),
        F.lit(1).alias("pitch_number"),
        F.when(F.col("id") % 11 == 0, (F.col("id") % 9).cast("int")).alias("inning"),
        F.lit(None).cast("int").alias("outs"), F.lit(None).cast("timestamp").alias("event_time"),
        F.lit(None).cast("timestamp").alias("source_time"), F.lit(None).cast("timestamp").alias("ingest_time"))
    got = enrich.rolling_context(p, None, chunk_rows=500).select("game_pk", "offset", "ctx_inning")
    w = Window.partitionBy("game_pk").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    ref = p.select("game_pk", "offset",
                   F.coalesce(F.last("inning", True).over(w), F.lit(0)).alias("ctx_inning"))
    assert got.exceptAll(ref).count() == 0 and got.count() == N
