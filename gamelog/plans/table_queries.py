"""Queries through the tables that batches write: keyed tables with changes, the index of stored ids.

Each works through the given tables in three batches, as a stream would, and reads the result back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gamelog.functions.cols import seconds_between
from gamelog.functions.times import to_ntz
from gamelog.operators import metrics, writes
from gamelog.plans.log_queries import EXISTING_CTE, good
from gamelog.plans.oracle import EV_CTE, LOG_CTES
from gamelog.plans.registry import register_batches
from gamelog.session import scratch_table
from gamelog.sources import tables
from gamelog.sources import testdata as td
from gamelog.sources.keyed import KeyedTable, changed_rows
from gamelog.sources.membership import IdIndex
from gamelog.streaming import latency

# ---- fixed values: query parameters ----
BATCHES = 3
ENDS = "error"  # an event that takes its game out of the table
# ---- end of fixed values ----

_NEWEST = T.StructType([T.StructField("game_pk", T.StringType()), T.StructField("event_id", T.StringType()),
                        T.StructField("event_type", T.StringType()), T.StructField("event_time", T.TimestampNTZType())])


@register_batches("keyed_table_merge", f"""
WITH {EV_CTE},
b AS (SELECT DISTINCT ON (game_pk, batch) game_pk, event_id, event_type, event_time, batch
      FROM (SELECT *, CAST(event_id AS BIGINT) % {BATCHES} AS batch FROM ev)
      ORDER BY game_pk, batch, event_time DESC, event_id DESC)
SELECT game_pk, event_id, event_type, event_time
FROM (SELECT DISTINCT ON (game_pk) * FROM b ORDER BY game_pk, batch DESC) WHERE event_type <> '{ENDS}'""")
def q_keyed_table_merge(spark: SparkSession, sf: str) -> DataFrame:
    ev = td.events_table(spark, sf).select(*_NEWEST.fieldNames())
    table = KeyedTable(scratch_table(spark, "newest"), _NEWEST, compact_after=1)
    for batch in range(BATCHES):
        part = ev.filter(F.col("event_id").cast("long") % BATCHES == batch)
        newest = writes.latest_per_key(part, "game_pk", ("event_time", "event_id"))
        ended = F.col("event_type") == ENDS
        before = table.read(spark, before=batch)
        table.commit(changed_rows(newest.filter(~ended), before), batch, deleted=newest.filter(ended))
    return table.read(spark)


@register_batches("insert_if_new_indexed", f"""
WITH {LOG_CTES}, {EXISTING_CTE},
firsts AS (SELECT DISTINCT ON (event_id) event_id, game_pk, partition, "offset", "offset" % {BATCHES} AS batch
           FROM good ORDER BY event_id, batch, partition, "offset")
SELECT * FROM firsts WHERE event_id NOT IN (SELECT event_id FROM existing)""")
def q_insert_if_new_indexed(spark: SparkSession, sf: str) -> DataFrame:
    path, log = scratch_table(spark, "events"), scratch_table(spark, "good")
    good(spark, sf).select("event_id", "game_pk", "partition", "offset").write.parquet(log)  # decoded once
    bucket = tables.game_bucket(F.col("game_pk")).alias("game_bucket")
    index = IdIndex(scratch_table(spark, "ids"), tables.GAME_BUCKETS)

    def stored(batches=None) -> DataFrame:
        rows = spark.read.schema("event_id string, game_pk string, partition int, offset long, batch long").parquet(path)
        return rows if batches is None else rows.filter(F.col("batch").isin(batches)).select("event_id", bucket)

    older = td.existing_events(spark, sf).select(
        "event_id", "game_pk", F.lit(None).cast("int").alias("partition"), F.lit(None).cast("long").alias("offset"))
    for batch in range(-1, BATCHES):
        if batch < 0:
            new = older
        else:
            firsts = writes.first_arrivals(spark.read.parquet(log).filter(F.col("offset") % BATCHES == batch))
            maybe = index.maybe(firsts.select("event_id", bucket), batch).persist()
            new = writes.insert_new(firsts, index.exactly(maybe, stored()))
        new.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        index.add(stored([batch]), batch, stored)
        if batch >= 0:
            maybe.unpersist()
    return stored().filter("batch >= 0")


_SEEN = T.StructType([
    T.StructField("at_bat", T.StringType()), T.StructField("game_pk", T.StringType()),
    T.StructField("at_bat_index", T.IntegerType()),
    T.StructField("seen", T.ArrayType(T.StructType([T.StructField("low", T.IntegerType()), T.StructField("high", T.IntegerType())])))])


@register_batches("gap_audit_batches", f"""
WITH {LOG_CTES},
d AS (SELECT DISTINCT game_pk, at_bat_index, pitch_number FROM good),
p AS (SELECT *, lag(pitch_number) OVER (PARTITION BY game_pk, at_bat_index ORDER BY pitch_number) AS prev FROM d)
SELECT game_pk, at_bat_index, prev AS after, pitch_number AS before, CAST(pitch_number - prev - 1 AS BIGINT) AS missing
FROM p WHERE prev IS NOT NULL AND pitch_number - prev > 1""")
def q_gap_audit_batches(spark: SparkSession, sf: str) -> DataFrame:
    log = scratch_table(spark, "good")
    good(spark, sf).select("game_pk", "at_bat_index", "pitch_number", "offset").write.parquet(log)  # decoded once
    table = KeyedTable(scratch_table(spark, "seen"), _SEEN, "at_bat")
    for batch in range(BATCHES):
        take_numbers(table, spark.read.parquet(log).filter(F.col("offset") % BATCHES == batch), batch)
    return metrics.gaps_of_intervals(table.read(spark))


def take_numbers(table: KeyedTable, pitches: DataFrame, batch: int) -> None:
    """Add the pitch numbers of a batch to the intervals that ``table`` holds of each at-bat."""
    new = metrics.number_intervals(pitches).withColumn("at_bat", F.concat_ws(":", "game_pk", F.col("at_bat_index").cast("string")))
    held = table.read(pitches.sparkSession, before=batch, only=new).select("at_bat", F.col("seen").alias("was"))
    table.commit(new.join(held, "at_bat", "left").select(
        "at_bat", "game_pk", "at_bat_index", metrics.merge_intervals(F.col("was"), F.col("seen")).alias("seen")), batch)


_DAYS = 10


@register_batches("windowed_counts", f"""
WITH {EV_CTE},
b AS (SELECT time_bucket(INTERVAL 1 DAY, event_time) AS window_start, event_type, event_time,
             CAST(event_id AS BIGINT) % {BATCHES} AS batch FROM ev),
m AS (SELECT batch, max(event_time) AS newest FROM b GROUP BY batch),
o AS (SELECT b.*, window_start + INTERVAL 1 DAY <= (SELECT max(newest) FROM m WHERE m.batch < b.batch) - INTERVAL {_DAYS} DAY
               AS late FROM b)
SELECT window_start, event_type, count(*) FILTER (WHERE late IS NOT TRUE) AS events, count(*) FILTER (WHERE late) AS late
FROM o GROUP BY window_start, event_type""")
def q_windowed_counts(spark: SparkSession, sf: str) -> DataFrame:
    ev = td.events_table(spark, sf)
    lat = ev.select("event_id", "event_time", "event_type", seconds_between(
        F.col("ingest_time"), F.col("event_time")).alias("latency_s"))
    held = latency.LatencyTables(scratch_table(spark, "windows"))
    for batch in range(BATCHES):
        latency.window_batch(lat.filter(F.col("event_id").cast("long") % BATCHES == batch), batch, held, "latency_s",
                             window="1 day", delay=f"{_DAYS} days")
    on_time = held.sketch.read(spark).groupBy(*latency.GROUP).agg(F.sum("n").alias("events"))
    late = held.late.read(spark).select(*latency.GROUP, F.col("n").alias("late"))
    return on_time.join(late, latency.GROUP, "full_outer").select(
        to_ntz(F.col("window_start")).alias("window_start"), "event_type",
        F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("late", F.lit(0)).alias("late"))
