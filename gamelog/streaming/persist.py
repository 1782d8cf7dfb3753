"""Raw log -> events table (each event once) + dead letters, as one streaming query.

Each micro-batch is decoded and validated once (persisted), split into good and bad
records, and written in a ``foreachBatch``: dead letters and new events each go to the
batch's own partition, so a batch replayed after a failure overwrites what it wrote before
and the checkpoint's offsets make the whole batch commit or not at all. Whether an event is stored
already is asked of an index of ids beside the events table (``sources.membership``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gamelog.functions.times import iso_utc
from gamelog.operators import payload, validate, writes
from gamelog.sources import logs, manifest, tables
from gamelog.sources.membership import IdIndex
from gamelog.sources.schemas import EVENTS_TABLE

EVENT_CLUSTER = ["game_bucket", "game_pk", "event_time"]


def _without_batch(spark: SparkSession, path: str, batch_id: int, buckets: list[int]) -> DataFrame:
    """The events table before this batch, restricted to the batch's game buckets.

    The bucket is a partition column, so the filter prunes folders before any file is listed or
    opened; only the ``event_id`` column is read.
    """
    schema = T.StructType(EVENTS_TABLE.fields + [T.StructField("game_bucket", T.IntegerType()),
                                                 T.StructField("batch_id", T.LongType())])
    t = tables.read_or_empty(spark, path, schema)
    return t.filter((F.col("batch_id") != F.lit(batch_id)) & F.col("game_bucket").isin(buckets))


def stored_ids(spark: SparkSession, path: str, batches: list[int] | None = None) -> DataFrame:
    """event_id and game_bucket of the events that the named batches (or all) have stored."""
    schema = T.StructType([f for f in EVENTS_TABLE if f.name == "event_id"] + [
        T.StructField("game_bucket", T.IntegerType()), T.StructField("batch_id", T.LongType())])
    ids = tables.read_or_empty(spark, path, schema)
    return (ids if batches is None else ids.filter(F.col("batch_id").isin(batches))).select("event_id", "game_bucket")


def event_index(spark: SparkSession, path: str, batch_id: int) -> IdIndex:
    """The index of the stored ids before ``batch_id``, made now for a table that has none."""
    index = IdIndex(f"{path}_ids", tables.GAME_BUCKETS)
    if manifest.newest(spark, index.path, batch_id) is None:
        schema = T.StructType([T.StructField("batch_id", T.LongType())])
        earlier = tables.read_or_empty(spark, path, schema).select("batch_id").filter(
            F.col("batch_id") < batch_id).distinct()
        batches = sorted(r[0] for r in earlier.collect())
        if batches:
            index.rebuild(stored_ids(spark, path, batches), batches, batch_id - 1)
    return index


def persist_batch(batch: DataFrame, batch_id: int, events_path: str, dlq_path: str) -> dict:
    """Write one micro-batch of log records; returns outcome counts for monitoring."""
    spark = batch.sparkSession
    v = validate.validate(logs.decode_pitches(batch)).persist()
    try:
        good = validate.good_records(v)
        letters = validate.dead_letters(validate.bad_records(v),
                                        iso_utc(F.current_timestamp()))
        tables.write_batch_partition(validate.envelope_json(letters), dlq_path, batch_id)
        bucket = tables.game_bucket(F.col("game_pk")).alias("game_bucket")
        # at most GAME_BUCKETS small integers reach the driver
        buckets = [r[0] for r in good.select(bucket).distinct().collect()]
        index = event_index(spark, events_path, batch_id)
        firsts = writes.first_arrivals(good)
        maybe = index.maybe(firsts.select("event_id", bucket), batch_id, buckets).persist()
        try:
            known = index.exactly(maybe, _without_batch(spark, events_path, batch_id, buckets))
            rows = payload.events_row(writes.insert_new(firsts, known)).withColumn("game_bucket", bucket)
            tables.write_batch_partition(rows, events_path, batch_id, cluster_by=EVENT_CLUSTER,
                                         folders=("game_bucket",))
        finally:
            maybe.unpersist()
        index.add(stored_ids(spark, events_path, [batch_id]), batch_id, lambda batches: stored_ids(spark, events_path, batches))
        counts = v.agg(F.count_if(F.col("error_kind").isNull()).alias("good"),
                       F.count_if(F.col("error_kind").isNotNull()).alias("dead_letters")).first()
        return {"batch_id": batch_id, "good": counts["good"], "dead_letters": counts["dead_letters"]}
    finally:
        v.unpersist()


def start_persist(log_stream: DataFrame, events_path: str, dlq_path: str, checkpoint: str,
                  trigger: dict | None = None):
    """Start the persist query on a log-shaped stream (file or Kafka source).

    Per-batch record counts by validity are published as observed metrics
    (``lastProgress["observedMetrics"]["raw_records"]``), the streaming form of the
    message counters.
    """
    observed = log_stream.observe(
        "raw_records", F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("value").isNull()).alias("null_values"))
    writer = (observed.writeStream.option("checkpointLocation", checkpoint)
              .foreachBatch(lambda df, bid: persist_batch(df, bid, events_path, dlq_path)))
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    return writer.start()


def dedup_stream(good_stream: DataFrame, key: str = "event_id",
                 watermark: tuple[str, str] | None = None) -> DataFrame:
    """Pure-stream insert-if-new: each key passes once.

    Without ``watermark`` the dedup state keeps every key seen (exact, state grows with the
    key count; the table probe of ``persist_batch`` avoids that). With ``(time_col, delay)``
    the state is bounded by ``dropDuplicatesWithinWatermark``, and copies arriving later than
    the delay are no longer recognised (the events table probe still catches them).
    """
    if watermark is None:
        return good_stream.dropDuplicates([key])
    time_col, delay = watermark
    return good_stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([key])
