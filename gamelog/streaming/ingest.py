"""Landed live-feed documents -> raw log (new pitches only) + cursor + games snapshots.

Per micro-batch: extract pitches and game states, set rows without a game key aside, drop
pitches at or before each game's cursor as it stood when the batch started and the repeats of
later polls, append the rest to the log, then write the cursors that advanced (log first, cursor
second) and the games that the batch has seen, as changes of keyed tables. A replayed batch reads the
tables as they were before it and rewrites what it wrote, so it produces the same output; consumers
dedupe by event id anyway.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gamelog.functions.scan import ordered_scan, time_chunk
from gamelog.operators import cursor, extract, writes
from gamelog.sources import logs, tables
from gamelog.sources.keyed import KeyedTable
from gamelog.sources.schemas import CURSOR, GAMES_TABLE

FEED_ORDER = ("source_time", "doc_id", "play_pos", "event_pos")


def read_feed_stream(spark: SparkSession, landing: str, max_files_per_trigger: int | None = None):
    """One row per landed document: ``doc_id`` (file name) and ``value`` (whole text)."""
    reader = spark.readStream.format("text").option("wholetext", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    docs = reader.load(landing)
    return docs.select(F.col("_metadata.file_path").alias("doc_id"), "value")


def log_records(kept: DataFrame, batch_id: int, topic: str,
                partitions: int = logs.LOG_PARTITIONS) -> DataFrame:
    """Pitches -> keyed log records with a log partition from the key and dense offsets
    (batch id in the high bits, position in feed order below)."""
    enc = logs.encode_pitches(kept, topic, keep=FEED_ORDER)
    enc = enc.withColumn("partition", F.pmod(F.xxhash64("key"), F.lit(partitions)).cast("int"))
    pos = ordered_scan(enc, ["partition"], [*FEED_ORDER, "value"], time_chunk("source_time", 60),
                       ordinal="_pos")
    return pos.select("key", "value", "topic", "partition",
                      (F.lit(int(batch_id)) * F.lit(1 << 32) + F.col("_pos")).cast("long")
                      .alias("offset"),
                      F.current_timestamp().alias("timestamp"))


def first_polls(pitches: DataFrame) -> DataFrame:
    """Each pitch (game, at-bat, number) once, as the earliest poll of the batch shows it.

    Feeds are cumulative, so a later poll repeats what an earlier one has. Only positions are
    compared, map-side, and the winners are matched back on their unique position.
    """
    key = ["game_pk", "at_bat_index", "pitch_number"]
    first = pitches.groupBy(*key).agg(F.min(F.struct(*FEED_ORDER)).alias("_p"))
    return pitches.join(first.select(*key, *[F.col(f"_p.{c}").alias(c) for c in FEED_ORDER]),
                        [*key, *FEED_ORDER], "left_semi")


def quarantined(pitches: DataFrame, states: DataFrame, batch_id: int) -> DataFrame:
    """Rows that fail the spine check, with the reason, the document and the event's own text."""
    parts = [df.filter(~F.col("valid")).select(
        "doc_id", "event_type", "event_id", F.lit("spine.game_pk is empty").alias("reason"),
        F.col(text).alias("payload")) for df, text in ((pitches, "raw_payload_json"), (states, "payload"))]
    return parts[0].unionByName(parts[1])


def ingest_batch(docs: DataFrame, batch_id: int, log_path: str, cursor_path: str,
                 games_path: str, topic: str = "raw", quarantine_path: str | None = None) -> dict:
    """Ingest one batch of documents; returns how many pitches were published and skipped.

    Rows without a game key go to ``quarantine_path`` (default: beside the log).
    """
    spark = docs.sparkSession
    now = F.current_timestamp()
    states = extract.extract_game_state(docs, now).persist()
    cursor_table, games_table = KeyedTable(cursor_path, CURSOR), KeyedTable(games_path, GAMES_TABLE)
    seen = states.filter("valid")
    # only what is behind the cursors becomes rows
    cursors = cursor_table.read(spark, before=batch_id, only=seen)
    pitches = extract.extract_new_pitches(docs, cursors, now).persist()
    try:
        tables.write_batch_partition(quarantined(pitches, states, batch_id),
                                     quarantine_path or f"{log_path}_quarantine", batch_id)
        kept = first_polls(pitches.filter("valid"))
        records = log_records(kept, batch_id, topic).persist()
        tables.write_batch_partition(records, log_path, batch_id)
        advanced = cursor.cursor_advance(kept, now, order=FEED_ORDER)
        cursor_table.commit(advanced, batch_id)
        games = games_table.read(spark, before=batch_id, only=seen)
        games_table.commit(writes.upsert_games(games, seen, now, order=("source_time", "event_id", "doc_id")), batch_id)
        published = records.count()
        records.unpersist()
        return {"batch_id": batch_id, "published": published, "skipped": extract.pitch_count(docs).first()[0] - published}
    finally:
        pitches.unpersist()
        states.unpersist()


def start_ingest(docs_stream: DataFrame, log_path: str, cursor_path: str, games_path: str,
                 checkpoint: str, trigger: dict | None = None):
    writer = (docs_stream.writeStream.option("checkpointLocation", checkpoint)
              .foreachBatch(lambda df, bid: ingest_batch(df, bid, log_path, cursor_path, games_path) and None))
    return writer.trigger(**(trigger or {"availableNow": True})).start()
