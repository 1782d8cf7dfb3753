"""Raw log -> enriched log and per-game context, one micro-batch at a time.

Each batch runs the batch form of the rolling context (JVM-side, a large game split into chunks
of the log), seeded by the context table as it stood before the batch, then writes the full
enriched records to the batch's own partition and, as changes of the context table, the newest
context of the games that the table lacks or holds another context of. A replayed batch reads the
same seed and rewrites the same output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gamelog.operators import enrich, validate
from gamelog.sources import logs, manifest, tables
from gamelog.sources.keyed import KeyedTable, changed_rows
from gamelog.sources.schemas import CONTEXT

TOPIC = "enriched"


def write_enriched_batch(batch: DataFrame, batch_id: int, enriched_path: str, context_path: str,
                         stored: DataFrame | None = None) -> None:
    """Enrich one batch of log records; ``stored`` seeds games the context table lacks."""
    spark = batch.sparkSession
    contexts = KeyedTable(context_path, CONTEXT)
    # a replay of stored events must not move a game's context back
    live = validate.live_records(logs.decode_pitches(batch))
    pitches = validate.validate(validate.enrichable(live)).persist()
    try:
        if manifest.newest(spark, context_path, batch_id) is None:
            held = spark.createDataFrame([], CONTEXT)  # the first batch takes all that was stored elsewhere
            seeds = held if stored is None else stored.select(*CONTEXT.fieldNames())
        else:
            games = pitches.select("game_pk").distinct()
            seeds = held = contexts.read(spark, before=batch_id, only=games)
            if stored is not None:
                more = stored.select(*CONTEXT.fieldNames()).join(games, "game_pk", "left_semi")
                seeds = held.unionByName(more.join(held.select("game_pk"), "game_pk", "left_anti"))
        rows = enrich.enriched_rows(enrich.rolling_context(pitches, seeds))
        records = enrich.enriched_log_records(rows, TOPIC, keep=enrich.ARRIVAL)
        tables.write_batch_partition(records, enriched_path, batch_id)
        newest = enrich.newest_context(pitches, seeds).select(*CONTEXT.fieldNames())
        contexts.commit(changed_rows(newest, held), batch_id)
    finally:
        pitches.unpersist()


def start_enrich(log_stream: DataFrame, enriched_path: str, context_path: str, checkpoint: str,
                 stored: DataFrame | None = None, trigger: dict | None = None):
    """Run the enrichment query over a log-shaped stream (file or Kafka source)."""
    writer = (log_stream.writeStream.option("checkpointLocation", checkpoint)
              .foreachBatch(lambda df, bid: write_enriched_batch(df, bid, enriched_path, context_path, stored)))
    return writer.trigger(**(trigger or {"availableNow": True})).start()
