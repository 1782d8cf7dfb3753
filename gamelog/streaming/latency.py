"""Latency percentiles and event counts of event-time windows, over a stream.

A window is open until the newest event time of the earlier batches is a given delay behind its
end. Rows of open windows go into a mergeable sketch of their window and event type; rows that come
for a closed window are counted apart, so none is lost. All of it is kept in keyed tables, so a batch
writes the bins it has changed, and one that is done again starts from what was there before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gamelog.operators.metrics import quantile_sketch
from gamelog.sources.keyed import KeyedTable

GROUP = ["window_start", "event_type"]
_KEY, _LONG = T.StructField("id", T.StringType()), T.LongType()
_WINDOW = [T.StructField("window_start", T.TimestampType()), T.StructField("event_type", T.StringType())]
SKETCH = T.StructType([_KEY, *_WINDOW, T.StructField("bin", T.IntegerType()), T.StructField("n", _LONG)])
LATE = T.StructType([_KEY, *_WINDOW, T.StructField("n", _LONG)])
MARK = T.StructType([_KEY, T.StructField("newest", T.TimestampType())])


class LatencyTables:
    """The tables of one query below ``path``."""

    def __init__(self, path: str):
        self.sketch, self.late, self.mark = (KeyedTable(f"{path}/{name}", schema, "id") for name, schema in (
            ("sketch", SKETCH), ("late", LATE), ("mark", MARK)))


def _text(*columns: str) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def _add(table: KeyedTable, counts: DataFrame, batch_id: int) -> None:
    """Add counts ``n`` to those that the table holds for the same keys."""
    held = table.read(counts.sparkSession, before=batch_id, only=counts)
    both = counts.select(*table.schema.fieldNames()).unionByName(held)
    rest = [c for c in table.schema.fieldNames() if c not in ("id", "n")]
    table.commit(both.groupBy("id", *rest).agg(F.sum("n").alias("n")).select(*table.schema.fieldNames()), batch_id)


def window_batch(rows: DataFrame, batch_id: int, tables: LatencyTables, value: str, window: str = "1 hour",
                 delay: str = "1 hour") -> None:
    """Take one batch of rows (event_time, event_type and the column ``value``) into the tables."""
    spark = rows.sparkSession
    newest = tables.mark.read(spark, before=batch_id).agg(F.max("newest")).first()[0]
    w = F.window(F.col("event_time").cast("timestamp"), window)
    placed = rows.filter("event_time IS NOT NULL").select(
        w.alias("w"), "event_type", F.col(value).alias("_v"), F.col("event_time").cast("timestamp").alias("_t"))
    placed = placed.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("_end"), "event_type", "_v", "_t").persist()
    try:
        closed = F.lit(False) if newest is None else (
            F.col("_end") <= F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {delay}"))
        bins = quantile_sketch(placed.filter(~closed), GROUP, "_v").withColumn("id", _text(*GROUP, "bin"))
        _add(tables.sketch, bins, batch_id)
        late = placed.filter(closed).groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n")).withColumn("id", _text(*GROUP))
        _add(tables.late, late, batch_id)
        mark = placed.agg(F.max("_t").alias("newest")).select(F.lit("all").alias("id"), F.greatest(
            "newest", F.lit(newest).cast("timestamp")).alias("newest")).filter("newest IS NOT NULL")
        tables.mark.commit(mark, batch_id)
    finally:
        placed.unpersist()


def start_windows(stream: DataFrame, path: str, checkpoint: str, value: str, window: str = "1 hour",
                  delay: str = "1 hour", trigger: dict | None = None):
    """Run ``window_batch`` over a stream of events."""
    tables = LatencyTables(path)
    writer = (stream.writeStream.option("checkpointLocation", checkpoint)
              .foreachBatch(lambda df, bid: window_batch(df, bid, tables, value, window, delay)))
    return writer.trigger(**(trigger or {"availableNow": True})).start()
