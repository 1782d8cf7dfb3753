"""Keyed event logs: decode records, encode events, and read/write log-shaped frames.

A log frame has the columns of a Kafka source row (key, value, topic, partition, offset,
timestamp). The same functions serve batch frames read from files and streaming frames from
``readStream.format("kafka")``; at deployment ``from_protobuf`` can replace the JSON codec.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gamelog.functions.cols import evaluate_once
from gamelog.functions.enums import event_type_number, sport_number
from gamelog.functions.times import parse_upstream_time
from gamelog.sources.schemas import LIVE, LOG_RECORD, PITCH_FIELDS

CORRUPT = "_corrupt_record"
LOG_PARTITIONS = 16

# Wire form of a pitch record: spine nested, enum numbers, times as ISO text.
WIRE_SPINE = T.StructType([
    T.StructField("event_id", T.StringType()), T.StructField("event_type", T.IntegerType()),
    T.StructField("sport", T.IntegerType()), T.StructField("game_pk", T.StringType()),
    T.StructField("event_time", T.StringType()), T.StructField("source_time", T.StringType()),
    T.StructField("ingest_time", T.StringType())])
WIRE_PITCH = T.StructType(
    [T.StructField("spine", WIRE_SPINE)]
    + [T.StructField(n, t) for n, t in PITCH_FIELDS]
    + [T.StructField("source", T.StringType())]
    + [T.StructField(CORRUPT, T.StringType())])


def decode_pitches(log: DataFrame) -> DataFrame:
    """Decode log values into flat pitch rows (one parse per record).

    Adds ``decoded`` (False when the bytes are not a pitch record), the spine with enum
    numbers ``event_type_number`` / ``sport_number`` and timestamps, and the pitch fields.
    A NULL or empty value decodes to an empty record, as an empty message would. ``source`` says where
    the record comes from: ``live``, or what its writer has put there (``replay``).
    """
    parsed = F.from_json(F.col("value").cast("string"), WIRE_PITCH,
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    d = evaluate_once(log, parsed, "_m")
    sp = "_m.spine"
    times = F.struct(*[parse_upstream_time(F.col(f"{sp}.{c}")).alias(c)
                       for c in ("event_time", "source_time", "ingest_time")])
    d = evaluate_once(d, times, "_t")
    return d.select(
        "topic", "partition", "offset", "key", "value", "timestamp",
        F.col(f"_m.{CORRUPT}").isNull().alias("decoded"),
        F.col(f"{sp}.event_id").alias("event_id"),
        F.coalesce(F.col(f"{sp}.event_type"), F.lit(0)).alias("event_type_number"),
        F.coalesce(F.col(f"{sp}.sport"), F.lit(0)).alias("sport_number"),
        F.col(f"{sp}.game_pk").alias("game_pk"),
        *[F.col(f"_t.{c}").alias(c) for c in ("event_time", "source_time", "ingest_time")],
        *[F.col(f"_m.{n}").alias(n) for n, _ in PITCH_FIELDS],
        F.coalesce("_m.source", F.lit(LIVE)).alias("source"),
    )


def encode_pitches(pitches: DataFrame, topic: str, keep: tuple = (), source: str | None = None) -> DataFrame:
    """Flat pitch rows -> log records keyed by game (the per-game order key).

    ``event_type`` / ``sport`` short names become enum numbers at the wire; ``keep`` names
    extra columns to carry along (for example the feed order). ``source`` labels the records. Names that
    have no number (``validate.name_reason``) are the caller's to set aside.
    """
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
    spine = F.struct(
        F.col("event_id"), event_type_number(F.col("event_type")).alias("event_type"),
        sport_number(F.col("sport")).alias("sport"), F.col("game_pk"),
        *[F.date_format(F.col(c), iso).alias(c) for c in ("event_time", "source_time",
                                                            "ingest_time")])
    label = [] if source is None else [F.lit(source).alias("source")]
    body = F.struct(spine.alias("spine"), *[F.col(n) for n, _ in PITCH_FIELDS if n in pitches.columns], *label)
    return pitches.select(
        F.col("game_pk").cast("binary").alias("key"),
        F.to_json(body).cast("binary").alias("value"),
        F.lit(topic).alias("topic"), *[F.col(c) for c in keep])


def read_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Batch read of a landed log (files in the log-record shape)."""
    return spark.read.schema(LOG_RECORD).format(fmt).load(path)


def read_log_stream(spark: SparkSession, path: str, fmt: str = "parquet",
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming read of a landed log folder; resumable through the query checkpoint."""
    reader = spark.readStream.schema(LOG_RECORD).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(path)


def read_kafka_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Kafka source from earliest (needs the Kafka connector on the cluster classpath)."""
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("subscribe", topic).option("startingOffsets", "earliest").load()
            .select("key", "value", "topic", "partition", "offset", "timestamp"))


def write_log(records: DataFrame, path: str, mode: str = "append") -> None:
    """Append log records clustered by (key, partition, offset): each file covers a narrow
    key range in log order, and range partitioning splits a hot key across writers."""
    cols = [c for c in ("key", "partition", "offset") if c in records.columns]
    (records.repartitionByRange(*cols).sortWithinPartitions(*cols)
     .write.mode(mode).parquet(path))
