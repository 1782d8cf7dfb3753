"""Parquet tables the jobs own: the append-only events table and versioned snapshots.

No MERGE exists for plain Parquet, so writes are made idempotent per micro-batch: each batch
writes its own ``batch_id`` partition with dynamic overwrite, so re-running a batch after a
failure replaces exactly what that batch wrote before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gamelog.sources import manifest
from gamelog.sources.keyed import KeyedTable

# Hash buckets of the game key, folders of the events table. Ids embed the game key, so every copy
# of an id lands in one bucket and a dedup probe only lists and reads the buckets of the batch.
GAME_BUCKETS = 256


def game_bucket(game_pk: Column) -> Column:
    return F.pmod(F.xxhash64(game_pk), F.lit(GAME_BUCKETS)).cast("int")


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether the folder exists and holds files; any other trouble with it is raised."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(folder) and len(fs.listStatus(folder)) > 0


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table with its declared schema, or no rows where it was never written."""
    if table_exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def write_batch_partition(df: DataFrame, path: str, batch_id: int, cluster_by: list[str] | None = None,
                          folders: tuple[str, ...] = ()) -> None:
    """Write ``df`` as partition ``batch_id=<id>`` of ``path``, below the partitions of ``folders``.

    All that an earlier try of the batch wrote goes first, also where this one has no rows.
    Rows are clustered by ``cluster_by`` across and inside files so min/max statistics let
    readers skip files and row groups by bucket, game and time.
    """
    spark = df.sparkSession
    every = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/*" * len(folders) + f"/batch_id={int(batch_id)}")
    fs = every.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for old in fs.globStatus(every) or []:
        fs.delete(old.getPath(), True)
    out = df.withColumn("batch_id", F.lit(int(batch_id)).cast("long"))
    if cluster_by:
        # range partitioning keeps each file to a narrow key range and splits a hot key
        # across writers by sampled boundaries
        out = out.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*folders, "batch_id").parquet(path))


KEPT_VERSIONS = 3


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of a snapshot table, oldest first, from its folder names."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n.removeprefix("batch_id=")) for n in names if n.startswith("batch_id="))


def write_snapshot(df: DataFrame, path: str, version: int) -> None:
    """A keyed snapshot table (cursor, context) as version ``version``; old versions are dropped."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/batch_id={int(version)}")
    for old in _versions(spark, path)[:-KEPT_VERSIONS]:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch_id={old}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType,
                  before: int | None = None) -> DataFrame:
    """Newest version of a snapshot table (or the newest before ``before``); only it is read.

    A keyed table (``sources.keyed``, the schema's first column being the key) is merged.
    """
    if manifest.versions(spark, path):
        return KeyedTable(path, schema, schema.fieldNames()[0]).read(spark, before)
    known = [v for v in _versions(spark, path) if before is None or v < before]
    if not known:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/batch_id={known[-1]}")


def bucket_number(spark: SparkSession, games: list[str]) -> list[int]:
    """The buckets of some game keys, by the expression that the writer uses."""
    keys = F.array(*[F.lit(g) for g in games])
    return sorted(set(spark.range(1).select(F.transform(keys, game_bucket)).first()[0])) if games else []


def read_events(spark: SparkSession, path: str, games: str | list[str] | None = None) -> DataFrame:
    """The events table with its declared schema (no inference, filters pushed to Parquet).

    With ``games`` (a key or a list) only their folders are listed and opened, and their rows given.
    """
    from gamelog.sources.schemas import EVENTS_TABLE
    if games is None:
        return spark.read.schema(EVENTS_TABLE).parquet(path)
    games = [games] if isinstance(games, str) else list(games)
    schema = T.StructType([*EVENTS_TABLE, T.StructField("game_bucket", T.IntegerType())])
    rows = spark.read.schema(schema).parquet(path)
    return rows.filter(F.col("game_bucket").isin(bucket_number(spark, games)) & F.col("game_pk").isin(games)).select(
        EVENTS_TABLE.fieldNames())


def read_games(spark: SparkSession, path: str) -> DataFrame:
    """Latest version of the games snapshot table."""
    from gamelog.sources.schemas import GAMES_TABLE
    return read_snapshot(spark, path, GAMES_TABLE)
