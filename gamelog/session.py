"""Session construction and the few cluster settings every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the operators assume. AQE re-plans joins at runtime (broadcast a side only once
# its real shuffle size is known, split skewed join partitions); UTC keeps the ISO text
# forms and the timestamp arithmetic identical on every executor.
# HotSpot never compiles a method of more than 8000 bytes of bytecode: such a stage is better off without
# whole-stage code generation, its expressions compiled in parts (the Spark documentation advises this value).
METHOD_LIMIT = ("spark.sql.codegen.hugeMethodLimit", "8000")
_DEFAULTS = {
    METHOD_LIMIT[0]: METHOD_LIMIT[1],
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # keyed streaming state (per-game context) lives off-heap and is checkpointed
    # incrementally, so state size does not pressure executor heaps
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "gamelog", extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names a shared, durable folder and is used as is. Only a local
    master without it (unit tests on one machine) gets a private folder.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="gamelog-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(configured)
    return configured


def scratch_table(spark: SparkSession, name: str) -> str:
    """A new folder for a table that goes when the session ends."""
    path = scratch_dir(spark, f"{name}-{uuid.uuid4().hex}")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediate tables."""
    return os.path.join(ensure_checkpoint_dir(spark), name)
