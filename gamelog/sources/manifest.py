"""Small state files that say which folders a table consists of after each batch.

A batch first writes its folders and then publishes its state in one rename, so a reader sees all
of a batch or nothing of it, and folders that no state names are as good as absent.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

STATE = "_state"
KEPT = 3


def _path(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    fs, folder = _path(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, folder = _path(spark, path)
    fs.delete(folder, True)


def versions(spark: SparkSession, table: str) -> list[int]:
    """Batches with a published state, oldest first."""
    names = children(spark, f"{table}/{STATE}")
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def state(spark: SparkSession, table: str, version: int) -> dict:
    fs, file = _path(spark, f"{table}/{STATE}/{version}.json")
    size = fs.getFileStatus(file).getLen()
    stream = fs.open(file)
    try:
        return json.loads(bytes(stream.readNBytes(size)))
    finally:
        stream.close()


def newest(spark: SparkSession, table: str, before: int | None = None) -> dict | None:
    """The newest state, or the newest of a batch before ``before``; None where there never was one.

    A state that was there and is forgotten raises.
    """
    have = versions(spark, table)
    known = [v for v in have if before is None or v < before]
    if known:
        return state(spark, table, known[-1])
    if have and state(spark, table, have[0])["previous"] is not None:
        raise ValueError(f"the state of {table} before batch {before} is gone")
    return None


def publish(spark: SparkSession, table: str, version: int, content: dict) -> None:
    """Make ``content`` the state after batch ``version``, replacing one of an earlier try.

    States after ``version`` are of batches that are to be done again, and go.
    """
    earlier = [v for v in versions(spark, table) if v < version]
    if earlier:
        content = {**content, "previous": earlier[-1]}
    else:  # the first, or one that takes the place of all that is left
        at = versions(spark, table)
        content = {**content, "previous": state(spark, table, at[0])["previous"] if at else None}
    jvm = spark.sparkContext._jvm
    fs, target = _path(spark, f"{table}/{STATE}/{version}.json")
    draft = _path(spark, f"{table}/{STATE}/.{version}.draft")[1]
    out = fs.create(draft, True)
    out.write(json.dumps(content).encode())
    out.close()
    options = jvm.org.apache.hadoop.fs.Options.Rename
    overwrite = spark.sparkContext._gateway.new_array(options, 1)
    overwrite[0] = options.OVERWRITE
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(draft, target, overwrite)
    for later in versions(spark, table):
        if later > version:
            delete(spark, f"{table}/{STATE}/{later}.json")


def forget(spark: SparkSession, table: str, kept: int = KEPT) -> list[dict]:
    """Drop all but the newest ``kept`` states; returns those that are left."""
    known = versions(spark, table)
    for old in known[:-kept]:
        delete(spark, f"{table}/{STATE}/{old}.json")
    return [state(spark, table, v) for v in known[-kept:]]
