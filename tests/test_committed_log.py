"""The committed log: whole batches only, replays replace, reading goes on where it stopped."""

import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gamelog.sources import committed_log as cl
from gamelog.sources.schemas import LOG_RECORD

T0 = datetime(2024, 7, 15)


def records(low, high, partitions=3):
    return [(b"k%d" % i, b"v%d" % i, "raw", i % partitions, i, T0) for i in range(low, high)]


def offsets(df):
    return sorted(r["offset"] for r in df.collect())


def land(spark, folder, name, rows):
    spark.createDataFrame(rows, LOG_RECORD).coalesce(2).write.parquet(f"{folder}/{name}")


def write_all(spark, scratch):
    stream = spark.readStream.schema(LOG_RECORD).option("recursiveFileLookup", "true").parquet(f"{scratch}/land")
    cl.start_committed_log(stream, f"{scratch}/log", f"{scratch}/ck-w").awaitTermination()


def test_written_and_read_back(spark, scratch):
    assert offsets(cl.read_committed(spark, f"{scratch}/log")) == []
    for i in range(3):
        land(spark, f"{scratch}/land", str(i), records(i * 50, i * 50 + 50))
        write_all(spark, scratch)
    back = cl.read_committed(spark, f"{scratch}/log")
    assert back.exceptAll(spark.createDataFrame(records(0, 150), LOG_RECORD)).count() == 0 and back.count() == 150
    assert len(os.listdir(f"{scratch}/log/_log")) == 3


def batch(rows):
    import pyarrow as pa
    return pa.Table.from_pylist([dict(zip(LOG_RECORD.fieldNames(), r)) for r in rows], schema=pa.schema(
        [(f.name, f.type) for f in cl.ARROW])).to_batches()[0]


def test_readers_see_no_open_or_failed_batch_and_replays_replace(spark, scratch):
    path = f"{scratch}/log"
    w = cl._Writer(path)
    w.commit([w.write(iter([batch(records(0, 10))])), None], 0)
    open_batch = w.write(iter([batch(records(10, 20))]))  # written, not committed
    assert offsets(cl.read_committed(spark, path)) == list(range(10))
    w.abort([open_batch, None], 1)
    assert offsets(cl.read_committed(spark, path)) == list(range(10))
    w.commit([w.write(iter([batch(records(10, 20))]))], 1)
    w.commit([w.write(iter([batch(records(10, 13))]))], 1)  # the batch again, with fewer rows
    assert offsets(cl.read_committed(spark, path)) == list(range(13))
    named = {f["file"] for _, files in cl._Store(path).files() for f in files}
    assert set(os.listdir(f"{path}/data")) == named


@pytest.mark.parametrize("max_rows", [None, 7, 1000])
def test_a_restart_loses_and_repeats_nothing(spark, scratch, max_rows):
    path, seen = f"{scratch}/log", []
    w = cl._Writer(path)

    def drain(limit):
        stream = cl.read_committed_stream(spark, path, max_rows=max_rows)
        q = (stream.writeStream.option("checkpointLocation", f"{scratch}/ck")
             .foreachBatch(lambda df, _: seen.append(offsets(df))).trigger(processingTime="0 seconds").start())
        for _ in range(200):
            if sum(map(len, seen)) >= limit or q.exception():
                break
            q.awaitTermination(0.2)
        q.stop()

    w.commit([w.write(iter([batch(records(0, 20))])), w.write(iter([batch(records(20, 40))]))], 0)
    drain(14)  # stopped in the middle
    w.commit([w.write(iter([batch(records(40, 60))]))], 1)
    drain(60)
    got = [o for part in seen for o in part]
    assert sorted(got) == list(range(60)) and len(set(got)) == 60
    if max_rows == 7:
        assert max(map(len, seen)) == 7 and len(seen) >= 9


def test_positions_are_cut_inside_a_file(scratch):
    path = f"{scratch}/log"
    w = cl._Writer(path)
    w.commit([w.write(iter([batch(records(0, 30))]))], 0)
    r = cl._StreamReader(path, "r", 4)
    at, read = {}, []
    while True:
        end = r.latestOffset()
        if end == at:
            break
        parts = r.partitions(at, end)
        rows = [o for p in parts for b in r.read(p) for o in b["offset"].to_pylist()]
        assert 0 < len(rows) <= 4
        read += rows
        at = end
    assert sorted(read) == list(range(30)) and json.load(open(f"{path}/_readers/r.json")) == at == {"0": 28, "1": 29, "2": 30}


def test_a_batch_table_keeps_nothing_of_an_earlier_try(spark, scratch):
    from gamelog.sources import tables
    rows = spark.range(40).select(F.col("id"), (F.col("id") % 4).alias("game_bucket"))
    for keep in (40, 2, 0):
        tables.write_batch_partition(rows.filter(F.col("id") < keep), f"{scratch}/t", 5, folders=("game_bucket",))
        tables.write_batch_partition(rows.filter(F.col("id") < keep).drop("game_bucket"), f"{scratch}/u", 5)
        for name in ("t", "u"):
            left = spark.read.schema("id long, batch_id long").parquet(f"{scratch}/{name}")
            assert left.count() == keep
