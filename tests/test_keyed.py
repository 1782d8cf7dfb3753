"""Keyed tables: changes only, merge on read, compaction, replays and crashes."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gamelog.sources import manifest
from gamelog.sources.keyed import KeyedTable, changed_rows

SCHEMA = T.StructType([T.StructField("game_pk", T.StringType()), T.StructField("n", T.IntegerType()),
                       T.StructField("note", T.StringType())])


def rows(spark, *items):
    return spark.createDataFrame([(k, n, None) for k, n in items], SCHEMA)


def held(table, spark, **how):
    return {r.game_pk: r.n for r in table.read(spark, **how).collect()}


def files(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs
                  if f.endswith((".parquet", ".json")))


def test_a_batch_writes_its_rows_and_readers_merge(spark, scratch):
    table = KeyedTable(scratch, SCHEMA)
    assert held(table, spark) == {}
    table.commit(spark.range(5000).select(F.col("id").cast("string").alias("game_pk"), F.col("id").cast("int").alias("n"),
                                          F.lit("x").alias("note")), 0)
    table.commit(rows(spark, *[(str(i), -i) for i in range(10)]), 1)
    assert spark.read.parquet(f"{scratch}/delta/1").count() == 10
    got = held(table, spark)
    assert len(got) == 5000 and got["7"] == -7 and got["10"] == 10
    assert held(table, spark, before=1)["7"] == 7
    gone = spark.createDataFrame([("3",), ("unknown",)], "game_pk string")
    table.commit(rows(spark, ("new", 1)), 2, deleted=gone)
    got = held(table, spark)
    assert "3" not in got and "unknown" not in got and got["new"] == 1 and len(got) == 5000
    table.commit(rows(spark, ("3", 33)), 3)
    assert held(table, spark)["3"] == 33


@pytest.mark.parametrize("compact_after", [1, 3, 100])
def test_any_number_of_batches_gives_the_last_values(spark, scratch, compact_after):
    table = KeyedTable(scratch, SCHEMA, compact_after=compact_after, buckets=4)
    want = {}
    for batch in range(8):
        part = {str((batch * 3 + i) % 10): batch * 100 + i for i in range(4)}
        table.commit(rows(spark, *part.items()), batch)
        want.update(part)
        assert held(table, spark) == want
    some = spark.createDataFrame([("1",), ("9",), ("77",)], "game_pk string")
    assert held(table, spark, only=some) == {k: want[k] for k in ("1", "9") if k in want}
    names = set(files(scratch))
    assert len([n for n in names if n.startswith("_state")]) == 3
    if compact_after == 1:
        assert not any(n.startswith("delta/0/") for n in names)


@pytest.mark.parametrize("compact_after", [1, 100])
def test_replays_and_crashes_leave_the_same_table(spark, scratch, compact_after, monkeypatch):
    table = KeyedTable(scratch, SCHEMA, compact_after=compact_after, buckets=2)
    table.commit(rows(spark, ("a", 1), ("b", 1)), 0)
    table.commit(rows(spark, ("a", 2), ("c", 2)), 1)
    before = held(table, spark)

    # stopped between the changes and the state: nothing of the batch is seen
    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(manifest, "publish", stop)
        with pytest.raises(RuntimeError):
            table.commit(rows(spark, ("a", 9), ("x", 9), ("y", 9)), 2)
    assert held(table, spark) == before
    # done again, with fewer rows than the first try had
    table.commit(rows(spark, ("a", 3)), 2)
    assert held(table, spark) == {**before, "a": 3}
    # and again after it was published
    assert held(table, spark, before=2) == before
    table.commit(rows(spark, ("a", 4)), 2)
    assert held(table, spark) == {**before, "a": 4}


def test_a_reader_of_some_keys_opens_their_folders_only(spark, scratch):
    table = KeyedTable(scratch, SCHEMA, compact_after=0)
    table.commit(rows(spark, *[(str(i), i) for i in range(300)]), 0)
    plan = table.read(spark, only=rows(spark, ("5", 0)))._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert held(table, spark, only=rows(spark, ("5", 0), ("8", 0), ("none", 0))) == {"5": 5, "8": 8}


def test_changed_rows(spark):
    old = rows(spark, ("a", 1), ("b", None), ("d", 0))
    new = rows(spark, ("a", 1), ("b", 2), ("c", 0), ("d", None))
    assert sorted(r.game_pk for r in changed_rows(new, old).collect()) == ["b", "c", "d"]
    same = changed_rows(new, old, defaults={"n": 0, "note": None})
    assert sorted(r.game_pk for r in same.collect()) == ["b", "d"]
