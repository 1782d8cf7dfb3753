"""The index of stored ids: nothing missed, false positives rechecked, no shuffle of stored ids."""

import os

import pytest
from pyspark.sql import functions as F

from gamelog.sources import manifest, membership
from gamelog.sources import testdata as td
from gamelog.sources.membership import IdIndex, level_for
from gamelog.streaming import persist


def ids(spark, low, high, step=1):
    return spark.range(low, high, step).select(
        F.concat(F.lit("id:"), F.col("id")).alias("event_id"), (F.col("id") % 4).cast("int").alias("game_bucket"))


def names(df):
    return {r.event_id for r in df.collect()}


def test_nothing_stored_is_missed_and_little_else_is_left(spark, scratch):
    index = IdIndex(scratch, 4)
    parts = [(0, 3000), (3000, 3100), (3100, 3105), (3105, 9000), (9000, 9001), (9001, 9002), (9002, 9003), (9003, 9004)]

    def stored(batches):
        out = ids(spark, 0, 0)
        for b in batches:
            out = out.unionByName(ids(spark, *parts[b]))
        return out

    for b, part in enumerate(parts):
        index.add(ids(spark, *part), b, stored)
    asked = ids(spark, 0, 18_000, 3)
    maybe = names(index.maybe(asked))
    want = {f"id:{i}" for i in range(0, 9004, 3)}
    assert want <= maybe and len(maybe - want) < 60
    assert names(index.exactly(index.maybe(asked), stored(range(8)))) == want
    segments = manifest.newest(spark, scratch)["segments"]
    assert len(segments) < len(parts) and sorted(b for s in segments for b in s["batches"]) == list(range(8))
    # as it was before a batch that is done again
    assert names(index.exactly(index.maybe(asked, before=6), stored(range(6)))) == {f"id:{i}" for i in range(0, 9002, 3)}
    with pytest.raises(ValueError, match="gone"):
        index.maybe(asked, before=2)


def test_planted_false_positives_are_no_copies(spark, scratch, monkeypatch):
    index = IdIndex(scratch, 4)
    # one bit a word for all ids: every id of a block that is in use looks stored
    monkeypatch.setattr(membership, "_bits", lambda key: [F.lit(1)] * membership.WORDS)
    index.add(ids(spark, 0, 400), 0, None)
    asked = ids(spark, 200, 800)
    maybe = index.maybe(asked).persist()
    assert maybe.count() == 600
    assert names(index.exactly(maybe, ids(spark, 0, 400))) == {f"id:{i}" for i in range(200, 400)}


@pytest.mark.parametrize("sent", [0, 10**6])
def test_a_large_batch_moves_no_stored_ids(spark, scratch, monkeypatch, sent):
    monkeypatch.setattr(membership, "SENT", sent)
    path = os.path.join(scratch, "stored")
    ids(spark, 0, 5000).write.parquet(path)
    index = IdIndex(os.path.join(scratch, "ids"), 4)
    index.add(spark.read.parquet(path), 0, None)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # every batch is above the limit
    try:
        maybe = index.maybe(ids(spark, 4990, 9000)).persist()
        known = index.exactly(maybe, spark.read.parquet(path))
        assert names(known) == {f"id:{i}" for i in range(4990, 5000)}
        plan = known._jdf.queryExecution().sparkPlan().toString()
        assert ("BroadcastHashJoin" in plan) == (sent > 0)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_persist_uses_and_makes_the_index(spark, scratch):
    raw = td.raw_log(spark, "/root/testdata/sf0.001").limit(400).persist()
    events, dlq = os.path.join(scratch, "events"), os.path.join(scratch, "dlq")
    for batch in range(3):
        persist.persist_batch(raw.filter(F.col("offset") % 3 <= batch), batch, events, dlq)
    whole = spark.read.parquet(events)
    want = whole.select("event_id").distinct().count()
    assert whole.count() == want > 0
    assert manifest.newest(spark, events + "_ids")["segments"]
    # without its index the table gets one, and still nothing is stored twice
    manifest.delete(spark, events + "_ids")
    persist.persist_batch(raw, 3, events, dlq)
    assert spark.read.parquet(events).count() == want
    assert persist.stored_ids(spark, events).count() == want


def test_levels():
    assert [level_for(n, 4) for n in (0, 1, 64, 65, 6400)] == [0, 0, 0, 1, 7]
