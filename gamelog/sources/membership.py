"""Which ids are stored already: an index of bits beside the events table.

Each batch adds a segment: blocks of eight 32-bit words, in which an id sets one bit of each word
(a Bloom filter in blocks). A segment has as many blocks a game bucket as its ids ask for, and is
a small fraction of them. To look a batch up, its ids are joined with the blocks they fall into;
an id with a bit missing is surely not stored. The few whose bits are all set, true copies and the
odd false one, are then looked for among the stored ids themselves, so the answer is exact. Stored
ids are read for that (one column of the batch's game buckets), but only move when more ids are
left than a task can hold.

Segments of one size are merged four at a time, from the stored ids of their batches, so there are
few of them and an id is read again a logarithmic number of times at most. Which segments count is
in a state file published last, so a batch done again adds nothing twice.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gamelog.sources import manifest

WORDS, IDS_PER_BLOCK, MERGE = 8, 16, 4
#: Ids left after the bits that are sent to all tasks (a count is checked); more are joined by a shuffle.
SENT = 200_000
_SCHEMA = "block int, " + ", ".join(f"w{i} int" for i in range(WORDS)) + ", game_bucket int"


def _block(key: Column, level: int) -> Column:
    return F.xxhash64(key).bitwiseAND((1 << level) - 1).cast("int")


def _bits(key: Column) -> list[Column]:
    """The bit that an id sets in each word."""
    h = F.xxhash64(F.lit("bits"), key)
    return [F.call_function("shiftleft", F.lit(1), n)
            for n in (F.shiftrightunsigned(h, 5 * i).bitwiseAND(31).cast("int") for i in range(WORDS))]


def level_for(ids: int, buckets: int) -> int:
    """Blocks a bucket, as a power of two, for so many ids in so many buckets."""
    return max(0, math.ceil(math.log2(max(ids / max(buckets, 1) / IDS_PER_BLOCK, 1))))


@dataclass(frozen=True)
class IdIndex:
    path: str
    buckets: int
    key: str = "event_id"

    def _segments(self, spark: SparkSession, before: int | None) -> list[dict]:
        state = manifest.newest(spark, self.path, before)
        return state["segments"] if state else []

    def _write(self, ids: DataFrame, name: str, batches: list[int], count: int, level: int = 0) -> dict:
        """A segment of ``ids`` (key, game_bucket), of ``level`` at least."""
        level = max(level, level_for(count, self.buckets))
        key = F.col(self.key)
        rows = ids.select("game_bucket", _block(key, level).alias("block"), *[
            b.alias(f"w{i}") for i, b in enumerate(_bits(key))]).groupBy("game_bucket", "block").agg(
            *[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])
        # sorted, so that a reader of some buckets skips the pages of the others
        rows.sortWithinPartitions("game_bucket", "block").write.mode("overwrite").parquet(f"{self.path}/segment/{name}")
        return {"name": name, "level": level, "batches": batches, "ids": count}

    def add(self, ids: DataFrame, batch_id: int, stored) -> None:
        """Add the ids that batch ``batch_id`` has stored (key, game_bucket).

        ``stored(batches)`` gives the same columns of the ids that the named batches have stored.
        """
        spark = ids.sparkSession
        segments = self._segments(spark, int(batch_id))
        count = ids.count()
        if count:
            segments = [*segments, self._write(ids, str(int(batch_id)), [int(batch_id)], count)]
        while True:
            sizes = [s["level"] // 2 for s in segments]
            full = next((size for size in sizes if sizes.count(size) >= MERGE), None)
            if full is None:
                break
            old = [s for s in segments if s["level"] // 2 == full]
            batches = sorted(b for s in old for b in s["batches"])
            merged = self._write(stored(batches), f"{int(batch_id)}-{full}", batches, sum(s["ids"] for s in old), 2 * full + 2)
            segments = [s for s in segments if s not in old] + [merged]
        self._publish(spark, batch_id, segments)

    def rebuild(self, ids: DataFrame, batches: list[int], batch_id: int) -> None:
        """One segment of all ``ids`` that ``batches`` have stored, as the state after ``batch_id``."""
        self._publish(ids.sparkSession, batch_id, [self._write(ids, f"{int(batch_id)}-all", batches, ids.count())])

    def _publish(self, spark: SparkSession, batch_id: int, segments: list[dict]) -> None:
        manifest.publish(spark, self.path, int(batch_id), {"segments": segments})
        named = {s["name"] for state in manifest.forget(spark, self.path) for s in state["segments"]}
        for name in manifest.children(spark, f"{self.path}/segment"):
            if name not in named:
                manifest.delete(spark, f"{self.path}/segment/{name}")

    def maybe(self, ids: DataFrame, before: int | None = None, in_buckets: list[int] | None = None) -> DataFrame:
        """Those of ``ids`` (key, game_bucket) that may be stored: all that are, and few others."""
        spark = ids.sparkSession
        segments = self._segments(spark, before)
        if not segments:
            return ids.filter("false")
        blocks = None
        for i, s in enumerate(segments):
            one = spark.read.schema(_SCHEMA).parquet(f"{self.path}/segment/{s['name']}").withColumn("segment", F.lit(i))
            blocks = one if blocks is None else blocks.unionByName(one)
        if in_buckets is not None:
            blocks = blocks.filter(F.col("game_bucket").isin(in_buckets))
        key = F.col(self.key)
        places = F.array(*[F.struct(F.lit(i).alias("segment"), _block(key, s["level"]).alias("block"))
                           for i, s in enumerate(segments)])
        asked = ids.select(*ids.columns, F.explode(places).alias("at")).select(
            *ids.columns, "at.segment", "at.block", *[b.alias(f"b{i}") for i, b in enumerate(_bits(key))])
        held = asked.join(blocks, ["segment", "game_bucket", "block"])
        for i in range(WORDS):
            held = held.filter(F.col(f"w{i}").bitwiseAND(F.col(f"b{i}")) != 0)
        return held.select(*ids.columns).distinct()

    def exactly(self, maybe: DataFrame, stored: DataFrame) -> DataFrame:
        """Those of ``maybe`` (a persisted result of it) that ``stored`` (key) has."""
        left = maybe.select(self.key)
        if left.count() <= SENT:
            return stored.select(self.key).join(F.broadcast(left), self.key, "left_semi").distinct()
        return left.join(stored.select(self.key), self.key, "left_semi")
