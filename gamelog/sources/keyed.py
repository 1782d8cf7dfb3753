"""Tables with one row per key, kept as a base and the changes of the batches since.

A batch writes only the rows that it changes. Readers merge: the newest change of a key stands for
the base's row, and a change marked as a deletion for none. After ``COMPACT_AFTER`` batches the
merged table is written as the next base, in folders by a hash of the key, so that a reader that
asks for some keys opens only their folders. A state file published last (``manifest``) names the
base and the changes that count, so a batch that stopped half-way changes nothing, and a batch
done again reads the table as it was before it and replaces what it wrote.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gamelog.sources import manifest

COMPACT_AFTER = 16
BUCKETS = 64
_DELETED, _BATCH, _BUCKET = "_deleted", "_batch", "_bucket"


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class KeyedTable:
    path: str
    schema: T.StructType
    key: str = "game_pk"
    compact_after: int = COMPACT_AFTER
    buckets: int = BUCKETS

    def read(self, spark: SparkSession, before: int | None = None, only: DataFrame | None = None) -> DataFrame:
        """The table, or as it was before batch ``before``; with ``only``, the rows of its keys.

        The keys' buckets (at most ``buckets`` small numbers) reach the driver, to prune folders.
        """
        state = manifest.newest(spark, self.path, before)
        return self._merged(spark, state, only)

    def _merged(self, spark: SparkSession, state: dict | None, only: DataFrame | None = None) -> DataFrame:
        if state is None:
            return spark.createDataFrame([], self.schema)
        names = self.schema.fieldNames()
        parts = []
        newest = self._newest_changes(spark, state["deltas"]) if state["deltas"] else None
        if state["base"] is not None:
            base = self._folder(spark, f"{self.path}/base/{state['base']}", [T.StructField(_BUCKET, T.IntegerType())])
            if only is not None:
                wanted = [r[0] for r in only.select(bucket_of(F.col(self.key), self.buckets)).distinct().collect()]
                base = base.filter(F.col(_BUCKET).isin(wanted))
            base = base.select(names)
            parts.append(base if newest is None else base.join(newest.select(self.key), self.key, "left_anti"))
        if newest is not None:
            parts.append(newest.filter(~F.col(_DELETED)))
        out = parts[0].select(names)
        for more in parts[1:]:
            out = out.unionByName(more.select(names))
        return out if only is None else out.join(only.select(self.key).distinct(), self.key, "left_semi").select(names)

    def _folder(self, spark: SparkSession, path: str, extra: list[T.StructField]) -> DataFrame:
        return spark.read.schema(T.StructType([T.StructField(f.name, f.dataType) for f in self.schema] + extra)).parquet(path)

    def _newest_changes(self, spark: SparkSession, batches: list[int]) -> DataFrame:
        """The last change of each key in the named batches."""
        rest = [n for n in [*self.schema.fieldNames(), _DELETED] if n != self.key]
        changes = None
        for batch in batches:
            one = self._folder(spark, f"{self.path}/delta/{batch}", [T.StructField(_DELETED, T.BooleanType())]).withColumn(
                _BATCH, F.lit(batch).cast("long"))
            changes = one if changes is None else changes.unionByName(one)
        if len(batches) == 1:
            return changes.drop(_BATCH)
        last = changes.groupBy(self.key).agg(F.max(_BATCH).alias(_BATCH))  # a batch has a key once
        return changes.join(last, [self.key, _BATCH]).select(self.key, *rest)

    def commit(self, changes: DataFrame, batch_id: int, deleted: DataFrame | None = None) -> None:
        """Write batch ``batch_id``: rows of ``changes`` (a key once) replace or join the table's,
        keys of ``deleted`` leave it."""
        spark = changes.sparkSession
        state = manifest.newest(spark, self.path, batch_id) or {"base": None, "deltas": []}
        rows = changes.select(*self.schema.fieldNames(), F.lit(False).alias(_DELETED))
        if deleted is not None:
            gone = deleted.select(*[F.col(f.name) if f.name == self.key else F.lit(None).cast(f.dataType).alias(f.name)
                                    for f in self.schema], F.lit(True).alias(_DELETED))
            rows = rows.unionByName(gone)
        rows.write.mode("overwrite").parquet(f"{self.path}/delta/{int(batch_id)}")
        state = {"base": state["base"], "deltas": [*state["deltas"], int(batch_id)]}
        if len(state["deltas"]) > self.compact_after:
            merged = self._merged(spark, state).withColumn(_BUCKET, bucket_of(F.col(self.key), self.buckets))
            (merged.repartition(_BUCKET).sortWithinPartitions(_BUCKET, self.key).write.mode("overwrite")
             .partitionBy(_BUCKET).parquet(f"{self.path}/base/{int(batch_id)}"))
            state = {"base": int(batch_id), "deltas": []}
        manifest.publish(spark, self.path, int(batch_id), state)
        self._clean(spark)

    def _clean(self, spark: SparkSession) -> None:
        """Folders that none of the kept states names go."""
        kept = manifest.forget(spark, self.path)
        for kind, named in (("base", {str(s["base"]) for s in kept}), ("delta", {str(b) for s in kept for b in s["deltas"]})):
            newest = max(manifest.versions(spark, self.path))
            for name in manifest.children(spark, f"{self.path}/{kind}"):
                if name not in named and int(name) < newest:
                    manifest.delete(spark, f"{self.path}/{kind}/{name}")


def changed_rows(new: DataFrame, old: DataFrame, key: str = "game_pk", defaults: dict | None = None) -> DataFrame:
    """Rows of ``new`` that differ from the row of their key in ``old``; a key that ``old`` lacks is
    compared with ``defaults``, or counts as changed without them."""
    rest = [c for c in new.columns if c != key]
    was = old.select(F.col(key), F.struct(*rest).alias("_was"))
    absent = F.struct(*[F.lit(defaults[c]).cast(new.schema[c].dataType).alias(c) for c in rest]) if defaults else F.lit(None)
    return new.join(was, key, "left").filter(
        ~F.struct(*rest).eqNullSafe(F.coalesce("_was", absent))).select(*new.columns)
