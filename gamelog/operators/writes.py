"""Idempotent writes: insert-if-new by event id (first writer wins) and keyed upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gamelog.functions.cols import as_col, blank_to_null, shared_shuffle
from gamelog.sources.schemas import OUTCOME_DUPLICATE, OUTCOME_WRITTEN

ARRIVAL = ("partition", "offset")


def first_arrivals(rows: DataFrame, key: str = "event_id",
                   arrival: Sequence[str] = ARRIVAL) -> DataFrame:
    """The earliest arrival of each key; later copies are ignored whatever their payload.

    ``min_by`` combines map-side, so a key with millions of copies is reduced inside each
    task before the shuffle instead of being gathered in one place.
    """
    return _unpacked(_first_rows(rows, key, arrival), rows, key)


def _first_rows(rows: DataFrame, key: str, arrival: Sequence[str]) -> DataFrame:
    """Each key with its earliest row in one column, ``_first``."""
    cols = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(*arrival)).alias("_first"))


def _unpacked(firsts: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return firsts.select(key, *[F.col(f"_first.{c}").alias(c) for c in rows.columns if c != key])


def insert_if_new(batch: DataFrame, table: DataFrame, key: str = "event_id",
                  arrival: Sequence[str] = ARRIVAL) -> DataFrame:
    """Rows of ``batch`` to append: first arrival per key, and only keys not in ``table``.

    The table is probed with the batch's keys first (semi join), for one column. AQE broadcasts a
    small batch; for a larger one the table's keys are shuffled, which ``insert_new`` with an index of
    the stored ids avoids. The anti join then runs between two batch-sized frames.
    """
    firsts = _first_rows(batch, key, arrival)
    # asks for the row too, so that both uses are one aggregate and the batch is computed once
    probe = firsts.filter(F.col("_first").isNotNull()).select(key)
    known = table.select(key).join(probe, key, "left_semi")
    return insert_new(_unpacked(firsts, batch, key), known, key)


def insert_new(firsts: DataFrame, known: DataFrame, key: str = "event_id") -> DataFrame:
    """Rows of ``firsts`` (a key once) whose key is not among the ``known`` ones."""
    return firsts.join(known.select(key), key, "left_anti")


def write_outcomes(batch: DataFrame, table: DataFrame, key: str = "event_id",
                   arrival: Sequence[str] = ARRIVAL) -> DataFrame:
    """Outcome per message: ``written`` for the first arrival of a new key, else ``duplicate``.

    The written messages are found per key with a map-side ``min`` and then matched back on
    (key, arrival), a unique triple, so a key with millions of copies never forms one large
    join key; the table is probed with the batch's keys only. A batch of these columns alone is
    shuffled once for all of this.
    """
    batch = shared_shuffle(batch, [key, *arrival], key, *arrival)
    firsts = batch.groupBy(key).agg(F.min(F.struct(*arrival)).alias("_p"))
    known = (table.select(key).join(firsts.select(key), key, "left_semi").distinct()
             .withColumn("_known", F.lit(True)))
    # an outer join stays above the aggregate, where an anti join would go below the shared shuffle
    written = (firsts.join(known, key, "left").filter(F.col("_known").isNull())
               .select(key, *[F.col(f"_p.{c}").alias(c) for c in arrival])
               .withColumn("_written", F.lit(True)))
    out = batch.join(written, [key, *arrival], "left")
    return out.withColumn("outcome", F.when(F.col("_written"), F.lit(OUTCOME_WRITTEN))
                          .otherwise(F.lit(OUTCOME_DUPLICATE))).drop("_written")


def latest_per_key(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Last writer per key by ``order`` (aggregated map-side)."""
    cols = [c for c in rows.columns if c != key]
    return (rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_last"))
            .select(key, *[F.col(f"_last.{c}").alias(c) for c in cols]))


GAME_COLUMNS = ["game_pk", "sport", "status", "home_team", "away_team", "start_time",
                "updated_at", "payload"]


def upsert_games(existing: DataFrame, states: DataFrame, write_time,
                 order: Sequence[str] = ("source_time", "event_id")) -> DataFrame:
    """New games table: last writer wins per game; sport is kept from the first insert;
    ``updated_at`` is the write time; empty text becomes NULL.

    ``states`` are game-state rows (E2 layout) with an optional ``payload`` column.
    """
    write_time = as_col(write_time)
    if "payload" not in states.columns:
        states = states.withColumn("payload", F.lit(None).cast("string"))
    incoming = latest_per_key(
        states.select("game_pk", "sport", "status", "home_team", "away_team",
                      F.col("event_time").alias("start_time"), "payload", *order),
        "game_pk", order)
    old = existing.select(*[F.col(c).alias(f"o_{c}") for c in GAME_COLUMNS])
    j = old.join(incoming, old.o_game_pk == incoming.game_pk, "full_outer")
    has_new = F.col("game_pk").isNotNull()

    def pick(new: Column, old_col: str) -> Column:
        return F.when(has_new, new).otherwise(F.col(old_col))

    return j.select(
        F.coalesce(F.col("game_pk"), F.col("o_game_pk")).alias("game_pk"),
        F.coalesce(F.col("o_sport"), F.col("sport")).alias("sport"),
        pick(blank_to_null(F.col("status")), "o_status").alias("status"),
        pick(blank_to_null(F.col("home_team")), "o_home_team").alias("home_team"),
        pick(blank_to_null(F.col("away_team")), "o_away_team").alias("away_team"),
        pick(F.col("start_time"), "o_start_time").alias("start_time"),
        pick(write_time.cast(existing.schema["updated_at"].dataType), "o_updated_at")
        .alias("updated_at"),
        pick(F.col("payload"), "o_payload").alias("payload"),
    )


def upsert_by_key(existing: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Keyed snapshot upsert: rows of ``updates`` (a key once) replace rows of ``existing`` by key.

    One outer join, so that each side is computed once.
    """
    rest = [c for c in existing.columns if c != key]
    new = updates.select(key, F.struct(*rest).alias("_new"))
    return existing.join(new, key, "full_outer").select(*[
        F.col(c) if c == key else F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c)
        for c in existing.columns])


def delete_keys(existing: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return existing.join(keys.select(key), key, "left_anti")
