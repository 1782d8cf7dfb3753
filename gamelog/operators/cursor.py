"""Per-game publish cursor: skip pitches already published, then advance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gamelog.functions.cols import as_col, seconds_between
from gamelog.operators.writes import upsert_by_key

FEED_ORDER = ("play_pos", "event_pos")


def already_published(cursors_joined: DataFrame):
    """True when (at_bat_index, pitch_number) is at or before the game's cursor."""
    return (F.col("last_at_bat_index").isNotNull()
            & (F.struct("at_bat_index", "pitch_number")
               <= F.struct("last_at_bat_index", "last_pitch_number")))


def mark_published(pitches: DataFrame, cursors: DataFrame) -> DataFrame:
    """Join each pitch with its game's cursor (as read at poll start) and flag ``skip``.

    The cursor table has one row per game, so its size follows the number of games; AQE
    broadcasts it when its measured size allows and otherwise shuffles both sides.
    """
    cur = cursors.select("game_pk", "last_at_bat_index", "last_pitch_number")
    return (pitches.join(cur, "game_pk", "left")
            .withColumn("skip", F.coalesce(already_published(pitches), F.lit(False))))


def cursor_filter(pitches: DataFrame, cursors: DataFrame) -> DataFrame:
    """Pitches after the cursor (lexicographic on at-bat, pitch); no cursor keeps all."""
    return (mark_published(pitches, cursors).filter(~F.col("skip"))
            .drop("skip", "last_at_bat_index", "last_pitch_number"))


def cursor_advance(published: DataFrame, now, order: Sequence[str] = FEED_ORDER,
                   mode: str = "feed_order") -> DataFrame:
    """New cursor per game from what was published: the last pitch in feed order
    (``mode='feed_order'``) or the greatest (at-bat, pitch) (``mode='max'``)."""
    pair = F.struct(F.col("at_bat_index").alias("a"), F.col("pitch_number").alias("p"))
    if mode == "feed_order":
        last = F.max_by(pair, F.struct(*order))
    elif mode == "max":
        last = F.max(pair)
    else:
        raise ValueError(f"unknown cursor mode {mode!r}")
    return (published.groupBy("game_pk").agg(last.alias("_c"))
            .select("game_pk", F.col("_c.a").alias("last_at_bat_index"),
                    F.col("_c.p").alias("last_pitch_number"),
                    as_col(now).cast("timestamp").alias("updated_at")))


def apply_cursor(cursors: DataFrame, advanced: DataFrame) -> DataFrame:
    """Cursor table after a write: advanced games replaced, the rest unchanged."""
    return upsert_by_key(cursors, advanced.select(*cursors.columns), "game_pk")


def cursor_counts(marked: DataFrame) -> DataFrame:
    """Published / skipped counts per game for one poll."""
    return marked.groupBy("game_pk").agg(
        F.count_if(~F.col("skip")).alias("published"),
        F.count_if(F.col("skip")).alias("skipped"))


def cursor_staleness(cursors: DataFrame, as_of) -> DataFrame:
    """Seconds since each game's cursor last moved."""
    return cursors.select("game_pk", seconds_between(as_of, F.col("updated_at")).alias("staleness_s"))
