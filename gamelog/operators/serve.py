"""Serving queries over the events and games tables, as DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gamelog.functions.times import iso_utc
from gamelog.sources.schemas import RECENT_DEFAULT_LIMIT, RECENT_MAX_LIMIT, TERMINAL_STATUSES

ROW_COLUMNS = ["event_id", "event_time", "source_time", "ingest_time", "payload"]


def active_games(games: DataFrame) -> DataFrame:
    """Games of the sport that are not over. A NULL status is excluded (NOT IN is unknown)."""
    return games.filter((F.col("sport") == "mlb") & ~F.col("status").isin(*TERMINAL_STATUSES))


def mlb_pitches(events: DataFrame) -> DataFrame:
    return events.filter((F.col("sport") == "mlb") & (F.col("event_type") == "pitch"))


def latest_pitch_per_active_game(events: DataFrame, games: DataFrame) -> DataFrame:
    """One row per active game with its newest pitch by (event_time, event_id), both
    descending; games without pitches keep NULLs; newest-updated game first.

    The per-game pick is an aggregate (``max_by``), so it combines map-side before the
    shuffle and a game with most of the rows is reduced to one row per task early.
    """
    act = active_games(games).select("game_pk", "home_team", "away_team", "status", "updated_at")
    pitches = mlb_pitches(events).join(act.select("game_pk"), "game_pk", "left_semi")
    latest = pitches.groupBy("game_pk").agg(
        F.max_by(F.struct(*ROW_COLUMNS), F.struct("event_time", "event_id")).alias("l"))
    out = act.join(latest, "game_pk", "left")
    return (out.orderBy(F.col("updated_at").desc())
            .select("game_pk", "home_team", "away_team", "status",
                    *[F.col(f"l.{c}").alias(c) for c in ROW_COLUMNS]))


def check_limit(limit: int) -> int:
    if not isinstance(limit, int) or limit < 1 or limit > RECENT_MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {RECENT_MAX_LIMIT}, got {limit}")
    return limit


def pitches_for_game(events: DataFrame, game_pk: str,
                     limit: int = RECENT_DEFAULT_LIMIT) -> DataFrame:
    """Newest pitches of one game; an unknown game gives no rows."""
    check_limit(limit)
    return (mlb_pitches(events).filter(F.col("game_pk") == game_pk)
            .orderBy(F.col("event_time").desc(), F.col("event_id").desc())
            .limit(limit).select(*ROW_COLUMNS))


def events_for_game(events: DataFrame, game_pk: str,
                    limit: int = RECENT_DEFAULT_LIMIT) -> DataFrame:
    """Newest events of one game, every event type."""
    check_limit(limit)
    return (events.filter((F.col("sport") == "mlb") & (F.col("game_pk") == game_pk))
            .orderBy(F.col("event_time").desc(), F.col("event_id").desc())
            .limit(limit).select(*ROW_COLUMNS))


def _top_per_game(rows: DataFrame, limit: int) -> DataFrame:
    # row_number <= k over a window is planned with a partial group limit before the
    # shuffle, so each task forwards at most k rows per game.
    w = Window.partitionBy("game_pk").orderBy(F.col("event_time").desc(), F.col("event_id").desc())
    top = rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    # rows of the answer beside each row; at most k rows of a game are left to count
    return top.select("game_pk", *ROW_COLUMNS, F.col("rank").cast("long").alias("rank"),
                      F.count(F.lit(1)).over(Window.partitionBy("game_pk")).alias("count"))


def recent_pitches_per_game(events: DataFrame, limit: int = RECENT_DEFAULT_LIMIT) -> DataFrame:
    """The recent-pitches answer for every game at once (top-k per game)."""
    return _top_per_game(mlb_pitches(events), check_limit(limit))


def recent_events_per_game(events: DataFrame, limit: int = RECENT_DEFAULT_LIMIT) -> DataFrame:
    return _top_per_game(events.filter(F.col("sport") == "mlb"), check_limit(limit))


def state_for_game(context_snapshot: DataFrame, game_pk: str) -> DataFrame:
    """Current context of one game from the snapshot table."""
    return context_snapshot.filter(F.col("game_pk") == game_pk)


def shape_rows(rows: DataFrame, time_columns=("event_time", "source_time", "ingest_time"),
               payload_column: str = "payload") -> DataFrame:
    """Response form: times as ISO-8601 text, payload as parsed JSON (compact text)."""
    out = rows
    for c in time_columns:
        if c in rows.columns:
            out = out.withColumn(c, iso_utc(F.col(c)))
    if payload_column in rows.columns:
        out = out.withColumn(payload_column, F.to_json(F.try_parse_json(F.col(payload_column))))
    return out
