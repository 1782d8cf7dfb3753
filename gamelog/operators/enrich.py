"""Rolling per-game context and enriched pitch events (batch form).

Arrival order inside a game is the log order (partition, offset). The context after a pitch
takes the pitch's inning / outs when present (0 counts) and keeps the last known values
otherwise, starting from the stored context (or zeros). Scores and runners are carried
unchanged from the stored context. The streaming job is in ``gamelog.streaming.enrich``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gamelog.functions.ids import event_id
from gamelog.functions.scan import WHOLE_ROWS, ordered_scan
from gamelog.sources.schemas import (CONTEXT_DEFAULTS, CONTEXT_FIELDS, PITCH, PITCH_COLUMNS,
                                     SPINE_FIELDS)

ARRIVAL = ["partition", "offset"]
# Offsets per scan chunk: where log offsets are dense, a chunk never exceeds this many rows.
CHUNK_ROWS = 1 << 20
ROLLING = ("inning", "outs")
CARRIED = ("home_score", "away_score", "runner_on_first", "runner_on_second", "runner_on_third")


def _seeded(pitches: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Attach the stored context of each game (absent key -> all defaults)."""
    if stored is None:
        out = pitches
        for c in CONTEXT_FIELDS:
            out = out.withColumn(f"seed_{c}", F.lit(CONTEXT_DEFAULTS[c]))
        return out
    seeds = stored.select("game_pk", *[F.col(c).alias(f"seed_{c}") for c in CONTEXT_FIELDS])
    out = pitches.join(seeds, "game_pk", "left")
    for c in CONTEXT_FIELDS:
        out = out.withColumn(f"seed_{c}", F.coalesce(F.col(f"seed_{c}"), F.lit(CONTEXT_DEFAULTS[c])))
    return out


def context_lookup(stored: DataFrame, games: DataFrame) -> DataFrame:
    """Stored context of each requested game; a game without a stored row gets the
    all-default context (zeros, no runners)."""
    seeds = stored.select("game_pk", *[F.col(c).alias(f"_s_{c}") for c in CONTEXT_FIELDS])
    out = games.select("game_pk").join(seeds, "game_pk", "left")
    return out.select("game_pk", *[F.coalesce(F.col(f"_s_{c}"), F.lit(CONTEXT_DEFAULTS[c])).alias(c)
                                   for c in CONTEXT_FIELDS])


def rolling_context(pitches: DataFrame, stored: DataFrame | None = None,
                    chunk_rows: int = CHUNK_ROWS, sizes: DataFrame | None = None) -> DataFrame:
    """Context after each pitch, plus ``changed`` (True when the stored state is written).

    Forward fill by game in arrival order, computed with the bounded scan: one shuffle by game;
    a game with a third of all rows is split into chunks. ``sizes``: see ``ordered_scan``.
    """
    chunk = F.shiftleft(F.col("partition").cast("long"), 43) + F.expr(f"offset div {chunk_rows}")
    scanned = ordered_scan(pitches, ["game_pk"], ARRIVAL, chunk, fill=list(ROLLING), before=list(ROLLING),
                           sizes=sizes, whole=min(chunk_rows, WHOLE_ROWS))
    s = _seeded(scanned, stored)
    for c in ROLLING:
        s = (s.withColumn(f"ctx_{c}", F.coalesce(F.col(f"fill_{c}"), F.col(f"seed_{c}")))
             .withColumn(f"ctx_before_{c}", F.coalesce(F.col(f"before_{c}"), F.col(f"seed_{c}"))))
    for c in CARRIED:
        s = s.withColumn(f"ctx_{c}", F.col(f"seed_{c}"))
    changed = None
    for c in ROLLING:
        diff = ~F.col(f"ctx_{c}").eqNullSafe(F.col(f"ctx_before_{c}"))
        changed = diff if changed is None else (changed | diff)
    drop = [c for c in s.columns if c.startswith(("fill_", "before_", "seed_", "ctx_before_"))]
    return s.withColumn("changed", changed).drop(*drop)


def context_changes(ctx: DataFrame) -> DataFrame:
    """State writes: the pitches after which the stored context changes, in arrival order."""
    return ctx.filter(F.col("changed")).select(
        "game_pk", *ARRIVAL, *[F.col(f"ctx_{c}").alias(c) for c in CONTEXT_FIELDS])


def newest_context(pitches: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Newest context per game without a scan: the last inning and outs that were present
    (map-side maxima over arrival), on top of the stored context; stored games without new
    pitches keep their row."""
    at = F.struct(*ARRIVAL)
    last = pitches.groupBy("game_pk").agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in ROLLING])
    if stored is None:
        return last.select("game_pk", *[
            F.coalesce(c, F.lit(CONTEXT_DEFAULTS[c])).alias(c) if c in ROLLING
            else F.lit(CONTEXT_DEFAULTS[c]).alias(c) for c in CONTEXT_FIELDS])
    old = stored.select("game_pk", *[F.col(c).alias(f"_s_{c}") for c in CONTEXT_FIELDS])
    return last.join(old, "game_pk", "full_outer").select("game_pk", *[
        F.coalesce(*([c] if c in ROLLING else []), f"_s_{c}", F.lit(CONTEXT_DEFAULTS[c])).alias(c)
        for c in CONTEXT_FIELDS])


def enriched_rows(ctx: DataFrame) -> DataFrame:
    """Enriched events: spine copied (type/sport forced to pitch/mlb, id re-derived from the
    pitch ordinals, unset times as the epoch), the pitch nested, and the context values."""
    epoch = F.lit(0).cast("timestamp")
    ab = F.coalesce(F.col("at_bat_index"), F.lit(0))
    n = F.coalesce(F.col("pitch_number"), F.lit(0))
    spine = F.struct(
        event_id("pitch", F.col("game_pk"), ab, n).alias("event_id"),
        F.lit("pitch").alias("event_type"), F.lit("mlb").alias("sport"), F.col("game_pk"),
        *[F.coalesce(F.col(c), epoch).alias(c) for c in ("event_time", "source_time", "ingest_time")])
    def field(c: str):
        if c in ctx.columns:
            return F.col(c)
        return F.lit(None).cast(PITCH[c].dataType).alias(c)

    pitch = F.struct(*[field(c) for c in SPINE_FIELDS], *[field(c) for c in PITCH_COLUMNS])
    return ctx.select(
        *ARRIVAL, spine.alias("spine"), pitch.alias("pitch"),
        *[F.col(f"ctx_{c}").alias(c) for c in CARRIED],
        F.col("ctx_inning").alias("context_inning"), F.col("ctx_outs").alias("context_outs"))


def enriched_log_records(enriched: DataFrame, topic: str, keep=()) -> DataFrame:
    """Enriched events as log records keyed by game (the raw log's key), JSON payload value;
    ``keep`` names columns to carry along (the arrival position, say)."""
    from gamelog.operators.payload import enriched_payload
    return enriched.select(F.col("spine.game_pk").cast("binary").alias("key"),
                           enriched_payload(enriched).cast("binary").alias("value"),
                           F.lit(topic).alias("topic"), *keep)
