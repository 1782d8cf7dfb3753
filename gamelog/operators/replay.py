"""Replay: ordered history of games, a release schedule, and republishing into the raw log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gamelog.functions.cols import seconds_between
from gamelog.functions.scan import by_size, ordered_scan, time_chunk
from gamelog.operators.payload import payload_to_pitch
from gamelog.sources.logs import LOG_PARTITIONS, encode_pitches
from gamelog.sources.schemas import REPLAYED

REPLAY_ORDER = ["event_time", "event_id"]
CHUNK_SECONDS = 3600  # a game's events of an hour are scanned together


def check_speed(speed: float) -> float:
    if speed <= 0:
        raise ValueError(f"speed must be > 0, got {speed}")
    return speed


def ordered_history(events: DataFrame, game_pk: str | None = None, since=None,
                    until=None) -> DataFrame:
    """Pitches of one game in (event_time, event_id) order, or of all games unordered (their order is
    ``seq`` of ``replay_sequence``); the bounds are inclusive and only added when given, so they
    stay pushed to the scan."""
    rows = events.filter(F.col("event_type") == "pitch")
    if game_pk is not None:
        rows = rows.filter(F.col("game_pk") == game_pk)
    if since is not None:
        rows = rows.filter(F.col("event_time") >= F.lit(since))
    if until is not None:
        rows = rows.filter(F.col("event_time") <= F.lit(until))
    return rows if game_pk is None else rows.orderBy(*REPLAY_ORDER)


def replay_sequence(events: DataFrame, game_pk: str | None = None, since=None,
                    until=None, sizes: DataFrame | None = None) -> DataFrame:
    """History with ``seq``, the 0-based replay position inside each game (copies of an event share one).

    ``sizes`` (see ``ordered_scan``): the events of a game that is not large are numbered as they are, in one
    shuffle; for a large one, only the keys travel through the scan, and the events are joined back.
    """
    rows = ordered_history(events, game_pk, since, until)
    if sizes is None:
        return _numbered_by_keys(rows)
    small, large = by_size(rows, ["game_pk"], sizes)
    w = Window.partitionBy("game_pk").orderBy(*REPLAY_ORDER)
    # events without a time or an id take positions but are left out, as by the join of the large games
    numbered = small.withColumn("seq", (F.dense_rank().over(w) - 1).cast("long")).dropna(subset=["game_pk", *REPLAY_ORDER])
    return numbered.unionByName(_numbered_by_keys(large))


def _numbered_by_keys(rows: DataFrame) -> DataFrame:
    keys = ordered_scan(rows.select("game_pk", *REPLAY_ORDER).distinct(), ["game_pk"], REPLAY_ORDER,
                        time_chunk("event_time", CHUNK_SECONDS), ordinal="seq")
    return rows.join(keys, ["game_pk", *REPLAY_ORDER])


def replay_schedule(events: DataFrame, speed: float = 1.0, game_pk: str | None = None,
                    since=None, until=None) -> DataFrame:
    """When each event is due in a paced replay.

    ``wait_s`` = max(gap to the previous event / speed, 0), NULL for a game's first event;
    ``release_offset_s`` = running sum of the waits. Gaps are never negative in replay
    order, so the running sum is (event_time - first event_time) / speed.
    """
    check_speed(speed)
    # only the keys travel through the scan, not the wide payload
    rows = ordered_history(events, game_pk, since, until).select("game_pk", *REPLAY_ORDER)
    out = ordered_scan(rows, ["game_pk"], REPLAY_ORDER, time_chunk("event_time", CHUNK_SECONDS),
                       prev=["event_time"], first=["event_time"], ordinal="seq")
    gap = seconds_between(F.col("event_time"), F.col("prev_event_time"))
    return out.select(
        "game_pk", "event_id", "event_time", "seq",
        F.when(F.col("prev_event_time").isNotNull(),
               F.greatest(gap / F.lit(float(speed)), F.lit(0.0))).alias("wait_s"),
        (seconds_between(F.col("event_time"), F.col("first_event_time")) / F.lit(float(speed)))
        .alias("release_offset_s"),
    )


def republish(events: DataFrame, topic: str, game_pk: str | None = None, since=None,
              until=None, sizes: DataFrame | None = None) -> DataFrame:
    """Rebuild each pitch from its stored payload (original ids and times kept) and encode
    it as a log record keyed by game. The log partition follows from the key and the offset is the
    replay position, so that the written log keeps each game's order; ``count()`` of the result is
    the number republished. Repeats are absorbed downstream by insert-if-new; the records are labelled as
    a replay, so that the enricher and the latencies can leave them out (``validate.live_records``)."""
    rows = replay_sequence(events, game_pk, since, until, sizes)
    pitches = payload_to_pitch(rows.select("game_pk", "seq", "payload").withColumnRenamed(
        "game_pk", "_game"))
    pitches = pitches.withColumn("game_pk", F.coalesce(F.col("game_pk"), F.col("_game")))
    return (encode_pitches(pitches, topic, keep=("seq",), source=REPLAYED)
            .withColumn("partition", F.pmod(F.xxhash64("key"), F.lit(LOG_PARTITIONS)).cast("int"))
            .withColumnRenamed("seq", "offset"))
