"""Nested JSON documents -> typed rows: schedules to live game keys, feeds to pitches and
game states. Pure projections and explodes: no shuffle, so documents are processed where
they land."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gamelog.functions.cols import as_col, blank_to_null, evaluate_once, zero_to_null
from gamelog.functions.ids import event_id
from gamelog.functions.times import iso_utc, iso_utc_plain, parse_upstream_time
from gamelog.sources.schemas import FEED, LIVE_STATUS_CODES, PLAY_EVENT, SCHEDULE

# ---------------------------------------------------------------- schedule (S1-S5)


def schedule_games(docs: DataFrame, value_col: str = "value") -> DataFrame:
    """Flatten ``dates[].games[]``; absent lists contribute no rows."""
    d = docs.select(F.from_json(F.col(value_col), SCHEDULE).alias("s"))
    day = d.select(F.explode("s.dates").alias("day"))
    g = day.select(F.explode("day.games").alias("g"))
    return g.select(F.col("g.gamePk").alias("game_pk_raw"),
                    F.col("g.status.statusCode").alias("status_code"),
                    F.col("g.status.abstractGameState").alias("abstract_state"))


def is_live(status_code: Column, abstract_state: Column) -> Column:
    """In-progress code family, or abstract state 'Live'; absent values never match."""
    return (F.coalesce(status_code, F.lit("")).isin(*LIVE_STATUS_CODES)
            | (F.coalesce(abstract_state, F.lit("")) == "Live"))


def with_live_flag(games: DataFrame) -> DataFrame:
    return games.withColumn("live", is_live(F.col("status_code"), F.col("abstract_state")))


def live_game_keys(games: DataFrame) -> DataFrame:
    """Distinct live game keys as text; an absent or zero key is skipped."""
    g = with_live_flag(games)
    return (g.filter(F.col("live") & zero_to_null(F.col("game_pk_raw")).isNotNull())
            .select(F.col("game_pk_raw").cast("string").alias("game_pk")).distinct())


def newly_live(live_keys: DataFrame, tracked: DataFrame) -> DataFrame:
    """Live keys not tracked yet (set difference as an anti join)."""
    return live_keys.join(tracked.select("game_pk"), "game_pk", "left_anti")


def live_counts(games: DataFrame) -> DataFrame:
    g = with_live_flag(games)
    return g.agg(F.count(F.lit(1)).alias("total_games"),
                 F.count_if(F.col("live")).alias("live_games"))


# ---------------------------------------------------------------- live feed (E1-E3)


def _game_pk(f: str = "f") -> Column:
    """First truthy of gamePk and gameData.game.pk, as text; '' when both are absent/0."""
    pk = F.coalesce(zero_to_null(F.col(f"{f}.gamePk")), zero_to_null(F.col(f"{f}.gameData.game.pk")))
    return F.coalesce(pk.cast("string"), F.lit(""))


def parse_feeds(feeds: DataFrame, value_col: str = "value") -> DataFrame:
    """Each feed document parsed once, its play events kept as their own JSON texts."""
    parsed = evaluate_once(feeds, F.from_json(F.col(value_col), FEED), "f")
    return parsed.drop(value_col)


def extract_pitches(feeds: DataFrame, now, value_col: str = "value") -> DataFrame:
    """Every pitch of every feed document, in feed order.

    Plays without atBatIndex and events that are not pitches (isPitch not true) are skipped;
    pitch_number falls back to index, and the event is skipped when both are absent;
    event_time falls back to the feed's metadata time, which falls back to ``now``.
    ``play_pos`` / ``event_pos`` keep the feed order; ``raw_payload_json`` is the event's own
    JSON text. ``valid`` is False when the spine check fails (only an empty game key can).
    """
    now = as_col(now).cast("timestamp")
    p = parse_feeds(feeds, value_col)
    meta_ts = F.coalesce(parse_upstream_time(F.col("f.metaData.timeStamp")), now)
    own = [c for c in feeds.columns if c != value_col]
    # a row carries its play, and then its event, but never the document
    plays = p.select(*own, _game_pk().alias("game_pk"), meta_ts.alias("_meta_ts"),
                     F.posexplode(F.col("f.liveData.plays.allPlays")).alias("play_pos", "play"))
    plays = plays.filter(F.col("play.about.atBatIndex").isNotNull()).select(
        *own, "game_pk", "_meta_ts", "play_pos", F.struct("play.about", "play.matchup").alias("play"),
        F.posexplode(F.col("play.playEvents")).alias("event_pos", "raw_payload_json"))
    return _pitch_rows(plays, own, now)


def extract_new_pitches(feeds: DataFrame, cursors: DataFrame, now, value_col: str = "value") -> DataFrame:
    """The pitches of ``extract_pitches`` after the cursor of their game.

    Feeds are cumulative: each poll repeats the whole game. The cursor is applied to the arrays of a
    document, before anything is made a row: plays of earlier at-bats go, the cursor's own at-bat
    keeps the events behind it, and only those are exploded and parsed. A game without a cursor
    keeps all. ``cursors``: game_pk, last_at_bat_index, last_pitch_number, one row per game.
    """
    now = as_col(now).cast("timestamp")
    own = [c for c in feeds.columns if c != value_col]
    p = parse_feeds(feeds, value_col)
    meta_ts = F.coalesce(parse_upstream_time(F.col("f.metaData.timeStamp")), now)
    docs = p.select(*own, _game_pk().alias("game_pk"), meta_ts.alias("_meta_ts"),
                    F.col("f.liveData.plays.allPlays").alias("_plays"))
    docs = docs.join(cursors.select("game_pk", F.col("last_at_bat_index").alias("_ab"),
                                    F.col("last_pitch_number").alias("_n")), "game_pk", "left")

    def number(e: Column) -> Column:
        text = e["raw_payload_json"]
        return F.coalesce(F.get_json_object(text, "$.pitchNumber"), F.get_json_object(text, "$.index")).cast("int")

    def new_events(play: Column) -> Column:
        at = play["about"]["atBatIndex"]
        placed = F.transform(play["playEvents"], lambda e, i: F.struct(i.alias("event_pos"), e.alias("raw_payload_json")))
        return (F.when(F.col("_ab").isNull() | (at > F.col("_ab")), placed)
                .when(at == F.col("_ab"), F.filter(placed, lambda e: number(e) > F.col("_n"))))

    tail = F.filter(F.transform("_plays", lambda play, i: F.struct(
        i.alias("play_pos"), F.struct(play["about"].alias("about"), play["matchup"].alias("matchup")).alias("play"),
        F.when(play["about"]["atBatIndex"].isNotNull(), new_events(play)).alias("events"))),
        lambda x: F.coalesce(F.size(x["events"]), F.lit(0)) > 0)
    plays = docs.select(*own, "game_pk", "_meta_ts", F.explode(tail).alias("t")).select(
        *own, "game_pk", "_meta_ts", "t.play_pos", "t.play", F.explode("t.events").alias("e")).select(
        *own, "game_pk", "_meta_ts", "play_pos", "play", "e.event_pos", "e.raw_payload_json")
    return _pitch_rows(plays, own, now)


def pitch_count(feeds: DataFrame, value_col: str = "value") -> DataFrame:
    """``pitches``: how many pitches with a game key the documents hold, counted inside the arrays."""
    def is_pitch(e: Column) -> Column:
        return (F.coalesce(F.get_json_object(e, "$.isPitch") == "true", F.lit(False))
                & F.coalesce(F.get_json_object(e, "$.pitchNumber"), F.get_json_object(e, "$.index")).isNotNull())

    named = F.filter("f.liveData.plays.allPlays", lambda p: p["about"]["atBatIndex"].isNotNull())
    sizes = F.transform(named, lambda p: F.coalesce(F.size(F.filter(p["playEvents"], is_pitch)), F.lit(0)))
    total = F.aggregate(F.coalesce(sizes, F.array().cast("array<int>")), F.lit(0).cast("long"), lambda a, n: a + n)
    return parse_feeds(feeds, value_col).filter(_game_pk() != "").agg(F.coalesce(F.sum(total), F.lit(0)).alias("pitches"))


def _pitch_rows(plays: DataFrame, own: list[str], now: Column) -> DataFrame:
    """Pitch rows of play events (own, game_pk, _meta_ts, play_pos, play, event_pos, raw_payload_json)."""
    ev = evaluate_once(plays, F.from_json("raw_payload_json", PLAY_EVENT), "ev")
    pitch_number = F.coalesce(F.col("ev.pitchNumber"), F.col("ev.index"))
    ev = ev.filter(F.coalesce(F.col("ev.isPitch"), F.lit(False)) & pitch_number.isNotNull())
    ab, n = F.col("play.about.atBatIndex"), pitch_number
    out = ev.select(
        *own,
        event_id("pitch", F.col("game_pk"), ab, n).alias("event_id"),
        F.lit("pitch").alias("event_type"),
        F.lit("mlb").alias("sport"),
        F.col("game_pk"),
        F.coalesce(parse_upstream_time(F.col("ev.startTime")), F.col("_meta_ts")).alias("event_time"),
        F.col("_meta_ts").alias("source_time"),
        now.alias("ingest_time"),
        ab.alias("at_bat_index"),
        n.alias("pitch_number"),
        F.col("play.about.inning").alias("inning"),
        blank_to_null(F.lower(F.col("play.about.halfInning"))).alias("inning_half"),
        F.col("play.matchup.batter.id").alias("batter_id"),
        F.col("play.matchup.batter.fullName").alias("batter_name"),
        F.col("play.matchup.pitcher.id").alias("pitcher_id"),
        F.col("play.matchup.pitcher.fullName").alias("pitcher_name"),
        F.col("ev.details.type.code").alias("pitch_type"),
        F.col("ev.details.type.description").alias("pitch_type_description"),
        F.col("ev.pitchData.startSpeed").alias("start_speed_mph"),
        F.col("ev.pitchData.endSpeed").alias("end_speed_mph"),
        F.col("ev.pitchData.breaks.spinRate").alias("spin_rate_rpm"),
        F.col("ev.count.balls").alias("balls"),
        F.col("ev.count.strikes").alias("strikes"),
        F.col("ev.count.outs").alias("outs"),
        F.col("ev.details.call.code").alias("call_code"),
        F.col("ev.details.call.description").alias("call_description"),
        F.col("ev.details.isInPlay").alias("is_in_play"),
        F.col("ev.details.isStrike").alias("is_strike"),
        F.col("ev.details.isBall").alias("is_ball"),
        F.col("raw_payload_json"),
        F.col("play_pos"), F.col("event_pos"),
    )
    return out.withColumn("valid", F.col("game_pk") != "")


def _state_id_time(meta_text: Column, meta_ts: Column, now: Column) -> Column:
    """Time part of the game-state id: ISO of the metadata time (with +00:00 only when the
    upstream text carried an offset), else of ``now``."""
    has_offset = meta_text.rlike(r"(Z|[+-]\d\d:?\d\d)$")
    return F.when(meta_ts.isNull(), iso_utc(now)) \
        .when(has_offset, iso_utc(meta_ts)).otherwise(iso_utc_plain(meta_ts))


def extract_game_state(feeds: DataFrame, now, value_col: str = "value") -> DataFrame:
    """One game-state row per feed document; ``payload`` is the document's text."""
    now = as_col(now).cast("timestamp")
    text = F.col(value_col).alias("payload")
    p = evaluate_once(feeds.select(*[c for c in feeds.columns if c != value_col], text),
                      F.from_json(F.col("payload"), FEED), "f")
    meta_text = F.col("f.metaData.timeStamp")
    meta_ts = parse_upstream_time(meta_text)
    game_pk = _game_pk()
    return p.select(
        *[c for c in feeds.columns if c != value_col],
        F.concat(F.lit("mlb:"), game_pk, F.lit(":game:state:"),
                 _state_id_time(meta_text, meta_ts, now)).alias("event_id"),
        F.lit("game_state").alias("event_type"),
        F.lit("mlb").alias("sport"),
        game_pk.alias("game_pk"),
        F.coalesce(parse_upstream_time(F.col("f.gameData.datetime.dateTime")), now).alias("event_time"),
        F.coalesce(meta_ts, now).alias("source_time"),
        now.alias("ingest_time"),
        F.col("f.gameData.status.detailedState").alias("status"),
        F.col("f.gameData.teams.home.name").alias("home_team"),
        F.col("f.gameData.teams.away.name").alias("away_team"),
        F.col("f.liveData.linescore.teams.home.runs").alias("home_score"),
        F.col("f.liveData.linescore.teams.away.runs").alias("away_score"),
        F.col("f.liveData.linescore.currentInning").alias("inning"),
        blank_to_null(F.lower(F.col("f.liveData.linescore.inningHalf"))).alias("inning_half"),
        F.lit(None).cast("string").alias("raw_payload_json"),
        F.col("payload"),
    ).withColumn("valid", F.col("game_pk") != "")
