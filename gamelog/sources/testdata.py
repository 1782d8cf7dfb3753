"""Adapters: the driver's generated tables mapped into the engine's data model.

Every frame here is derived by Spark from the given tables, so the work of each query grows
with them. The mapping rules are plain formulas on one row (no row subsets), so the same rules
can be restated in SQL for the oracle (see ``gamelog.plans.oracle``).

- ``events_table`` / ``games_table``: the serving tables (events <- events, games <- customer).
- ``raw_log``: lineitem as pitch records in the shape of a keyed log (topic, partition,
  offset, key, value), with malformed records planted by rule to reach every dead-letter path.
- ``feed_documents``: live-feed JSON documents built from orders + lineitem, one document per
  order and chunk of at most ``FEED_CHUNK`` events, so no document grows with the data.
- ``schedule_documents``: schedule JSON documents over customer, ``SCHEDULE_CHUNK`` games each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gamelog.functions.scan import chunk_of, ordered_scan

# ---- fixed values: adapter rules ----
RAW_TOPIC = "raw"
RAW_PARTITIONS = 4
OFFSET_BITS = 28
FEED_CHUNK = 64
POLL_PLAYS = 4
POLL_NAMELESS = 7
SCHEDULE_CHUNK = 50
PART_STEP = 512  # part keys per chunk of an ordered scan of lineitems
GAME_STATUS_BY_SEGMENT = {
    "BUILDING": "In Progress",
    "MACHINERY": "Warmup",
    "FURNITURE": "Final",
    "AUTOMOBILE": "Postponed",
}
# l_quantity value -> planted defect of the raw record
RAW_DEFECTS = {
    1: "empty event_id",
    2: "unspecified event_type",
    3: "unspecified sport",
    4: "empty game_pk",
    5: "no event_time",
    6: "no source_time",
    7: "no ingest_time",
    8: "undecodable bytes",
    9: "null value",
    10: "unknown event_type number",
}
# l_quantity value -> raw JSON text of the record (as it stands inside the record's own JSON)
RAW_TEXTS = {11: '{"k":{"b":[1,2.5],"a":null}}', 12: "", 13: "{not json", 14: "null", 15: '[true,"x"]'}
EPOCH_2024 = "2024-01-01 00:00:00"
# ---- end of fixed values ----

LINEITEM_ORDER = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                  "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                  "l_shipdate"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _iso_z(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _text(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def _field(name: str, value: Column, quoted: bool = False) -> Column:
    """``,"name":value`` or '' when the value is NULL (absent optional field)."""
    v = _text(value) if quoted else value.cast("string")
    return F.coalesce(F.concat(F.lit(f',"{name}":'), v), F.lit(""))


# ---------------------------------------------------------------- serving tables


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> the events table: one game per user, purchases are the pitches."""
    ev = read_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    source_time = F.timestamp_add("SECOND", k, F.col("ts"))
    ingest_time = F.timestamp_add("MILLISECOND", F.floor(F.col("value") * 1000), source_time)
    return ev.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.when(F.col("event_type") == "purchase", F.lit("pitch"))
         .otherwise(F.col("event_type")).alias("event_type"),
        F.lit("mlb").alias("sport"),
        F.col("user_id").cast("string").alias("game_pk"),
        F.col("ts").alias("event_time"),
        source_time.alias("source_time"),
        ingest_time.alias("ingest_time"),
        F.col("props").alias("payload"),
    )


def _status_of_segment(seg: Column) -> Column:
    out = F.lit(None).cast("string")
    expr = None
    for segment, status in GAME_STATUS_BY_SEGMENT.items():
        expr = (F.when(seg == segment, F.lit(status)) if expr is None
                else expr.when(seg == segment, F.lit(status)))
    return expr.otherwise(out)


def games_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> the games table (nation 0 plays another sport)."""
    cu = read_table(spark, sf_dir, "customer")
    return cu.select(
        F.col("c_custkey").cast("string").alias("game_pk"),
        F.when(F.col("c_nationkey") == 0, F.lit("nfl")).otherwise(F.lit("mlb")).alias("sport"),
        _status_of_segment(F.col("c_mktsegment")).alias("status"),
        F.col("c_name").alias("home_team"),
        F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")).alias("away_team"),
        F.timestamp_add("MINUTE", F.col("c_custkey"), F.lit(EPOCH_2024).cast("timestamp_ntz"))
         .alias("start_time"),
        F.timestamp_add("SECOND", F.col("c_custkey"), F.lit(EPOCH_2024).cast("timestamp_ntz"))
         .alias("updated_at"),
        F.lit(None).cast("string").alias("payload"),
    )


# ---------------------------------------------------------------- raw log


def raw_fields(li: DataFrame) -> DataFrame:
    """Per lineitem row: the pitch fields and the planted defect, before wire encoding."""
    ship = F.col("l_shipdate")
    q = F.col("l_quantity").cast("int")
    return li.select(
        *LINEITEM_ORDER,
        F.pmod(F.col("l_orderkey"), F.lit(RAW_PARTITIONS)).cast("int").alias("partition"),
        F.col("l_orderkey").cast("string").alias("r_game_pk"),
        F.col("l_linenumber").alias("r_at_bat_index"),
        F.floor(F.col("l_quantity") / 10).cast("int").alias("r_pitch_number"),
        F.when(F.col("l_linestatus") != "O", F.floor(F.col("l_quantity") / 10).cast("int") + 1)
         .alias("r_inning"),
        F.when(F.col("l_returnflag") != "N", F.floor((F.col("l_linenumber") + 1) / 3).cast("int"))
         .alias("r_outs"),
        ship.alias("r_event_time"),
        F.timestamp_add("HOUR", F.lit(1), ship).alias("r_source_time"),
        F.timestamp_add("SECOND", F.col("l_linenumber"), F.timestamp_add("HOUR", F.lit(1), ship))
         .alias("r_ingest_time"),
        q.alias("defect"),
        log_offset().alias("offset"),
    )


def log_offset() -> Column:
    """Offset of a lineitem in the log (``RAW_CTE`` of the oracle has the same formula)."""
    text = F.concat_ws("|", "l_partkey", "l_suppkey", "l_linenumber",
                       F.round(F.col("l_extendedprice") * 100).cast("long"),
                       F.unix_seconds(F.col("l_shipdate").cast("timestamp")))
    low = F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")
    return F.col("l_orderkey") * F.lit(1 << OFFSET_BITS) + low


def _raw_text_sql() -> str:
    """Raw JSON text by quantity, quotes escaped for their place inside the record's JSON text."""
    whens = " ".join(f"WHEN {q} THEN replace('{t}', chr(34), concat(chr(92), chr(34)))" for q, t in RAW_TEXTS.items())
    return f"CASE defect {whens} END"


def _wire_value(r: DataFrame) -> DataFrame:
    """Encode a pitch record as wire JSON text (enum numbers, ISO-Z times)."""
    d = F.col("defect")
    pitch_id = F.concat_ws(":", F.lit("mlb"), F.col("r_game_pk"), F.lit("pitch"),
                           F.col("r_at_bat_index").cast("string"),
                           F.col("r_pitch_number").cast("string"))
    spine = F.concat(
        F.lit('{"spine":{"event_id":'), _text(F.when(d == 1, F.lit("")).otherwise(pitch_id)),
        F.lit(',"event_type":'),
        F.when(d == 2, F.lit("0")).when(d == 10, F.lit("99")).otherwise(F.lit("1")),
        F.lit(',"sport":'), F.when(d == 3, F.lit("0")).otherwise(F.lit("1")),
        F.lit(',"game_pk":'), _text(F.when(d == 4, F.lit("")).otherwise(F.col("r_game_pk"))),
        _field("event_time", F.when(d != 5, _iso_z(F.col("r_event_time"))), quoted=True),
        _field("source_time", F.when(d != 6, _iso_z(F.col("r_source_time"))), quoted=True),
        _field("ingest_time", F.when(d != 7, _iso_z(F.col("r_ingest_time"))), quoted=True),
        F.lit("}"),
    )
    body = F.concat(
        spine,
        F.lit(',"at_bat_index":'), F.col("r_at_bat_index").cast("string"),
        F.lit(',"pitch_number":'), F.col("r_pitch_number").cast("string"),
        _field("inning", F.col("r_inning")),
        _field("outs", F.col("r_outs")),
        _field("pitch_type", F.concat(F.col("l_returnflag"), F.col("l_linestatus")), quoted=True),
        _field("start_speed_mph", F.col("l_quantity").cast("int") + 60),
        _field("raw_payload_json", F.expr(_raw_text_sql()), quoted=True),
        F.lit("}"),
    )
    value = (F.when(d == 8, F.lit("not json {"))
             .when(d == 9, F.lit(None).cast("string")).otherwise(body))
    return r.withColumn("value_text", value)


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a keyed log: key = game, value = JSON pitch record, increasing offsets.

    An offset is a formula of the row, the order key above 28 bits of a hash of the other
    columns, so that the log needs no scan: games follow each other, and records of a game
    come in the order of their hashes.
    """
    r = _wire_value(raw_fields(read_table(spark, sf_dir, "lineitem")))
    return r.select(
        F.col("r_game_pk").cast("binary").alias("key"),
        F.col("value_text").cast("binary").alias("value"),
        F.lit(RAW_TOPIC).alias("topic"),
        F.col("partition"),
        F.col("offset"),
        F.col("r_ingest_time").cast("timestamp").alias("timestamp"),
    )


# ---------------------------------------------------------------- feed documents


def _play_event(li_pos: Column) -> Column:
    ret, stat = F.col("l_returnflag"), F.col("l_linestatus")
    is_pitch = (F.when((ret == "N") & (stat == "O"), F.lit(None).cast("boolean"))
                .otherwise(ret != "N"))
    pitch_number = F.when(~((ret == "R") & (stat == "F")), F.col("l_linenumber"))
    index = F.when(~((ret == "R") & (stat == "F") & (F.col("l_quantity") > 45)),
                   F.col("l_linenumber") - 1)
    start_time = F.when(stat != "O", _iso_z(F.col("l_shipdate")))
    start_speed = F.lit(70.0) + F.col("l_quantity") / 2
    return F.struct(
        li_pos.alias("pos"),
        is_pitch.alias("isPitch"),
        pitch_number.cast("int").alias("pitchNumber"),
        index.cast("int").alias("index"),
        start_time.alias("startTime"),
        F.struct(
            F.struct(F.concat(ret, stat).alias("code"),
                     F.when(ret != "A", F.concat(F.lit("type "), ret)).alias("description"))
             .alias("type"),
            F.struct(stat.alias("code"),
                     F.when(stat == "F", F.lit("Called")).alias("description")).alias("call"),
            F.when(F.col("l_discount") > 0.02, F.col("l_discount") > 0.05).alias("isInPlay"),
            (F.col("l_tax") > 0.04).alias("isStrike"),
            F.when(F.col("l_tax") > 0, F.col("l_tax") <= 0.04).alias("isBall"),
        ).alias("details"),
        F.struct(F.least(F.col("l_linenumber") - 1, F.lit(3)).cast("int").alias("balls"),
                 F.least(F.floor(F.col("l_quantity") / 20), F.lit(2)).cast("int").alias("strikes"),
                 F.floor((F.col("l_linenumber") + 1) / 3).cast("int").alias("outs"))
         .alias("count"),
        F.struct(start_speed.alias("startSpeed"),
                 F.when(F.col("l_discount") <= 0.05, start_speed - 8).alias("endSpeed"),
                 F.struct(F.when(ret != "R", F.col("l_partkey").cast("double")).alias("spinRate"))
                  .alias("breaks")).alias("pitchData"),
    )


def _order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The playEvents of each order (its lineitems in a total column order), ``FEED_CHUNK`` at a time."""
    li = read_table(spark, sf_dir, "lineitem")
    li = ordered_scan(li, ["l_orderkey"], LINEITEM_ORDER, chunk_of("l_partkey", PART_STEP), ordinal="li_pos", sizes=li)
    li = li.withColumn("chunk", F.floor(F.col("li_pos") / FEED_CHUNK))
    events = (li.groupBy("l_orderkey", "chunk")
              .agg(F.collect_list(_play_event(F.col("li_pos"))).alias("evs")))
    return events.withColumn("evs", F.transform(F.array_sort("evs"), lambda e: e.dropFields("pos")))


def poll_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders + lineitem -> live-feed JSON text with several plays: a document for each
    ``POLL_PLAYS`` orders of a customer (game) and chunk of their events.

    A play is an order (atBatIndex = orderkey, absent for every ``POLL_NAMELESS``th key); the
    metadata time is the newest order date.
    """
    od = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    od = ordered_scan(od, ["o_custkey"], ["o_orderkey"], chunk_of("o_orderkey", 1 << 16), ordinal="o_pos", sizes=od)
    od = od.withColumn("part", F.floor(F.col("o_pos") / POLL_PLAYS))
    key = F.col("o_orderkey")
    play = F.struct(
        key.alias("order"),
        F.struct(F.when(key % POLL_NAMELESS != 0, key.cast("int")).alias("atBatIndex"),
                 (key % 9).cast("int").alias("inning"), F.lit("Top").alias("halfInning")).alias("about"),
        F.struct(F.struct((F.col("o_custkey") * 10).alias("id")).alias("batter")).alias("matchup"),
        F.col("evs").alias("playEvents"))
    doc = (_order_events(spark, sf_dir).join(od, F.col("l_orderkey") == key).groupBy("o_custkey", "part", "chunk")
           .agg(F.array_sort(F.collect_list(play)).alias("plays"), F.max("o_orderdate").alias("newest")))
    feed = F.struct(
        F.col("o_custkey").alias("gamePk"),
        F.struct(_iso_z(F.col("newest")).alias("timeStamp")).alias("metaData"),
        F.struct(F.struct(F.transform("plays", lambda p: p.dropFields("order")).alias("allPlays")).alias("plays"))
        .alias("liveData"))
    return doc.select(F.concat_ws("/", *[F.col(c).cast("string") for c in ("o_custkey", "part", "chunk")]).alias("doc_id"),
                      F.to_json(feed).alias("value"))


def feed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders + lineitem -> live-feed JSON text, one document per (order, chunk of events).

    gamePk = customer (absent for 5-LOW orders, so gameData.game.pk is used), one play per
    order (atBatIndex = orderkey), its lineitems are the playEvents in a total column order.
    """
    od = read_table(spark, sf_dir, "orders")
    events = _order_events(spark, sf_dir)
    doc = events.join(od, events.l_orderkey == od.o_orderkey)
    status = F.col("o_orderstatus")
    meta_ts = (F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(None).cast("string"))
               .when(status == "P", F.date_format("o_orderdate", "yyyyMMdd_HHmmss"))
               .otherwise(_iso_z(F.col("o_orderdate"))))
    half = F.when(status == "F", F.lit("Top")).when(status == "O", F.lit("Bottom")).otherwise("")
    feed = F.struct(
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey")).alias("gamePk"),
        F.struct(meta_ts.alias("timeStamp")).alias("metaData"),
        F.struct(
            F.struct(F.col("o_custkey").alias("pk")).alias("game"),
            F.struct(F.when(status == "O", F.lit("In Progress")).when(status == "F", F.lit("Final"))
                     .otherwise(F.lit("Warmup")).alias("detailedState")).alias("status"),
            F.struct(F.struct(F.concat(F.lit("Home "), F.col("o_custkey").cast("string"))
                              .alias("name")).alias("home"),
                     F.struct(F.concat(F.lit("Away "), F.col("o_orderpriority")).alias("name"))
                      .alias("away")).alias("teams"),
            F.struct(_iso_z(F.col("o_orderdate")).alias("dateTime")).alias("datetime"),
        ).alias("gameData"),
        F.struct(
            F.struct(
                (F.floor(F.col("o_totalprice") / 100000) + 1).cast("int").alias("currentInning"),
                half.alias("inningHalf"),
                F.struct(F.struct(F.length("o_orderpriority").alias("runs")).alias("home"),
                         F.struct(F.col("chunk").cast("int").alias("runs")).alias("away"))
                 .alias("teams")).alias("linescore"),
            F.struct(F.array(F.struct(
                F.struct(F.col("o_orderkey").cast("int").alias("atBatIndex"),
                         (F.floor(F.col("o_totalprice") / 100000) + 1).cast("int").alias("inning"),
                         half.alias("halfInning")).alias("about"),
                F.struct(F.struct((F.col("o_custkey") * 10).alias("id"),
                                  F.concat(F.lit("Batter "), F.col("o_custkey").cast("string"))
                                  .alias("fullName")).alias("batter"),
                         F.struct((F.col("o_orderkey") + 1000000).alias("id"),
                                  F.concat(F.lit("Pitcher "), F.col("o_orderkey").cast("string"))
                                  .alias("fullName")).alias("pitcher")).alias("matchup"),
                F.col("evs").alias("playEvents"),
            )).alias("allPlays")).alias("plays"),
        ).alias("liveData"),
    )
    return doc.select(
        F.concat_ws("/", F.col("o_orderkey").cast("string"), F.col("chunk").cast("string"))
         .alias("doc_id"),
        F.to_json(feed).alias("value"))


# ---------------------------------------------------------------- schedule documents


def schedule_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> schedule JSON text; customers are unique keys, so each document holds at
    most ``SCHEDULE_CHUNK`` games by construction."""
    cu = read_table(spark, sf_dir, "customer")
    seg = F.col("c_mktsegment")
    code = (F.when(seg == "BUILDING", F.lit("I")).when(seg == "MACHINERY", F.lit("P"))
            .when(seg == "FURNITURE", F.lit("F")).when(seg == "AUTOMOBILE", F.lit("IH")))
    abstract = (F.when(seg == "BUILDING", F.lit("Live")).when(seg == "MACHINERY", F.lit("Live"))
                .when(seg == "FURNITURE", F.lit("Final")))
    game = F.struct(
        F.when(F.col("c_acctbal") >= 0, F.col("c_custkey")).alias("gamePk"),
        F.when(seg != "HOUSEHOLD", F.struct(code.alias("statusCode"),
                                            abstract.alias("abstractGameState"))).alias("status"))
    docs = (cu.groupBy(F.floor(F.col("c_custkey") / SCHEDULE_CHUNK).alias("chunk"))
            .agg(F.collect_list(game).alias("games")))
    return docs.select(
        F.col("chunk").cast("string").alias("doc_id"),
        F.to_json(F.struct(F.array(F.struct(F.col("games"))).alias("dates"))).alias("value"))


# ---------------------------------------------------------------- prior state


def existing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events table as left by an earlier run: one pitch per order (ids overlap the log's)."""
    od = read_table(spark, sf_dir, "orders")
    return od.select(
        F.concat_ws(":", F.lit("mlb"), F.col("o_orderkey").cast("string"), F.lit("pitch"),
                    F.lit("1"), F.floor(F.col("o_totalprice") / 100000).cast("int").cast("string"))
        .alias("event_id"),
        F.lit("pitch").alias("event_type"), F.lit("mlb").alias("sport"),
        F.col("o_orderkey").cast("string").alias("game_pk"),
        F.col("o_orderdate").alias("event_time"), F.col("o_orderdate").alias("source_time"),
        F.col("o_orderdate").alias("ingest_time"), F.lit("{}").alias("payload"))


def stored_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enricher state stored earlier for the games (orders) that were already finished."""
    od = read_table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F")
    pr = F.col("o_orderpriority")
    return od.select(
        F.col("o_orderkey").cast("string").alias("game_pk"),
        F.floor(F.col("o_totalprice") / 100000).cast("int").alias("home_score"),
        F.length(pr).cast("int").alias("away_score"),
        (pr == "1-URGENT").alias("runner_on_first"),
        F.lit(False).alias("runner_on_second"),
        pr.isin("1-URGENT", "2-HIGH").alias("runner_on_third"),
        F.month("o_orderdate").cast("int").alias("inning"),
        F.lit(0).alias("outs"))


def cursor_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publish cursors left by an earlier run: per game (customer), up to pitch 3 of the
    customer's first finished order."""
    od = read_table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F")
    return od.groupBy("o_custkey").agg(F.min("o_orderkey").alias("k")).select(
        F.col("o_custkey").cast("string").alias("game_pk"),
        F.col("k").cast("int").alias("last_at_bat_index"),
        F.lit(3).alias("last_pitch_number"),
        F.timestamp_add("SECOND", F.col("o_custkey"), F.lit(EPOCH_2024).cast("timestamp_ntz"))
        .cast("timestamp").alias("updated_at"))


def tracked_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games already being polled: those the games table shows in progress."""
    return games_table(spark, sf_dir).filter(F.col("status") == "In Progress").select("game_pk")
