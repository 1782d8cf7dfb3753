"""Queries over the raw log: decode/validate, dead letters, writes, payload codec,
rolling context, and log-side counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gamelog.functions.cols import evaluate_once
from gamelog.functions.times import to_ntz
from gamelog.operators import enrich, metrics, payload, replay, validate, writes
from gamelog.plans.oracle import EV_CTE, EVENT_TYPE_NUMBER_SQL, LOG_CTES
from gamelog.plans.registry import FIXED_NOW_ISO, register
from gamelog.sources import logs
from gamelog.sources import testdata as td
from gamelog.sources.schemas import PITCH_FIELDS, REPLAYED, SPINE_FIELDS


def validated(spark: SparkSession, sf: str) -> DataFrame:
    return validate.validate(logs.decode_pitches(td.raw_log(spark, sf)))


def good(spark: SparkSession, sf: str) -> DataFrame:
    return validate.good_records(validated(spark, sf))


def keyed(rows: DataFrame) -> DataFrame:
    """Good records have an id; said in so many words, joins need no filter of their own that tells one reader
    of the log from another."""
    return rows.filter(F.col("event_id").isNotNull())


def _games(log: DataFrame) -> DataFrame:
    """The game of each record: a log is keyed by game, so that its keys tell how large games are without decoding."""
    return log.select(F.col("key").cast("string").alias("game_pk"))


def _times_ntz(df: DataFrame, cols=("event_time", "source_time", "ingest_time")) -> DataFrame:
    for c in cols:
        if c in df.columns:
            df = df.withColumn(c, to_ntz(F.col(c)))
    return df


# ------------------------------------------------------------ V1-V6


@register("spine_reasons", f"""
WITH {LOG_CTES}
SELECT partition, "offset", decoded, error_kind, error_message FROM cl""")
def q_spine_reasons(spark, sf):
    return validated(spark, sf).select("partition", "offset", "decoded", "error_kind",
                                       "error_message")


@register("error_classes", f"""
WITH {LOG_CTES}
SELECT error_kind, error_class, count(*) AS records FROM cl GROUP BY error_kind, error_class""")
def q_error_classes(spark, sf):
    return validated(spark, sf).groupBy("error_kind", "error_class").agg(
        F.count(F.lit(1)).alias("records"))


@register("dead_letter_envelopes", f"""
WITH {LOG_CTES}
SELECT r_key AS key_text, to_base64(encode(coalesce(value_text, ''))) AS original_payload_b64,
       error_class, error_message, topic AS source_topic, partition AS source_partition,
       "offset" AS source_offset, '{FIXED_NOW_ISO}' AS first_seen_ts, 1 AS attempts
FROM (SELECT *, key_text AS r_key FROM cl) WHERE error_kind IS NOT NULL""")
def q_dead_letter_envelopes(spark, sf):
    bad = validate.bad_records(validated(spark, sf))
    letters = validate.dead_letters(bad, F.lit(FIXED_NOW_ISO))
    return letters.withColumn("key_text", F.col("key").cast("string")).drop("key")


@register("enrich_drop_count", f"""
WITH {LOG_CTES}
SELECT count(*) FILTER (WHERE decoded AND coalesce(game_pk, '') <> '') AS accepted,
       count(*) FILTER (WHERE NOT (decoded AND coalesce(game_pk, '') <> '')) AS dropped
FROM val""")
def q_enrich_drop_count(spark, sf):
    d = logs.decode_pitches(td.raw_log(spark, sf))
    ok = F.col("decoded") & (F.coalesce(F.col("game_pk"), F.lit("")) != "")
    return d.agg(F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("dropped"))


# ------------------------------------------------------------ P1-P7


@register("enum_names", f"""
WITH {LOG_CTES}
SELECT partition, "offset", event_type_number, event_type, sport_number, sport,
       {EVENT_TYPE_NUMBER_SQL} AS event_type_roundtrip
FROM cl WHERE decoded""")
def q_enum_names(spark, sf):
    from gamelog.functions.enums import event_type_number
    v = validated(spark, sf).filter(F.col("decoded"))
    return v.select("partition", "offset", "event_type_number", "event_type", "sport_number",
                    "sport", event_type_number(F.col("event_type")).alias("event_type_roundtrip"))


def _iso_plain_sql(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%dT%H:%M:%S') || '+00:00'"


@register("payload_json_fields", f"""
WITH {LOG_CTES}
SELECT event_id, 'pitch' AS p_event_type, 'mlb' AS p_sport,
       {_iso_plain_sql('event_time')} AS p_event_time,
       {_iso_plain_sql('ingest_time')} AS p_ingest_time,
       CAST(at_bat_index AS VARCHAR) AS p_at_bat_index,
       CAST(inning AS VARCHAR) AS p_inning, CAST(outs AS VARCHAR) AS p_outs,
       inning IS NOT NULL AS has_inning, pitch_type AS p_pitch_type,
       defect IN (11, 12, 14, 15) AS has_raw_payload,
       CASE defect WHEN 11 THEN '{{"a":null,"b":[1,2.5]}}' END AS p_raw_k, partition, "offset"
FROM good""")
def q_payload_json_fields(spark, sf):
    g = good(spark, sf)
    p = g.select("partition", "offset", "event_id", payload.pitch_payload(g).alias("payload"))
    p = evaluate_once(p, F.try_parse_json("payload"), "_j")  # one parse, many fields
    j = lambda path: F.try_variant_get("_j", path, "string")
    return p.select(
        "event_id", j("$.event_type").alias("p_event_type"), j("$.sport").alias("p_sport"),
        j("$.event_time").alias("p_event_time"), j("$.ingest_time").alias("p_ingest_time"),
        j("$.at_bat_index").alias("p_at_bat_index"), j("$.inning").alias("p_inning"),
        j("$.outs").alias("p_outs"), F.col("payload").contains('"inning":').alias("has_inning"),
        j("$.pitch_type").alias("p_pitch_type"),
        F.col("payload").contains('"raw_payload"').alias("has_raw_payload"),
        j("$.raw_payload.k").alias("p_raw_k"),
        "partition", "offset")


# pitch fields that the log's records never set, as SQL types
_SQL_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "string": "VARCHAR"}
UNSET_FIELDS = {n: _SQL_TYPES[t.simpleString()] for n, t in PITCH_FIELDS if n not in (
    "at_bat_index", "pitch_number", "inning", "outs", "pitch_type", "start_speed_mph", "raw_payload_json")}


@register("replay_roundtrip", f"""
WITH {LOG_CTES}
SELECT event_id, event_type, sport, game_pk, event_time, source_time, ingest_time,
       at_bat_index, pitch_number, inning, outs, pitch_type, start_speed_mph,
       {", ".join(f"NULL::{t} AS {n}" for n, t in UNSET_FIELDS.items())},
       CASE defect WHEN 11 THEN '{{"k":{{"a":null,"b":[1,2.5]}}}}' WHEN 15 THEN '[true,"x"]' END AS raw_payload_json
FROM good""")
def q_replay_roundtrip(spark, sf):
    g = good(spark, sf)
    rows = payload.events_row(g)
    back = payload.payload_to_pitch(rows)
    return _times_ntz(back.select(
        "event_id", "event_type", "sport", "game_pk", "event_time", "source_time",
        "ingest_time", "at_bat_index", "pitch_number", "inning", "outs", "pitch_type",
        "start_speed_mph", *UNSET_FIELDS, "raw_payload_json"))


@register("republish_records", f"""
WITH {LOG_CTES},
once AS (SELECT DISTINCT ON (event_id) * FROM good ORDER BY event_id, partition, "offset")
SELECT game_pk, event_id, event_time, at_bat_index, outs,
       row_number() OVER (PARTITION BY game_pk ORDER BY event_time, event_id) - 1 AS "offset"
FROM once""")
def q_republish_records(spark, sf):
    g = keyed(good(spark, sf))
    # the payload is made first: one text is sorted for the first arrivals, not forty columns
    rows = g.select("partition", "offset", *[F.col(c) for c in SPINE_FIELDS], payload.pitch_payload(g).alias("payload"))
    stored = writes.first_arrivals(rows).select(*SPINE_FIELDS, "payload")
    records = replay.republish(stored, "raw", sizes=_games(td.raw_log(spark, sf))).withColumn("timestamp", F.current_timestamp())
    back = validate.good_records(validate.validate(logs.decode_pitches(records)))
    return _times_ntz(back.select("game_pk", "event_id", "event_time", "at_bat_index", "outs", "offset"))


# ------------------------------------------------------------ W1-W4

EXISTING_CTE = """existing AS (
  SELECT 'mlb:' || CAST(o_orderkey AS VARCHAR) || ':pitch:1:'
         || CAST(CAST(floor(o_totalprice / 100000) AS INTEGER) AS VARCHAR) AS event_id
  FROM orders)"""


@register("insert_if_new", f"""
WITH {LOG_CTES}, {EXISTING_CTE},
firsts AS (SELECT DISTINCT ON (event_id) * FROM good ORDER BY event_id, partition, "offset")
SELECT event_id, event_type, sport, game_pk, event_time, source_time, ingest_time,
       partition, "offset"
FROM firsts WHERE event_id NOT IN (SELECT event_id FROM existing)""")
def q_insert_if_new(spark, sf):
    g = keyed(good(spark, sf)).select("event_id", "event_type", "sport", "game_pk", "event_time",
                                      "source_time", "ingest_time", "partition", "offset")
    new = writes.insert_if_new(g, td.existing_events(spark, sf))
    return _times_ntz(new)


@register("write_outcomes", f"""
WITH {LOG_CTES}, {EXISTING_CTE},
firsts AS (SELECT event_id, min((partition, "offset")) AS fp FROM good GROUP BY event_id)
SELECT g.partition, g."offset", g.event_id,
       CASE WHEN g.event_id NOT IN (SELECT event_id FROM existing)
                 AND (g.partition, g."offset") = f.fp THEN 'written' ELSE 'duplicate' END
         AS outcome
FROM good g JOIN firsts f ON g.event_id = f.event_id""")
def q_write_outcomes(spark, sf):
    g = keyed(good(spark, sf)).select("partition", "offset", "event_id")
    return writes.write_outcomes(g, td.existing_events(spark, sf)).select(
        "partition", "offset", "event_id", "outcome")


# ------------------------------------------------------------ N1-N5

STORED_CTE = """stored AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS game_pk,
         CAST(floor(o_totalprice / 100000) AS INTEGER) AS home_score,
         CAST(length(o_orderpriority) AS INTEGER) AS away_score,
         o_orderpriority = '1-URGENT' AS runner_on_first, FALSE AS runner_on_second,
         o_orderpriority IN ('1-URGENT', '2-HIGH') AS runner_on_third,
         CAST(month(o_orderdate) AS INTEGER) AS inning, 0 AS outs
  FROM orders WHERE o_orderstatus = 'F')"""

ROLLING_CTE = f"""{STORED_CTE},
acc AS (SELECT * FROM val WHERE decoded AND coalesce(game_pk, '') <> ''),
ctx AS (
  SELECT a.partition, a."offset", a.game_pk, a.event_id, a.at_bat_index, a.pitch_number,
    a.event_time, a.source_time, a.ingest_time, a.inning, a.outs,
    coalesce(last_value(a.inning IGNORE NULLS) OVER w, s.inning, 0) AS ctx_inning,
    coalesce(last_value(a.outs IGNORE NULLS) OVER w, s.outs, 0) AS ctx_outs,
    coalesce(last_value(a.inning IGNORE NULLS) OVER wb, s.inning, 0) AS b_inning,
    coalesce(last_value(a.outs IGNORE NULLS) OVER wb, s.outs, 0) AS b_outs,
    coalesce(s.home_score, 0) AS home_score, coalesce(s.away_score, 0) AS away_score,
    coalesce(s.runner_on_first, FALSE) AS runner_on_first,
    coalesce(s.runner_on_second, FALSE) AS runner_on_second,
    coalesce(s.runner_on_third, FALSE) AS runner_on_third
  FROM acc a LEFT JOIN stored s ON s.game_pk = a.game_pk
  WINDOW w AS (PARTITION BY a.game_pk ORDER BY a.partition, a."offset"
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         wb AS (PARTITION BY a.game_pk ORDER BY a.partition, a."offset"
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _ctx(spark, sf, *columns):
    """Context after each pitch; ``columns`` are those of the log wanted (none: all)."""
    raw = td.raw_log(spark, sf)
    acc = validate.enrichable(logs.decode_pitches(raw))
    if columns:
        acc = acc.select(*columns)
    return enrich.rolling_context(acc, td.stored_context(spark, sf), chunk_rows=1 << 25, sizes=_games(raw))


# what the scan itself reads
SCANNED = ("game_pk", *enrich.ARRIVAL, *enrich.ROLLING)


@register("rolling_context", f"""
WITH {LOG_CTES}, {ROLLING_CTE}
SELECT partition, "offset", game_pk, ctx_inning, ctx_outs, home_score, away_score,
       runner_on_first, runner_on_third,
       ctx_inning IS DISTINCT FROM b_inning OR ctx_outs IS DISTINCT FROM b_outs AS changed
FROM ctx""")
def q_rolling_context(spark, sf):
    c = _ctx(spark, sf, *SCANNED)
    return c.select("partition", "offset", "game_pk", "ctx_inning", "ctx_outs",
                    F.col("ctx_home_score").alias("home_score"),
                    F.col("ctx_away_score").alias("away_score"),
                    F.col("ctx_runner_on_first").alias("runner_on_first"),
                    F.col("ctx_runner_on_third").alias("runner_on_third"), "changed")


@register("context_changes", f"""
WITH {LOG_CTES}, {ROLLING_CTE}
SELECT game_pk, partition, "offset", home_score, away_score, runner_on_first,
       runner_on_second, runner_on_third, ctx_inning AS inning, ctx_outs AS outs
FROM ctx WHERE ctx_inning IS DISTINCT FROM b_inning OR ctx_outs IS DISTINCT FROM b_outs""")
def q_context_changes(spark, sf):
    return enrich.context_changes(_ctx(spark, sf, *SCANNED))


@register("game_context_snapshot", f"""
WITH {LOG_CTES}, {ROLLING_CTE},
last AS (SELECT DISTINCT ON (game_pk) game_pk, home_score, away_score, runner_on_first,
                runner_on_second, runner_on_third, ctx_inning AS inning, ctx_outs AS outs
         FROM ctx ORDER BY game_pk, partition DESC, "offset" DESC)
SELECT * FROM last
UNION ALL
SELECT * FROM stored WHERE game_pk NOT IN (SELECT game_pk FROM last)""")
def q_game_context_snapshot(spark, sf):
    acc = validate.enrichable(logs.decode_pitches(td.raw_log(spark, sf)))
    return enrich.newest_context(acc, td.stored_context(spark, sf))


@register("enriched_rows", f"""
WITH {LOG_CTES}, {ROLLING_CTE}
SELECT partition, "offset",
       'mlb:' || game_pk || ':pitch:' || CAST(coalesce(at_bat_index, 0) AS VARCHAR) || ':'
         || CAST(coalesce(pitch_number, 0) AS VARCHAR) AS enriched_id,
       coalesce(event_time, TIMESTAMP '1970-01-01 00:00:00') AS enriched_event_time,
       event_id AS pitch_event_id, home_score, away_score, runner_on_first, runner_on_second,
       runner_on_third, ctx_inning AS context_inning, ctx_outs AS context_outs
FROM ctx""")
def q_enriched_rows(spark, sf):
    e = enrich.enriched_rows(_ctx(spark, sf))
    return e.select("partition", "offset", F.col("spine.event_id").alias("enriched_id"),
                    to_ntz(F.col("spine.event_time")).alias("enriched_event_time"),
                    F.col("pitch.event_id").alias("pitch_event_id"), "home_score", "away_score",
                    "runner_on_first", "runner_on_second", "runner_on_third", "context_inning",
                    "context_outs")


# what is read back of an enriched event, each field as its text
ENRICHED_TEXTS = """event_id string, event_time string, home_score string, runner_on_first string,
pitch struct<spine: struct<event_id: string>, at_bat_index: string, inning: string, outs: string, pitch_type: string,
             start_speed_mph: string>"""


@register("enriched_log_values", f"""
WITH {LOG_CTES}, {ROLLING_CTE}
SELECT c.partition, c."offset", c.game_pk AS key_text,
       'mlb:' || c.game_pk || ':pitch:' || CAST(coalesce(c.at_bat_index, 0) AS VARCHAR) || ':'
         || CAST(coalesce(c.pitch_number, 0) AS VARCHAR) AS event_id,
       c.event_id AS pitch_event_id, strftime(coalesce(c.event_time, TIMESTAMP '1970-01-01'), '%Y-%m-%dT%H:%M:%S') || '+00:00'
         AS event_time, CAST(c.at_bat_index AS VARCHAR) AS at_bat_index, CAST(c.inning AS VARCHAR) AS inning,
       CAST(c.outs AS VARCHAR) AS outs, v.pitch_type, CAST(v.start_speed_mph AS VARCHAR) AS start_speed_mph,
       CAST(home_score AS VARCHAR) AS home_score, CAST(runner_on_first AS VARCHAR) AS runner_on_first
FROM ctx c JOIN val v USING (partition, "offset")""")
def q_enriched_log_values(spark, sf):
    records = enrich.enriched_log_records(enrich.enriched_rows(_ctx(spark, sf)), "enriched", keep=enrich.ARRIVAL)
    paths = {"event_id": "$.event_id", "pitch_event_id": "$.pitch.spine.event_id", "event_time": "$.event_time",
             "at_bat_index": "$.pitch.at_bat_index", "inning": "$.pitch.inning", "outs": "$.pitch.outs",
             "pitch_type": "$.pitch.pitch_type", "start_speed_mph": "$.pitch.start_speed_mph",
             "home_score": "$.home_score", "runner_on_first": "$.runner_on_first"}
    records = evaluate_once(records, F.from_json(F.col("value").cast("string"), ENRICHED_TEXTS), "_j")  # one parse, many fields
    return records.select("partition", "offset", F.col("key").cast("string").alias("key_text"),
                          *[F.col(p.replace("$", "_j")).alias(n) for n, p in paths.items()])


# ------------------------------------------------------------ M1-M3, M7 on the log


@register("outcome_counts", f"""
WITH {LOG_CTES}, {EXISTING_CTE},
firsts AS (SELECT event_id, min((partition, "offset")) AS fp FROM good GROUP BY event_id),
o AS (SELECT CASE WHEN g.event_id NOT IN (SELECT event_id FROM existing)
                       AND (g.partition, g."offset") = f.fp THEN 'written' ELSE 'duplicate' END
               AS outcome
      FROM good g JOIN firsts f ON g.event_id = f.event_id
      UNION ALL SELECT 'dlq' FROM cl WHERE error_kind IS NOT NULL)
SELECT outcome, count(*) AS messages FROM o GROUP BY outcome""")
def q_outcome_counts(spark, sf):
    return metrics.outcome_counts(validated(spark, sf), td.existing_events(spark, sf))


@register("dlq_counts", f"""
WITH {LOG_CTES}
SELECT error_class, count(*) AS dead_letters FROM cl WHERE error_kind IS NOT NULL
GROUP BY error_class""")
def q_dlq_counts(spark, sf):
    v = validated(spark, sf)
    return metrics.dead_letter_counts(validate.dead_letters(validate.bad_records(v), F.lit(FIXED_NOW_ISO)))


@register("published_counts", f"""
WITH {LOG_CTES}
SELECT event_type, count(*) AS published FROM good GROUP BY event_type""")
def q_published_counts(spark, sf):
    return metrics.published_counts(good(spark, sf))


@register("duplicate_audit", f"""
WITH {LOG_CTES}
SELECT event_id, count(*) AS copies FROM good GROUP BY event_id HAVING count(*) > 1""")
def q_duplicate_audit(spark, sf):
    return metrics.duplicate_audit(good(spark, sf))


@register("gap_audit", f"""
WITH {LOG_CTES},
d AS (SELECT DISTINCT game_pk, at_bat_index, pitch_number FROM good),
p AS (SELECT *, lag(pitch_number) OVER (PARTITION BY game_pk, at_bat_index
                                        ORDER BY pitch_number) AS prev FROM d)
SELECT game_pk, at_bat_index, prev AS after, pitch_number AS before,
       CAST(pitch_number - prev - 1 AS BIGINT) AS missing
FROM p WHERE prev IS NOT NULL AND pitch_number - prev > 1""")
def q_gap_audit(spark, sf):
    return metrics.gap_audit(good(spark, sf))



# ------------------------------------------------------------ publish results, transient errors, names, replays


@register("publish_results", f"""
WITH {LOG_CTES}
SELECT coalesce(event_type, 'unknown') AS event_type, count(*) FILTER (WHERE error_kind IS NULL) AS published,
       count(*) FILTER (WHERE error_kind IS NOT NULL) AS failed
FROM cl GROUP BY ALL""")
def q_publish_results(spark, sf):
    return metrics.publish_results(validated(spark, sf))


@register("retry_counts", f"""
WITH {LOG_CTES},
k AS (SELECT CASE WHEN error_message LIKE '%unknown_enum%' THEN 'lookup' ELSE error_kind END AS kind,
             coalesce(topic, '') AS topic FROM cl WHERE error_kind IS NOT NULL)
SELECT CASE WHEN kind = 'lookup' THEN 'TransientError' ELSE 'PoisonPillError' END AS error_class, kind AS error_kind,
       count(*) FILTER (WHERE kind <> 'lookup') AS dead_letters, count(*) FILTER (WHERE kind = 'lookup') AS retries
FROM k GROUP BY kind""")
def q_retry_counts(spark, sf):
    v = validate.validate(logs.decode_pitches(td.raw_log(spark, sf)), unknown_enum=validate.LOOKUP_KIND)
    # a kind has one class: counted first, so that both parts read the same few rows and the log is decoded once
    kinds = v.groupBy("error_kind").agg(F.max("error_class").alias("error_class"), F.count(F.lit(1)).alias("n"))
    parts = [part(kinds).select("error_class", "error_kind", (F.col("n") * d).alias("d"), (F.col("n") * (1 - d)).alias("r"))
             for part, d in ((validate.poison, 1), (validate.retryable, 0))]
    return parts[0].unionByName(parts[1]).groupBy("error_class", "error_kind").agg(
        F.sum("d").alias("dead_letters"), F.sum("r").alias("retries"))


@register("enum_name_errors", f"""
WITH {EV_CTE}
SELECT event_id, event_type, {EVENT_TYPE_NUMBER_SQL} AS event_type_number,
       CASE WHEN ({EVENT_TYPE_NUMBER_SQL}) IS NULL THEN 'unknown event_type ' || event_type END AS reason
FROM ev""")
def q_enum_name_errors(spark, sf):
    from gamelog.functions.enums import event_type_number
    ev = td.events_table(spark, sf)
    return ev.select("event_id", "event_type", event_type_number(F.col("event_type")).alias("event_type_number"),
                     validate.name_reason(ev).alias("reason"))


@register("live_context", f"""
WITH {LOG_CTES}, {ROLLING_CTE},
last AS (SELECT DISTINCT ON (game_pk) game_pk, home_score, away_score, runner_on_first,
                runner_on_second, runner_on_third, ctx_inning AS inning, ctx_outs AS outs
         FROM ctx ORDER BY game_pk, partition DESC, "offset" DESC)
SELECT * FROM last
UNION ALL
SELECT * FROM stored WHERE game_pk NOT IN (SELECT game_pk FROM last)""")
def q_live_context(spark, sf):
    raw = td.raw_log(spark, sf)
    # every event again, later in the log and with other values, as a replay
    again = good(spark, sf).withColumn("inning", F.lit(99)).withColumn("outs", F.lit(9)).withColumn(
        "offset", F.col("offset") + F.lit(1 << 60))
    replayed = logs.encode_pitches(again, "raw", keep=("partition", "offset", "timestamp"), source=REPLAYED)
    both = raw.unionByName(replayed.select(*raw.columns))
    acc = validate.enrichable(validate.live_records(logs.decode_pitches(both)))
    return enrich.newest_context(acc, td.stored_context(spark, sf))
