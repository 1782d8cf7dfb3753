"""Queries exercising the id rules (K1-K13) over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gamelog.functions import ids
from gamelog.functions.scan import chunk_of, ordered_scan
from gamelog.plans.registry import register
from gamelog.sources import testdata as td

_ORDER_SQL = ("l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
              "l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate")


def _s(c: str) -> str:
    return f"CAST({c} AS VARCHAR)"


@register("ids_all", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  'mlb:' || {_s('l_orderkey')} || ':pitch:' || {_s('l_linenumber')} || ':' || {_s('CAST(floor(l_quantity / 10) AS INTEGER)')} AS pitch_id,
  'mlb:' || {_s('l_orderkey')} || ':ab_start:' || {_s('l_linenumber')} AS atbat_start_id,
  'mlb:' || {_s('l_orderkey')} || ':ab_end:' || {_s('l_linenumber')} AS atbat_end_id,
  'mlb:' || {_s('l_orderkey')} || ':pickoff:' || {_s('l_linenumber')} || ':' || {_s('l_suppkey')} AS pickoff_id,
  'mlb:' || {_s('l_orderkey')} || ':mound_visit:' || {_s('l_linenumber')} || ':' || {_s('l_partkey')} AS mound_visit_id,
  'mlb:' || {_s('l_orderkey')} || ':pitching_change:' || {_s('l_linenumber')} || ':' || {_s('l_suppkey')} AS pitching_change_id,
  'mlb:' || {_s('l_orderkey')} || ':substitution:' || {_s('l_linenumber')} || ':' || {_s('l_partkey')} || ':' || {_s('l_suppkey')} AS substitution_id,
  'mlb:' || {_s('l_orderkey')} || ':defensive_shift:' || {_s('l_linenumber')} || ':' || {_s('CAST(floor(l_quantity / 10) AS INTEGER)')} AS defensive_shift_id,
  'mlb:' || {_s('l_orderkey')} || ':inning:' || {_s('CAST(floor(l_quantity / 10) AS INTEGER) + 1')} || ':'
    || CASE WHEN l_returnflag = 'A' THEN 'top' ELSE 'bottom' END || ':'
    || CASE WHEN l_linestatus = 'O' THEN 'start' ELSE 'end' END AS inning_state_id,
  'nfl:2024_' || {_s('l_orderkey')} || ':play:' || {_s('l_linenumber')} AS nfl_play_id
FROM lineitem""")
def q_ids_all(spark, sf):
    li = td.read_table(spark, sf, "lineitem")
    ok, ln, pk, sk = (F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    q10 = F.floor(F.col("l_quantity") / 10).cast("int")
    half = F.when(F.col("l_returnflag") == "A", F.lit("top")).otherwise(F.lit("bottom"))
    state = F.when(F.col("l_linestatus") == "O", F.lit("start")).otherwise(F.lit("end"))
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        ids.event_id("pitch", ok, ln, q10).alias("pitch_id"),
        ids.event_id("atbat_start", ok, ln).alias("atbat_start_id"),
        ids.event_id("atbat_end", ok, ln).alias("atbat_end_id"),
        ids.event_id("pickoff", ok, ln, sk).alias("pickoff_id"),
        ids.event_id("mound_visit", ok, ln, pk).alias("mound_visit_id"),
        ids.event_id("pitching_change", ok, ln, sk).alias("pitching_change_id"),
        ids.event_id("substitution", ok, ln, pk, sk).alias("substitution_id"),
        ids.event_id("defensive_shift", ok, ln, q10).alias("defensive_shift_id"),
        ids.event_id("inning_state", ok, q10 + 1, half, state).alias("inning_state_id"),
        ids.event_id("nfl_play", F.concat(F.lit("2024_"), ok.cast("string")), ln).alias("nfl_play_id"))


@register("id_payload_hash", """
SELECT l_orderkey, l_linenumber, h AS payload_hash,
       'mlb:' || CAST(l_orderkey AS VARCHAR) || ':game:status:' || h AS game_state_id
FROM (SELECT l_orderkey, l_linenumber,
             substr(sha256('{"l_linenumber":' || CAST(l_linenumber AS VARCHAR) || ',"l_orderkey":'
                           || CAST(l_orderkey AS VARCHAR) || ',"l_returnflag":"' || l_returnflag
                           || '"}'), 1, 16) AS h
      FROM lineitem)""")
def q_id_payload_hash(spark, sf):
    li = td.read_table(spark, sf, "lineitem")
    h = ids.struct_payload_hash(l_orderkey="l_orderkey", l_linenumber="l_linenumber",
                                l_returnflag="l_returnflag")
    out = li.select("l_orderkey", "l_linenumber", h.alias("payload_hash"))
    return out.withColumn("game_state_id",
                          ids.event_id("game_state", F.col("l_orderkey"), F.lit("status"), F.col("payload_hash")))


@register("json_payload_hash", """
SELECT event_id, substr(sha256('{"list":[1,null,true,"' || event_type || '"],"nested":{"a":' ||
    CAST(json_extract(props, '$.k') AS VARCHAR) || ',"b":{},"user":' || CAST(user_id AS VARCHAR) ||
    '},"text":"\\u00e9 \\"q\\"","z":' || CAST(event_id AS VARCHAR) || '}'), 1, 16) AS payload_hash FROM events""")
def q_json_payload_hash(spark, sf):
    """Hash of objects with nested and unsorted keys, spaces, escapes and text beyond ASCII."""
    ev = td.read_table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    text = F.format_string('{ "z" : %s, "nested": {"user": %s, "b": { }, "a": %s}, "text": "é \\"q\\"", '
                           '"list": [1, null, true, "%s"] }', F.col("event_id").cast("string"),
                           F.col("user_id").cast("string"), k, F.col("event_type"))
    return ev.select("event_id", ids.json_payload_hash(text).alias("payload_hash"))


@register("ordinal_in_group", f"""
WITH n AS (
  SELECT l.*, o.o_custkey,
         row_number() OVER (PARTITION BY l.l_orderkey ORDER BY {_ORDER_SQL}) - 1 AS ordinal
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)
SELECT l_orderkey, CAST(ordinal AS BIGINT) AS ordinal,
       'mlb:' || CAST(o_custkey AS VARCHAR) || ':pickoff:' || CAST(l_orderkey AS VARCHAR) || ':'
         || CAST(ordinal AS VARCHAR) AS pickoff_id
FROM n""")
def q_ordinal_in_group(spark, sf):
    li = td.read_table(spark, sf, "lineitem")
    od = td.read_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    j = li.join(od, li.l_orderkey == od.o_orderkey)
    s = ordered_scan(j, ["l_orderkey"], td.LINEITEM_ORDER,
                     chunk_of("l_partkey", td.PART_STEP), ordinal="ordinal", sizes=li)
    return s.select("l_orderkey", "ordinal",
                    ids.event_id("pickoff", F.col("o_custkey"), F.col("l_orderkey"), F.col("ordinal"))
                    .alias("pickoff_id"))
