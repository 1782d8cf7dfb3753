"""Physical plan checks: pushdown, pruning, partial aggregation, partial top-k."""

import contextlib
import io
import os
from datetime import datetime

from gamelog.operators import replay, serve, writes

EV = "event_id string, event_type string, sport string, game_pk string, event_time timestamp, " \
     "source_time timestamp, ingest_time timestamp, payload string"
GM = "game_pk string, sport string, status string, home_team string, away_team string, " \
     "start_time timestamp, updated_at timestamp, payload string"
T = datetime(2024, 7, 15, 22)


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def _tables(spark, scratch):
    ev = os.path.join(scratch, "events")
    gm = os.path.join(scratch, "games")
    spark.createDataFrame([("e1", "pitch", "mlb", "1", T, T, T, "{}")], EV).write.parquet(ev)
    spark.createDataFrame([("1", "mlb", "In Progress", "h", "a", T, T, None)], GM).write.parquet(gm)
    return spark.read.parquet(ev), spark.read.parquet(gm)


def test_latest_pushes_filters_and_prunes(spark, scratch):
    ev, gm = _tables(spark, scratch)
    p = _plan(serve.latest_pitch_per_active_game(ev, gm))
    assert "EqualTo(event_type,pitch)" in p and "EqualTo(sport,mlb)" in p
    assert "partial_max_by" in p
    assert "ReadSchema: struct<game_pk:string,sport:string,status:string,home_team:string," \
           "away_team:string,updated_at:timestamp>" in p


def test_top_k_is_limited_before_shuffle(spark, scratch):
    ev, _ = _tables(spark, scratch)
    p = _plan(serve.recent_pitches_per_game(ev, 100))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_replay_bounds_reach_the_scan(spark, scratch):
    ev, _ = _tables(spark, scratch)
    p = _plan(replay.ordered_history(ev, "1", since=T, until=T))
    assert "EqualTo(game_pk,1)" in p and "GreaterThanOrEqual(event_time" in p
    assert "LessThanOrEqual(event_time" in p


def test_first_writer_combines_map_side(spark):
    batch = spark.createDataFrame([("a", 0, 1, "x")], "event_id string, partition int, offset long, p string")
    p = _plan(writes.insert_if_new(batch, spark.createDataFrame([], "event_id string")))
    assert "partial_min_by" in p


def test_json_parsed_once_under_filters(spark):
    from pyspark.sql import functions as F
    from gamelog.operators import validate
    from gamelog.sources import logs
    log = spark.createDataFrame([(b"1", b'{"spine": {"event_id": "x"}}', "raw", 0, 0)],
                                "key binary, value binary, topic string, partition int, offset long") \
        .withColumn("timestamp", F.current_timestamp())
    good = validate.good_records(validate.validate(logs.decode_pitches(log)))
    optimized = good._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("from_json") == 1


def test_a_games_folder_is_all_that_is_read(spark, scratch):
    from pyspark.sql import functions as F

    from gamelog.sources import tables
    path = os.path.join(scratch, "events")
    rows = [(f"mlb:{g}:pitch:1:{i}", "pitch", "mlb", str(g), T, T, T, "{}") for g in range(40) for i in range(2)]
    tables.write_batch_partition(spark.createDataFrame(rows, EV).withColumn("game_bucket", tables.game_bucket(F.col("game_pk"))),
                                 path, 0, folders=("game_bucket",))
    for out in (serve.pitches_for_game(tables.read_events(spark, path, "7"), "7"),
                replay.ordered_history(tables.read_events(spark, path, "7"), "7", since=T)):
        filters = _plan(out).split("PartitionFilters: [")[1].split("]")[0]
        assert "game_bucket" in filters and out.count() == 2
    some = tables.read_events(spark, path, ["3", "9", "none"])
    assert sorted({r.game_pk for r in some.collect()}) == ["3", "9"] and tables.read_events(spark, path, []).count() == 0
    assert tables.read_events(spark, path).count() == 80


def test_log_is_decoded_once(spark):
    from pyspark.sql import functions as F

    from gamelog.operators import enrich
    from gamelog.sources import logs
    from gamelog.sources.schemas import CONTEXT_FIELDS
    log = spark.range(200).select(
        F.lit(b"g").alias("key"), F.format_string('{"spine": {"event_id": "e%d", "game_pk": "g"}, "inning": %d}', F.col("id") % 60, "id")
        .cast("binary").alias("value"), F.lit("raw").alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("offset"),
        F.current_timestamp().alias("timestamp"))
    rows = logs.decode_pitches(log).filter("event_id IS NOT NULL")
    stored = spark.createDataFrame([("e1",), ("e1",), ("x",)], "event_id string")

    def decodes(df):
        got = df.collect()
        return got, df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0].count("from_json")

    slim = rows.select("partition", "offset", "event_id")
    out, n = decodes(writes.write_outcomes(slim, stored))
    assert n == 1 and len(out) == 200
    assert sorted(r.event_id for r in out if r.outcome == "written") == sorted(f"e{k}" for k in range(60) if k != 1)
    out, n = decodes(writes.insert_if_new(rows.select("partition", "offset", "event_id", "inning"), stored))
    assert n == 1 and sorted((r.event_id, r.inning) for r in out) == sorted((f"e{k}", k) for k in range(60) if k != 1)
    context = spark.createDataFrame([], "game_pk string, " + ", ".join(
        f"{c} {'boolean' if 'runner' in c else 'int'}" for c in CONTEXT_FIELDS))
    out, n = decodes(enrich.rolling_context(rows.select("game_pk", "partition", "offset", "inning", "outs"), context, chunk_rows=16))
    assert n == 1 and sorted((r.offset, r.ctx_inning) for r in out) == [(k, k) for k in range(200)]


def test_log_queries_decode_each_log_once(spark):
    import __spark_entry__ as entry
    from gamelog.plans import log_queries
    sf = "/root/testdata/sf0.001"

    def decodes(name):
        df = entry.queries()[name](spark, sf)
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0].count("from_json(StructField(spine")

    # republish_records decodes the log and then the log that it writes
    assert {n: decodes(n) for n in ("retry_counts", "enriched_log_values", "enriched_rows", "context_changes", "republish_records")} == {
        "retry_counts": 1, "enriched_log_values": 1, "enriched_rows": 1, "context_changes": 1, "republish_records": 2}
    optimized = log_queries.good(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("parseJson") == 1  # the raw text is not parsed by the filter again
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
