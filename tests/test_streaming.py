"""Streaming jobs end to end: landed feeds -> raw log -> events table, with restarts."""

import json
import os

import pytest
from pyspark.sql import functions as F

from fixtures import GAME, expected_pitches, feed, variant
from gamelog.operators import serve
from gamelog.sources import logs, tables
from gamelog.sources import testdata as td
from gamelog.sources.schemas import CURSOR
from gamelog.streaming import ingest, persist


def _land(folder, name, doc):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as fh:
        fh.write(json.dumps(doc))


def test_persist_writes_each_event_once(spark, scratch):
    raw = td.raw_log(spark, "/root/testdata/sf0.001")
    land = os.path.join(scratch, "raw")
    raw.write.parquet(land)
    events, dlq = os.path.join(scratch, "events"), os.path.join(scratch, "dlq")
    stream = logs.read_log_stream(spark, land)
    q = persist.start_persist(stream, events, dlq, os.path.join(scratch, "ck"))
    q.awaitTermination()
    observed = [p["observedMetrics"]["raw_records"] for p in q.recentProgress
                if "raw_records" in p.get("observedMetrics", {})]
    assert sum(m["records"] for m in observed) == raw.count()
    ev = spark.read.parquet(events)
    n = ev.count()
    assert n == ev.select("event_id").distinct().count() > 0
    # the same batch replayed (as after a crash before the commit) changes nothing
    persist.persist_batch(spark.read.parquet(land), 0, events, dlq)
    assert spark.read.parquet(events).count() == n
    # the same records arriving again in a later batch are all duplicates
    persist.persist_batch(spark.read.parquet(land), 1, events, dlq)
    assert spark.read.parquet(events).count() == n
    d = spark.read.parquet(dlq)
    assert d.filter("batch_id = 0").count() == d.filter("batch_id = 1").count() > 0


def test_ingest_publishes_only_new_pitches(spark, scratch):
    landing = os.path.join(scratch, "landing")
    log_path, cur_path, games_path = (os.path.join(scratch, n) for n in ("log", "cursor", "games"))
    ck = os.path.join(scratch, "ck")
    first = variant()
    first["liveData"]["plays"]["allPlays"] = first["liveData"]["plays"]["allPlays"][:1]
    _land(landing, "poll1.json", first)
    q = ingest.start_ingest(ingest.read_feed_stream(spark, landing), log_path, cur_path,
                            games_path, ck)
    q.awaitTermination()
    seen = [k for k, i, _ in expected_pitches() if i == 0]
    assert spark.read.parquet(log_path).count() == len(seen)
    _land(landing, "poll2.json", feed())
    q = ingest.start_ingest(ingest.read_feed_stream(spark, landing), log_path, cur_path,
                            games_path, ck)
    q.awaitTermination()
    log = spark.read.parquet(log_path)
    assert log.count() == len(expected_pitches())
    dec = logs.decode_pitches(log).orderBy("offset").collect()
    assert [r.event_id for r in dec] == [k for k, _, _ in expected_pitches()]
    cur = tables.read_snapshot(spark, cur_path, CURSOR).collect()[0]
    assert (cur.last_at_bat_index, cur.last_pitch_number) == (13, 2)
    from gamelog.sources.schemas import GAMES_TABLE
    games = tables.read_snapshot(spark, games_path, GAMES_TABLE).collect()
    assert [(g.game_pk, g.status) for g in games] == [(str(GAME), "In Progress")]
    assert json.loads(games[0].payload) == feed()


def test_two_polls_in_one_batch_publish_each_pitch_once(spark, scratch):
    landing = os.path.join(scratch, "landing")
    paths = {n: os.path.join(scratch, n) for n in ("log", "cursor", "games", "quarantine")}
    early = variant(metaData__timeStamp="2025-04-02T18:00:00.000Z")
    early["liveData"]["plays"]["allPlays"] = early["liveData"]["plays"]["allPlays"][:1]
    nameless = variant(gamePk=0, gameData__game__pk=0)
    for name, doc in (("a.json", early), ("b.json", feed()), ("c.json", feed()), ("d.json", nameless)):
        _land(landing, name, doc)
    docs = spark.read.text(landing, wholetext=True).selectExpr("_metadata.file_path AS doc_id", "value")
    counts = ingest.ingest_batch(docs, 0, paths["log"], paths["cursor"], paths["games"],
                                 quarantine_path=paths["quarantine"])
    dec = logs.decode_pitches(spark.read.parquet(paths["log"])).orderBy("offset").collect()
    assert [r.event_id for r in dec] == [k for k, _, _ in expected_pitches()]
    n = len(expected_pitches())
    assert dec[0].source_time.hour == 18 and counts["published"] == n
    assert counts["skipped"] == sum(i == 0 for _, i, _ in expected_pitches()) + n
    bad = spark.read.parquet(paths["quarantine"]).collect()
    assert sorted({(r.event_type, r.reason) for r in bad}) == [
        ("game_state", "spine.game_pk is empty"), ("pitch", "spine.game_pk is empty")]
    assert len(bad) == n + 1


def test_feed_to_serving(spark, scratch):
    landing = os.path.join(scratch, "landing")
    paths = {n: os.path.join(scratch, n) for n in ("log", "cursor", "games", "events", "dlq")}
    _land(landing, "poll1.json", feed())
    ingest.start_ingest(ingest.read_feed_stream(spark, landing), paths["log"], paths["cursor"],
                        paths["games"], os.path.join(scratch, "ck1")).awaitTermination()
    persist.start_persist(logs.read_log_stream(spark, paths["log"]), paths["events"], paths["dlq"],
                          os.path.join(scratch, "ck2")).awaitTermination()
    from gamelog.sources.schemas import GAMES_TABLE
    games = tables.read_snapshot(spark, paths["games"], GAMES_TABLE)
    latest = serve.latest_pitch_per_active_game(spark.read.parquet(paths["events"]), games).collect()
    assert len(latest) == 1 and latest[0].event_id == f"mlb:{GAME}:pitch:13:2"
    assert latest[0].status == "In Progress"


def test_read_schedules_by_landing_date(spark, scratch):
    from gamelog.operators import extract
    from gamelog.sources import documents
    base = os.path.join(scratch, "sched")
    _land(os.path.join(base, "date=2024-07-15"), "a.json",
          {"dates": [{"games": [{"gamePk": 1, "status": {"statusCode": "I"}}]}]})
    _land(os.path.join(base, "date=2024-07-16"), "b.json",
          {"dates": [{"games": [{"gamePk": 2, "status": {"statusCode": "I"}}]}]})
    docs = documents.read_schedules(spark, base, date="2024-07-16")
    keys = extract.live_game_keys(extract.schedule_games(docs)).collect()
    assert [k.game_pk for k in keys] == ["2"]


def test_enriched_log_records(spark):
    from datetime import datetime
    from gamelog.operators import enrich
    p = spark.createDataFrame([("g", 0, 1, "mlb:g:pitch:1:1", 1, 1, 3, 1, datetime(2024, 7, 15), None, None)],
                              "game_pk string, partition int, offset long, event_id string, at_bat_index int, "
                              "pitch_number int, inning int, outs int, event_time timestamp, "
                              "source_time timestamp, ingest_time timestamp")
    recs = enrich.enriched_log_records(enrich.enriched_rows(enrich.rolling_context(p)), "enriched")
    r = recs.collect()[0]
    d = json.loads(bytes(r.value))
    assert bytes(r.key) == b"g" and d["event_id"] == "mlb:g:pitch:1:1"
    assert d["pitch"]["spine"]["event_id"] == "mlb:g:pitch:1:1" and d["pitch"]["inning"] == 3
    assert d["home_score"] == 0 and d["source_time"] == "1970-01-01T00:00:00+00:00"


def test_pure_stream_dedup(spark, scratch):
    from gamelog.operators import validate
    raw = td.raw_log(spark, "/root/testdata/sf0.001")
    land = os.path.join(scratch, "raw")
    raw.write.parquet(land)
    good = validate.good_records(validate.validate(logs.decode_pitches(
        logs.read_log_stream(spark, land))))
    for i, wm in enumerate([None, ("timestamp", "1 hour")]):
        out = persist.dedup_stream(good, watermark=wm)
        q = (out.writeStream.format("memory").queryName(f"dedup_{i}").outputMode("append")
             .option("checkpointLocation", os.path.join(scratch, f"ck{i}"))
             .trigger(availableNow=True).start())
        q.awaitTermination()
        got = spark.table(f"dedup_{i}")
        assert got.count() == got.select("event_id").distinct().count() > 0
        expected = validate.good_records(validate.validate(logs.decode_pitches(raw)))
        assert got.count() == expected.select("event_id").distinct().count()


def test_dedup_probe_reads_only_the_batchs_buckets(spark, scratch):
    events, dlq = os.path.join(scratch, "events"), os.path.join(scratch, "dlq")
    raw = td.raw_log(spark, "/root/testdata/sf0.001")
    persist.persist_batch(raw, 0, events, dlq)
    probe = persist._without_batch(spark, events, 1, [3, 77]).select("event_id")
    plan = probe._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "game_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "ReadSchema: struct<event_id:string>" in plan
    letter = spark.read.parquet(dlq).limit(1).collect()[0]
    assert set(json.loads(bytes(letter["value"]))) >= {"original_payload_b64", "error_class", "source_offset"}


def test_a_damaged_table_is_an_error_and_not_an_empty_one(spark, scratch):
    path = os.path.join(scratch, "cursor")
    os.makedirs(path + "/batch_id=0")
    with open(path + "/batch_id=0/part-0.parquet", "w") as f:
        f.write("damaged")
    with pytest.raises(Exception):
        tables.read_snapshot(spark, path, CURSOR).collect()
    assert tables.read_snapshot(spark, path + "-none", CURSOR).collect() == []


def test_old_snapshot_versions_go(spark, scratch):
    path = os.path.join(scratch, "cursor")
    empty = spark.createDataFrame([], CURSOR)
    for version in range(6):
        tables.write_snapshot(empty, path, version)
    assert sorted(n for n in os.listdir(path) if n.startswith("batch_id")) == ["batch_id=3", "batch_id=4", "batch_id=5"]
