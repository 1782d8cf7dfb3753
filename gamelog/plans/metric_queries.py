"""Latency, histogram, throughput and mix queries over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from gamelog.functions.cols import seconds_between
from gamelog.functions.times import to_ntz
from gamelog.operators import metrics
from gamelog.plans.oracle import EV_CTE
from gamelog.plans.registry import register
from gamelog.sources import testdata as td
from gamelog.sources.schemas import DURATION_BOUNDS

# ---- fixed values: query parameters ----
SERVED_AT = "2024-02-01 00:00:00"
# ---- end of fixed values ----

_SERVED_SQL = f"TIMESTAMP '{SERVED_AT}'"


def _secs(a: str, b: str) -> str:
    return f"CAST(epoch_us({a}) - epoch_us({b}) AS DOUBLE) / 1e6"


def _served():
    return F.lit(SERVED_AT).cast("timestamp")


_HIST_ROWS = " UNION ALL ".join(
    [f"SELECT '{b}' AS le, count(*) FILTER (WHERE d <= {b}) AS cumulative_count FROM dd"
     for b in DURATION_BOUNDS] + ["SELECT '+Inf' AS le, count(d) AS cumulative_count FROM dd"])


@register("duration_histogram", f"""
WITH {EV_CTE},
dd AS (SELECT {_secs('ingest_time', 'source_time')} AS d FROM ev),
h AS ({_HIST_ROWS})
SELECT le, cumulative_count, (SELECT count(d) FROM dd) AS count,
       round((SELECT sum(d) FROM dd), 3) AS sum
FROM h""")
def q_duration_histogram(spark, sf):
    ev = td.events_table(spark, sf)
    d = ev.select(seconds_between(F.col("ingest_time"), F.col("source_time")).alias("d"))
    return metrics.duration_histogram(d, "d").withColumn("sum", F.round("sum", 3))


@register("latency_columns", f"""
WITH {EV_CTE}
SELECT event_id, event_type, game_pk,
       {_secs('source_time', 'event_time')} AS upstream_s,
       {_secs('ingest_time', 'source_time')} AS pipeline_s,
       {_secs(_SERVED_SQL, 'ingest_time')} AS serving_s,
       {_secs(_SERVED_SQL, 'event_time')} AS end_to_end_s
FROM ev""")
def q_latency_columns(spark, sf):
    return metrics.latency_columns(td.events_table(spark, sf), _served())


@register("latency_percentiles", f"""
WITH {EV_CTE},
l AS (SELECT event_type, {_secs(_SERVED_SQL, 'event_time')} AS e2e FROM ev)
SELECT event_type, round(quantile_cont(e2e, 0.5), 6) AS p50,
       round(quantile_cont(e2e, 0.95), 6) AS p95, round(quantile_cont(e2e, 0.99), 6) AS p99
FROM l GROUP BY event_type""")
def q_latency_percentiles(spark, sf):
    lat = metrics.latency_columns(td.events_table(spark, sf), _served())
    p = metrics.latency_percentiles(lat, "end_to_end_s", ["event_type"])
    return p.select("event_type", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])


@register("throughput_mix", f"""
WITH {EV_CTE},
per AS (SELECT time_bucket(INTERVAL 1 HOUR, event_time) AS window_start, event_type,
               count(*) AS events
        FROM ev GROUP BY ALL)
SELECT window_start, event_type, events,
       events / sum(events) OVER (PARTITION BY window_start) AS share
FROM per""")
def q_throughput_mix(spark, sf):
    return metrics.throughput_mix(td.events_table(spark, sf), "1 hour")


_GROWTH = metrics._log_growth(metrics.ACCURACY)
_PICK = ", ".join(f"min(bin) FILTER (WHERE upto > floor((n - 1) * {p})) AS b{round(p * 100)}" for p in (0.5, 0.95, 0.99))
_MIDDLE = ", ".join(
    f"round(CASE WHEN b{b} = 0 THEN 0 ELSE sign(b{b}) * exp((abs(b{b}) - 1048576) * {_GROWTH!r}) * 2 "
    f"/ (1 + {(1 + metrics.ACCURACY) / (1 - metrics.ACCURACY)!r}) END, 6) AS p{b}" for b in (50, 95, 99))


@register("latency_sketch", f"""
WITH {EV_CTE},
l AS (SELECT time_bucket(INTERVAL 1 DAY, event_time) AS day, event_type, {_secs('ingest_time', 'event_time')} AS v FROM ev),
s AS (SELECT day, event_type, CASE WHEN v = 0 THEN 0 ELSE sign(v) * (ceil(ln(abs(v)) / {_GROWTH!r}) + 1048576) END AS bin,
             count(*) AS c FROM l GROUP BY ALL),
r AS (SELECT *, sum(c) OVER (PARTITION BY day, event_type ORDER BY bin) AS upto,
             sum(c) OVER (PARTITION BY day, event_type) AS n FROM s),
q AS (SELECT day, event_type, CAST(any_value(n) AS BIGINT) AS n, {_PICK} FROM r GROUP BY day, event_type)
SELECT day, event_type, n, {_MIDDLE} FROM q""")
def q_latency_sketch(spark, sf):
    ev = td.events_table(spark, sf)
    rows = ev.select(F.date_trunc("DAY", "event_time").alias("day"), "event_type", "event_id",
                     seconds_between(F.col("ingest_time"), F.col("event_time")).alias("v"))
    group = ["day", "event_type"]
    # as three batches would leave them
    parts = [metrics.quantile_sketch(rows.filter(F.col("event_id").cast("long") % 3 == b), group, "v") for b in range(3)]
    out = metrics.sketch_quantiles(metrics.merge_sketches(parts, group), group)
    return out.select(to_ntz(F.col("day")).alias("day"), "event_type", "n", *[F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")])
