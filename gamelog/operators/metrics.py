"""Counts, histograms, latencies and audits over event and outcome tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gamelog.functions.cols import as_col, seconds_between
from gamelog.functions.scan import chunk_of, ordered_scan
from gamelog.sources.schemas import DURATION_BOUNDS, OUTCOME_DLQ, OUTCOME_DUPLICATE, OUTCOME_WRITTEN


def outcome_counts(validated: DataFrame, table: DataFrame, key: str = "event_id") -> DataFrame:
    """Messages by outcome, in one pass: bad records are dead letters; of the good ones the first
    of each key that ``table`` lacks is written and all others are duplicates."""
    good = F.col("error_kind").isNull()
    copies = validated.groupBy(F.when(good, F.col(key)).alias(key)).agg(F.count(F.lit(1)).alias("n"))
    known = table.select(F.col(key).alias("_known")).distinct()
    new = F.col(key).isNotNull() & F.col("_known").isNull()
    counts = copies.join(known, F.col(key) == F.col("_known"), "left").agg(
        F.count_if(new).alias(OUTCOME_WRITTEN),
        (F.coalesce(F.sum(F.when(F.col(key).isNotNull(), F.col("n"))), F.lit(0)) - F.count_if(new)).alias(OUTCOME_DUPLICATE),
        F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).alias(OUTCOME_DLQ))
    rows = F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(o).alias("messages"))
                     for o in (OUTCOME_WRITTEN, OUTCOME_DUPLICATE, OUTCOME_DLQ)])
    return counts.select(F.explode(rows).alias("o")).select("o.*").filter("messages > 0")


def dead_letter_counts(letters: DataFrame) -> DataFrame:
    return letters.groupBy("error_class").agg(F.count(F.lit(1)).alias("dead_letters"))


def published_counts(records: DataFrame) -> DataFrame:
    """Published records by event type."""
    return records.groupBy("event_type").agg(F.count(F.lit(1)).alias("published"))


def duration_histogram(df: DataFrame, duration_col: str,
                       bounds: Sequence[float] = DURATION_BOUNDS) -> DataFrame:
    """Cumulative histogram: one row per upper bound (and +Inf) with the count of values at
    or below it, plus the total count and sum; one aggregation pass."""
    d = F.col(duration_col)
    aggs = [F.count_if(d <= F.lit(float(b))).alias(f"b{i}") for i, b in enumerate(bounds)]
    aggs += [F.count(d).alias("n"), F.sum(d).alias("total")]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("cumulative_count"))
            for i, b in enumerate(bounds)]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("n").alias("cumulative_count")))
    return one.select(F.explode(F.array(*rows)).alias("h"), "n", "total").select(
        "h.le", "h.cumulative_count", F.col("n").alias("count"), F.col("total").alias("sum"))


def latency_columns(events: DataFrame, served_time) -> DataFrame:
    """upstream = source - event, pipeline = ingest - source, serving = served - ingest,
    end_to_end = served - event; all in seconds."""
    served = as_col(served_time)
    return events.select(
        "event_id", "event_type", "game_pk",
        seconds_between(F.col("source_time"), F.col("event_time")).alias("upstream_s"),
        seconds_between(F.col("ingest_time"), F.col("source_time")).alias("pipeline_s"),
        seconds_between(served, F.col("ingest_time")).alias("serving_s"),
        seconds_between(served, F.col("event_time")).alias("end_to_end_s"))


def exact_percentiles(df: DataFrame, group: Sequence[str], value: str,
                      probs: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Exact (linearly interpolated) percentiles per group without gathering a group.

    Equal values are counted first (map-side), the counts are summed per value bin (a
    thousandth of a natural logarithm wide, so a group has a bounded number of bins), and only
    the bins that hold the two ranks around (n - 1) * p are looked into.
    """
    group = list(group)
    v = F.col("_v")
    width = F.floor(F.log(F.abs(v)) * 1000).cast("long") + F.lit(1_000_000)
    vals = (df.select(*group, F.col(value).cast("double").alias("_v")).filter(v.isNotNull())
            .groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_c"))
            .withColumn("_bin", F.when(v == 0, F.lit(0)).when(v > 0, width).otherwise(-width)))
    bins = vals.groupBy(*group, "_bin").agg(F.sum("_c").alias("_c"))
    w, whole = Window.partitionBy(*group).orderBy("_bin"), Window.partitionBy(*group)
    bins = bins.select(*group, "_bin", (F.sum("_c").over(w) - F.col("_c")).alias("_below"), "_c",
                       F.sum("_c").over(whole).alias("_n"))
    wanted = bins.select("*", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("_p")) \
        .withColumn("_pos", (F.col("_n") - 1) * F.col("_p")) \
        .withColumn("_rank", F.explode(F.array(F.floor("_pos"), F.ceil("_pos")))) \
        .filter("_rank >= _below AND _rank < _below + _c")
    inside = Window.partitionBy(*group, "_bin").orderBy("_v")
    held = vals.join(wanted.select(*group, "_bin").distinct(), [*group, "_bin"], "left_semi").select(
        *group, "_bin", "_v", F.col("_c").alias("_times"), (F.sum("_c").over(inside) - F.col("_c")).alias("_before"))
    picked = held.join(wanted, [*group, "_bin"]).filter(
        "_rank >= _below + _before AND _rank < _below + _before + _times")
    agg = picked.groupBy(*group, "_p", "_pos").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    res = agg.select(*group, "_p", (F.col("_low") + (F.col("_high") - F.col("_low")) * (
        F.col("_pos") - F.floor("_pos"))).alias("_q"))
    return res.groupBy(*group).pivot("_p", [float(p) for p in probs]).agg(F.first("_q")) \
        .withColumnsRenamed({str(float(p)): f"p{round(p * 100):02d}" for p in probs})


def latency_percentiles(lat: DataFrame, column: str = "end_to_end_s",
                        group: Sequence[str] = ("event_type",)) -> DataFrame:
    return exact_percentiles(lat, group, column)


def throughput_mix(events: DataFrame, window: str = "1 hour") -> DataFrame:
    """Events per time window and type, with the type's share of the window."""
    per = events.groupBy(F.window(F.col("event_time"), window).alias("w"), "event_type") \
        .agg(F.count(F.lit(1)).alias("events"))
    per = per.withColumn("window_events", F.sum("events").over(Window.partitionBy("w")))
    return per.select(
        F.col("w.start").alias("window_start"), "event_type", "events",
        (F.col("events") / F.col("window_events")).alias("share"))


def duplicate_audit(rows: DataFrame, key: str = "event_id") -> DataFrame:
    """Keys delivered more than once, with their copy count (combined map-side)."""
    return (rows.groupBy(key).agg(F.count(F.lit(1)).alias("copies"))
            .filter(F.col("copies") > 1))


def gap_audit(pitches: DataFrame) -> DataFrame:
    """Missing pitch numbers inside an at-bat: consecutive distinct numbers that are not
    n-1, n. Distinct first, then the bounded scan for the previous number."""
    d = pitches.select("game_pk", "at_bat_index", "pitch_number").distinct()
    s = ordered_scan(d, ["game_pk", "at_bat_index"], ["pitch_number"], chunk_of("pitch_number", 64),
                     prev=["pitch_number"])
    return (s.filter(F.col("prev_pitch_number").isNotNull()
                     & (F.col("pitch_number") - F.col("prev_pitch_number") > 1))
            .select("game_pk", "at_bat_index", F.col("prev_pitch_number").alias("after"),
                    F.col("pitch_number").alias("before"),
                    (F.col("pitch_number") - F.col("prev_pitch_number") - 1).cast("long")
                    .alias("missing")))


# ---------------------------------------------------------------- mergeable quantile sketch

ACCURACY = 0.01


def quantile_sketch(df: DataFrame, group: Sequence[str], value: str, accuracy: float = ACCURACY) -> DataFrame:
    """How many values of each group fall into each bin: group columns, bin, n.

    Bins grow by a factor of (1 + accuracy) / (1 - accuracy), so that any value is within
    ``accuracy`` (as a share of it) of its bin's middle; 0 has a bin of its own, below the positive
    ones and above the negative ones. Nulls and non-finite values are left out. A sketch has a few
    thousand bins a group at most, whatever the number of values.
    """
    v = F.col(value).cast("double")
    step = F.ceil(F.log(F.abs(v)) / F.lit(_log_growth(accuracy))).cast("int") + _ZERO
    number = F.when(v == 0, F.lit(0)).when(v > 0, step).otherwise(-step)
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return df.filter(finite).groupBy(*group, number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def merge_sketches(sketches: Sequence[DataFrame], group: Sequence[str]) -> DataFrame:
    """The sketch of all values together, from sketches of parts of them (of one accuracy)."""
    out = sketches[0]
    for more in sketches[1:]:
        out = out.unionByName(more)
    return out.groupBy(*group, "bin").agg(F.sum("n").alias("n"))


def sketch_quantiles(sketch: DataFrame, group: Sequence[str], probs: Sequence[float] = (0.5, 0.95, 0.99),
                     accuracy: float = ACCURACY) -> DataFrame:
    """Quantiles of each group from its sketch: group columns, n, p50, p95, p99 (by ``probs``).

    Each is within ``accuracy`` of the exact value at place floor(p * (n - 1)) of the sorted values.
    """
    w = Window.partitionBy(*group)
    upto = F.sum("n").over(w.orderBy("bin"))
    growth = 2 / (1 + (1 + accuracy) / (1 - accuracy))
    size = F.exp((F.abs("bin") - _ZERO) * F.lit(_log_growth(accuracy))) * F.lit(growth)
    middle = F.when(F.col("bin") == 0, F.lit(0.0)).when(F.col("bin") > 0, size).otherwise(-size)
    rows = sketch.select(*group, "bin", upto.alias("_upto"), F.sum("n").over(w).alias("_all"), middle.alias("_v"))
    picks = [F.min_by("_v", F.when(F.col("_upto") > F.floor((F.col("_all") - 1) * F.lit(float(p))), F.col("bin")))
             .alias(f"p{round(p * 100):02d}") for p in probs]
    return rows.groupBy(*group).agg(F.max("_all").alias("n"), *picks)


_ZERO = 1 << 20  # bins of numbers far below 1 stay positive


def _log_growth(accuracy: float) -> float:
    return math.log((1 + accuracy) / (1 - accuracy))


# ---------------------------------------------------------------- seen intervals (gap audit over batches)


def number_intervals(pitches: DataFrame) -> DataFrame:
    """The pitch numbers of each at-bat as intervals: game_pk, at_bat_index, seen (array of low, high)."""
    d = pitches.select("game_pk", "at_bat_index", "pitch_number").distinct().filter("pitch_number IS NOT NULL")
    s = ordered_scan(d, ["game_pk", "at_bat_index"], ["pitch_number"], chunk_of("pitch_number", 64), ordinal="_at")
    runs = s.groupBy("game_pk", "at_bat_index", (F.col("pitch_number") - F.col("_at")).alias("_run")).agg(
        F.min("pitch_number").alias("low"), F.max("pitch_number").alias("high"))
    return runs.groupBy("game_pk", "at_bat_index").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("seen"))


def merge_intervals(*seen: Column) -> Column:
    """Intervals of several arrays as one: sorted, those that overlap or touch joined; null is none."""
    kind = "array<struct<low:int,high:int>>"
    every = F.array_sort(F.concat(*[F.coalesce(s, F.array().cast(kind)) for s in seen]))

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
            last["low"].alias("low"), F.greatest(last["high"], x["high"]).alias("high"))))
        return F.when((F.size(done) > 0) & (x["low"] <= F.try_element_at(done, F.lit(-1))["high"] + 1), joined).otherwise(
            F.concat(done, F.array(x)))

    return F.aggregate(every, F.array().cast(kind), add)


def gaps_of_intervals(rows: DataFrame) -> DataFrame:
    """The missing numbers between the intervals ``seen`` of each at-bat, as ``gap_audit`` gives them."""
    between = F.zip_with(F.slice("seen", 1, F.size("seen") - 1), F.slice("seen", 2, F.size("seen")),
                         lambda a, b: F.struct(a["high"].alias("after"), b["low"].alias("before")))
    return rows.filter(F.size("seen") > 1).select("game_pk", "at_bat_index", F.explode(between).alias("g")).select(
        "game_pk", "at_bat_index", "g.after", "g.before",
        (F.col("g.before") - F.col("g.after") - 1).cast("long").alias("missing"))


def publish_results(validated: DataFrame) -> DataFrame:
    """Published and failed records by event type; a type without a name is ``unknown``."""
    good = F.col("error_kind").isNull()
    return validated.groupBy(F.coalesce("event_type", F.lit("unknown")).alias("event_type")).agg(
        F.count_if(good).alias("published"), F.count_if(~good).alias("failed"))
