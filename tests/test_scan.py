"""Bounded ordered scan equals plain windows, including a group with a third of the rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from gamelog.functions.scan import chunk_of, ordered_scan
from gamelog.operators.metrics import exact_percentiles


def _data(spark):
    return spark.range(0, 6000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 11).cast("string")).alias("g"),
        F.col("id").alias("o"),
        F.when(F.col("id") % 5 < 3, F.lit(None)).otherwise((F.col("id") * 7 % 13).cast("int")).alias("v"))


def _reference(df):
    w = Window.partitionBy("g").orderBy("o")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return df.select("g", "o", "v", F.lag("v").over(w).alias("prev_v"),
                     F.last("v", True).over(run).alias("fill_v"),
                     F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before_v"),
                     (F.row_number().over(w) - 1).cast("long").alias("pos"))


COLS = ["g", "o", "v", "prev_v", "fill_v", "before_v", "pos"]


def test_chunks_and_spans(spark):
    df = _data(spark)
    ref = _reference(df).select(*COLS)
    for step in (1, 97, 10_000):  # chunks of one row span several spans
        out = ordered_scan(df, ["g"], ["o"], chunk_of("o", step), prev=["v"], fill=["v"], before=["v"],
                           ordinal="pos").select(*COLS)
        assert out.count() == 6000
        assert out.exceptAll(ref).count() == 0


def test_null_order_and_first(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 5, 2), ("a", 2000000, None), ("b", 1, 4)], "g string, o long, v int")
    out = ordered_scan(df, ["g"], ["o"], chunk_of("o", 1), prev=["v"], first=["v"], ordinal="n").collect()
    assert {(r.g, r.o): (r.prev_v, r.first_v, r.n) for r in out} == {
        ("a", None): (None, 1, 0), ("a", 5): (1, 1, 1), ("a", 2000000): (2, 1, 2), ("b", 1): (None, 4, 0)}


def test_building_a_query_runs_nothing(spark):
    import __spark_entry__ as entry
    from gamelog.plans.registry import QUERIES
    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    sc = spark.sparkContext
    sc.setJobGroup("building", "building registered queries")
    try:
        for name in QUERIES:
            entry.queries()[name](spark, "/root/testdata/sf0.001")
        jobs = sc.statusTracker().getJobIdsForGroup("building")
        # reading a Parquet schema is the only job a query may start
        assert all(sc.statusTracker().getStageInfo(s).name.startswith("parquet")
                   for j in jobs for s in sc.statusTracker().getJobInfo(j).stageIds)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_exact_percentiles_match_interpolation(spark):
    import numpy as np
    df = _data(spark).filter(F.col("v").isNotNull())
    got = {r.g: (r.p50, r.p95, r.p99) for r in exact_percentiles(df, ["g"], "v").collect()}
    pdf = df.toPandas()
    for g, vals in pdf.groupby("g")["v"]:
        exp = np.percentile(vals.to_numpy(dtype=float), [50, 95, 99])
        assert np.allclose(got[g], exp)


from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(0, 10**6),
                          st.one_of(st.none(), st.integers(-5, 5))),
                min_size=1, max_size=60, unique_by=lambda t: (t[0], t[1])))
def test_segmented_scan_matches_pandas(spark, rows):
    import pandas as pd
    df = spark.createDataFrame(rows, "g string, o long, v int")
    out = ordered_scan(df, ["g"], ["o"], chunk_of("o", 50_000), prev=["v"], fill=["v"], before=["v"],
                       ordinal="pos").toPandas()
    pdf = pd.DataFrame(rows, columns=["g", "o", "v"]).sort_values(["g", "o"])
    grp = pdf.groupby("g")["v"]
    pdf["prev_v"] = grp.shift(1)
    pdf["fill_v"] = grp.ffill()
    pdf["before_v"] = pdf.groupby("g")["fill_v"].shift(1)
    pdf["pos"] = pdf.groupby("g").cumcount()
    got = out.set_index(["g", "o"]).sort_index()
    exp = pdf.set_index(["g", "o"]).sort_index()
    for c in ("prev_v", "fill_v", "before_v", "pos"):
        a = [None if pd.isna(x) else int(x) for x in got[c]]
        b = [None if pd.isna(x) else int(x) for x in exp[c]]
        assert a == b, c


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]


def test_only_large_groups_are_cut(spark):
    df = _data(spark).select(F.when(F.col("g") != "3", F.col("g")).alias("g"), "o", "v").filter("g IS NULL OR g <> '5' OR o < 40")
    ref = _reference(df).select(*COLS)
    for whole in (1, 100, 600, 5000):  # all large, some, one, none
        out = ordered_scan(df, ["g"], ["o"], chunk_of("o", 97), prev=["v"], fill=["v"], before=["v"], first=["v"],
                           ordinal="pos", sizes=df, whole=whole)
        assert out.count() == df.count() and out.select(*COLS).exceptAll(ref).count() == 0
        firsts = {r.g: (r.a, r.b) for r in out.groupBy("g").agg(F.min("first_v").alias("a"), F.max("first_v").alias("b")).collect()}
        assert firsts == {r.g: (r.v, r.v) for r in df.groupBy("g").agg(F.min_by("v", "o").alias("v")).collect()}


def test_without_large_groups_rows_are_shuffled_once(spark):
    df = spark.range(3000).select((F.col("id") % 500).alias("g"), F.col("id").alias("o"), F.col("id").alias("wide"))
    plan = _final_plan(ordered_scan(df, ["g"], ["o"], chunk_of("o", 7), ordinal="pos", sizes=df))
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    # a join by the group's key needs no shuffle of its own
    other = spark.range(500).select(F.col("id").alias("g"), F.lit(1).alias("x"))
    plan = _final_plan(ordered_scan(df, ["g"], ["o"], chunk_of("o", 7), ordinal="pos", sizes=df).join(other.hint("merge"), "g"))
    assert plan.count("Exchange hashpartitioning") == 2


def test_sizes_do_not_change_a_replay(spark):
    from gamelog.operators import replay
    ev = spark.range(900).select(
        F.when(F.col("id") % 3 > 0, F.lit("a")).otherwise(F.when(F.col("id") < 800, (F.col("id") % 5).cast("string"))).alias("game_pk"),
        (F.col("id") % 300).cast("string").alias("event_id"), F.lit("pitch").alias("event_type"),
        F.when(F.col("id") % 50 > 0, F.timestamp_seconds(F.col("id") % 300)).alias("event_time"), F.col("id").alias("payload"))
    plain = replay.replay_sequence(ev)
    for sizes in (ev, ev.limit(0), ev.crossJoin(spark.range(200))):
        out = replay.replay_sequence(ev, sizes=sizes).select(*plain.columns)
        assert out.exceptAll(plain).count() == 0 and out.count() == plain.count() > 800
