import numpy as np
import pandas as pd

from gamelog.llm import topk
from gamelog.llm.topk import search_block, top_k


def plain(rows, queries, k=5):
    good = [(i, v) for i, v in rows if i is not None and v is not None
            and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, qv in queries:
        s = []
        for i, v in good:
            if i != q:
                s.append((-sum(int(np.floor(256 * a)) * int(np.floor(256 * b)) for a, b in zip(qv, v)), i))
        out += [(q, r + 1, i, -n) for r, (n, i) in enumerate(sorted(s)[:k])]
    return sorted(out)


def test_equals_brute_force_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=40).astype(np.float32).tolist()) for i in range(600)]
    rows += [(i, rows[3][1]) for i in range(600, 700)]  # ties
    rows += [(700, None), (701, [None] * 40), (702, [float("nan")] * 40), (703, [float("inf")] * 40), (704, []),
             (None, rows[0][1]), (705, [0.5] * 10)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = top_k(df, df.filter("vec_id % 50 = 0")).collect()
    queries = [(i, v) for i, v in rows if i is not None and i % 50 == 0 and v is not None]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == plain(rows, queries)


def test_few_rows_large_numbers_and_empty_tables(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(0, [3e9, 1.0]), (1, [1e3, -2.0]), (2, [1e3, 5.0])]
    df = spark.createDataFrame(rows, schema)
    got = top_k(df, df.filter("vec_id = 0")).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [
        (1, 2, 768 * 10**9 * 256 * 1000 + 256 * 1280), (2, 1, 768 * 10**9 * 256 * 1000 - 256 * 512)]
    assert top_k(spark.createDataFrame([], schema), df).collect() == []
    assert top_k(df, spark.createDataFrame([], schema)).collect() == []


def test_bounds_drop_candidates_and_keep_answers():
    rng = np.random.default_rng(2)
    cand = rng.normal(size=(64, 3000)) * np.linspace(4, 0.01, 64)[:, None]
    query = cand[:, :8] * 1.0
    cand, query = np.floor(256 * cand), np.floor(256 * query)
    ids, qids = np.arange(3000), np.arange(8)
    bound = np.full(8, -np.inf)
    qi, found, score = search_block(ids, cand, qids, query, bound, 5)
    want = query.T @ cand
    want[np.arange(8), np.arange(8)] = -np.inf
    for q in range(8):
        assert found[qi == q].tolist() == np.lexsort((ids, -want[q]))[:5].tolist()
    assert np.array_equal(bound, np.sort(want, 1)[:, -5])


def test_query_blocks_are_not_broadcast_however_small_they_seem(spark):
    """Spark takes them for small: it knows the queries' size, not that of blocks sent to every cell."""
    df = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(300)], "vec_id long, embedding array<double>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100m")
    try:
        out = top_k(df, df.filter("vec_id % 50 = 0"))
        assert len(out.collect()) == 30
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "isFinalPlan=true" in plan and "Broadcast" not in plan


def test_many_cells_and_parts_equal_brute_force(spark, monkeypatch):
    for name, value in {"CAND_BLOCK": 16, "QUERY_BLOCK": 4, "CELL": 2, "LARGE_CELL": 3, "CELLS": 4, "PART": 64}.items():
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    rows += [(i, [1000 * x for x in rows[i - 400][1]]) for i in range(400, 420)]  # beyond 16 bits
    rows += [(7, rows[1][1])] * 40  # one id in whole blocks
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = top_k(df, df.filter("vec_id % 10 = 0"))
    assert sorted(tuple(r) for r in out.collect()) == sorted(
        (q, r, i, s) for q, r, i, s in plain(rows, [x for x in rows if x[0] % 10 == 0]))


def test_blocks_keep_integers_in_the_smallest_type():
    for values, kind in (([-3.0, 1.5], "int16"), ([127.99, -128.0], "int32"), ([200.0, -1e6], "int32"), ([1e9, 0.25], "float64"),
                         ([], "int16")):
        rows = pd.DataFrame({"id": [1, 2], "v": [values, values[:1]]})
        r = next(topk._pack(2)([rows])).iloc[0]
        assert r["kind"] == kind
        want = np.zeros((len(values), 2))
        want[:, 0] = np.floor(256 * np.array(values))
        want[:1, 1] = want[:1, 0]
        assert np.array_equal(np.frombuffer(r["data"], r["kind"]).reshape(r["dim"], r["n"]), want)


def test_cells_grow_with_the_candidates():
    assert [topk._cells(n) for n in (0, 1, 9, 384, 3000, 3200, 23000)] == [1, 1, 2, 48, 48, 50, 360]
