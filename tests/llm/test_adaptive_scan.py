"""Adaptive scan: exact with all lists and no tests, recall of the parameters in use, odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gamelog.llm import adaptive_scan
from gamelog.llm.adaptive_scan import fit_centres, nearest, op13_nearest_vectors, rotation, scan_block

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, asked, k):
    """Exact answer: {query: [(rank, vec_id, distance)]}."""
    out = {}
    for q, v in asked:
        found = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w))), i) for i, w in rows if i != q)[:k]
        out[q] = [(r + 1, i, d) for r, (d, i) in enumerate(found)]
    return out


def answer(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def some_rows(n, dim=12, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    return [(i, [float(f) for f in v]) for i, v in enumerate(x)]


def test_all_lists_without_tests_are_exact(spark, monkeypatch):
    monkeypatch.setattr(adaptive_scan, "BLOCK", 20)
    monkeypatch.setattr(adaptive_scan, "QUERY_BLOCK", 3)
    rows = some_rows(300)
    rows += [(1000 + i, rows[7][1]) for i in range(150)]  # one vector many times: ties, a hot list
    df = spark.createDataFrame(rows, SCHEMA)
    asked = [r for r in rows if r[0] % 7 == 0]
    got = answer(nearest(df, df.filter("vec_id % 7 = 0"), probes=64, epsilon=1e9))
    want = brute(rows, asked, 10)
    assert got.keys() == want.keys()
    for q in want:
        assert [x[:2] for x in got[q]] == [x[:2] for x in want[q]]
        assert np.allclose([x[2] for x in got[q]], [x[2] for x in want[q]], rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_of_the_query(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    rows = [(i, [float(x) for x in v]) for i, v in rows if v is not None]
    want = brute(rows, [r for r in rows if r[0] % 100 == 0], 10)
    got = answer(op13_nearest_vectors(spark, path))
    hits = sum(len({i for _, i, _ in got[q]} & {i for _, i, _ in want[q]}) for q in want)
    assert all(len(got[q]) == len(want[q]) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_tests_drop_candidates_and_keep_the_near_ones():
    x = np.random.default_rng(3).normal(size=(4000, 64)) @ rotation(64)
    q = x[:20] + 0.05
    far = np.sqrt(((q[:, None] - x[None]) ** 2).sum(axis=2))
    limit = np.sort(far, axis=1)[:, 9]
    qi, ci = scan_block(np.ascontiguousarray(q.T), np.ascontiguousarray(x.T), limit)
    found = set(zip(qi.tolist(), ci.tolist()))
    near = {(a, b) for a in range(20) for b in np.argsort(far[a])[:10].tolist()}
    assert len(near & found) >= 0.95 * len(near) and len(found) < 2 * len(near)


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]),
            (6, [float("inf"), 0.0]), (None, [1.0, 0.5]), (7, []), (8, [1.0]), (8, [1.0]), (100, [3.0, 0.0, 0.0]), (0, [0.5, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("list", F.lit("x")).withColumn("id", F.lit(1))
    got = answer(nearest(df, df.filter("vec_id % 100 = 0"), probes=64))
    assert [(r, i) for r, i, _ in got[0]] == [(1, 8), (2, 8), (3, 1), (4, 100)]  # asked with [0.5, 0]
    assert [(r, i) for r, i, _ in got[100]] == [(1, 0), (2, 8), (3, 8), (4, 1), (5, 0)]
    assert got[100][0][2] == 2.0


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA)
    assert nearest(none, none).collect() == [] and nearest(one, none).collect() == [] and nearest(none, one).collect() == []
    assert nearest(one, one).collect() == []  # a query's own row is no candidate


def test_centres():
    x = np.repeat(np.eye(4), 5, axis=0)
    assert sorted(map(tuple, fit_centres(x, 10).tolist())) == sorted(map(tuple, np.eye(4).tolist()))
    r = rotation(9)
    assert np.allclose(r @ r.T, np.eye(9))
