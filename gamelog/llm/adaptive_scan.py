"""Approximate nearest neighbours by an adaptive dimension scan of probed lists.

Vectors are turned by one random rotation, so that any few of their dimensions are a fair sample
of all, and dealt to the list of their nearest centre. A list is stored in blocks, each dimension
by dimension (column blocks). A query reads the lists of its nearest centres; there the squared
distance to all candidates of a block grows by some dimensions at a time, and after each step a
test of the hypothesis "this candidate is nearer than the query's k-th best" rejects those whose
partial distance, scaled to all dimensions, is too large for it by more than ``EPSILON`` standard
errors. The others go on; whoever reaches the last dimension is measured exactly, on the
original vectors.

A query meets the list of its nearest centre first; the k-th best distance found there is where
the test starts in the other lists.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gamelog.llm.common import materialize, table

#: Vectors, by hash of the id, on which the centres are fitted; every vector is indexed.
SAMPLE = 16_384
CENTRES, PROBES = 64, 48
EPSILON, STEP = 2.1, 16
BLOCK, QUERY_BLOCK = 1024, 256
ROUNDS, SEED = 12, 20240716


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def _square(vectors, dim: int) -> np.ndarray:
    """Vectors as rows of ``dim`` doubles, shorter ones ending in zeros."""
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres, up to a term that is the same within a row."""
    return (centres * centres).sum(axis=1) - 2 * (x @ centres.T)


def fit_centres(sample: np.ndarray, count: int = CENTRES, seed: int = SEED) -> np.ndarray:
    """k-means on a sample; empty clusters start again at far points."""
    different = np.unique(sample, axis=0)
    rng = np.random.default_rng(seed)
    count = max(1, min(count, len(different)))
    centres = different[rng.choice(len(different), count, replace=False)] if len(different) else sample[:0]
    for _ in range(ROUNDS if len(different) else 0):
        gap = _gaps(sample, centres)
        own = gap.argmin(axis=1)
        size = np.bincount(own, minlength=count)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
        empty = np.flatnonzero(size == 0)
        if len(empty):
            far = np.argsort(-(gap[np.arange(len(sample)), own] + (sample * sample).sum(axis=1)), kind="stable")
            centres[empty] = sample[far[:len(empty)]]
    return centres


def _assign(shared, probes: int):
    """Each row's nearest lists, nearest first, of ``probes``."""
    def run(frames):
        centres, dim = shared.value
        for frame in frames:
            if not len(frame):
                continue
            x = _square(frame["v"], dim)
            near = np.argsort(_gaps(x, centres), axis=1, kind="stable")[:, :probes]
            yield pd.DataFrame({"id": np.repeat(frame["id"].to_numpy(np.int64), near.shape[1]),
                                "list": near.ravel().astype(np.int32),
                                "probe": np.tile(np.arange(near.shape[1], dtype=np.int32), len(frame)),
                                "v": np.repeat(frame["v"].to_numpy(), near.shape[1])})
    return run


_BLOCK = "list int, part int, n int, ids binary, plain binary, turned binary"


def _pack(dim: int, limit: int):
    """Rows that come sorted by (list, part) to blocks: ids, vectors, and rotated dimensions by column."""
    turn = rotation(dim)

    def frame(place, rows):
        x = _square([v for _, v in rows], dim)
        ids = np.array([i for i, _ in rows], np.int64)
        return pd.DataFrame([(*place, len(rows), ids.tobytes(), x.tobytes(), np.ascontiguousarray((x @ turn).T).tobytes())],
                            columns=["list", "part", "n", "ids", "plain", "turned"])

    def run(frames):
        place, rows = None, []
        for part in frames:
            for at_list, at_part, i, v in zip(part["list"], part["part"], part["id"], part["v"]):
                if rows and (place != (at_list, at_part) or len(rows) >= limit):
                    yield frame(place, rows)
                    rows = []
                place = at_list, at_part
                rows.append((i, v))
        if rows:
            yield frame(place, rows)
    return run


def exact_distances(query: np.ndarray, cand: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows, squares added dimension by dimension."""
    total = np.zeros(len(query))
    for j in range(query.shape[1]):
        total += (query[:, j] - cand[:, j]) ** 2
    return np.sqrt(total)


def scan_block(query: np.ndarray, cand: np.ndarray, limit: np.ndarray, epsilon: float = EPSILON, step: int = STEP):
    """Pairs (query index, candidate index) that no test rejects.

    ``query`` and ``cand`` are rotated, (dimensions, rows); ``limit`` has each query's k-th best
    distance so far (inf if none).
    """
    dim = len(cand)
    part = np.zeros((query.shape[1], cand.shape[1]))
    pairs = None
    for at in range(0, dim, step):
        to = min(at + step, dim)
        if pairs is None:
            q, c = query[at:to], cand[at:to]
            part += (q * q).sum(axis=0)[:, None] + (c * c).sum(axis=0) - 2 * (q.T @ c)
        else:
            qi, ci, got = pairs
            got = got + ((query[at:to, qi] - cand[at:to, ci]) ** 2).sum(axis=0)
            pairs = qi, ci, got
        # after s of d dimensions the distance is about sqrt(d / s) times the partial one; at the
        # end only rounding is left open
        slack = 1 + epsilon / math.sqrt(to) if to < dim else 1 + 1e-9
        most = limit * limit * (slack * slack * to / dim) + 1e-12
        if pairs is None:
            qi, ci = np.nonzero(part <= most[:, None])
            pairs = qi, ci, part[qi, ci]
        else:
            qi, ci, got = pairs
            keep = got <= most[qi]
            pairs = qi[keep], ci[keep], got[keep]
    return pairs[:2] if pairs else (np.empty(0, int), np.empty(0, int))


def _search(k: int, dim: int, epsilon: float, step: int):
    def run(frames):
        limits: dict[bytes, np.ndarray] = {}
        for frame in frames:
            for r in frame.itertuples(index=False):
                ids, qids = np.frombuffer(r.ids, np.int64), np.frombuffer(r.q_ids, np.int64)
                plain, q_plain = (np.frombuffer(b).reshape(-1, dim) for b in (r.plain, r.q_plain))
                turned, q_turned = (np.frombuffer(b).reshape(dim, -1) for b in (r.turned, r.q_turned))
                if len(limits) > 1000:
                    limits.clear()
                limit = limits.setdefault(r.q_ids, np.frombuffer(r.q_limits).copy())
                if len(ids) > k and np.isinf(limit).any():
                    # a first k-th best from a few candidates measured whole
                    some = np.linspace(0, len(ids) - 1, min(len(ids), 4 * k + 1)).astype(int)
                    far = exact_distances(np.repeat(q_plain, len(some), axis=0), np.tile(plain[some], (len(qids), 1)))
                    far = np.where(qids[:, None] == ids[some], np.inf, far.reshape(len(qids), -1))
                    np.minimum(limit, np.partition(far, k - 1, axis=1)[:, k - 1], out=limit)
                qi, ci = scan_block(q_turned, turned, limit, epsilon, step)
                other = qids[qi] != ids[ci]
                qi, ci = qi[other], ci[other]
                score = exact_distances(q_plain[qi], plain[ci])
                order = np.lexsort((ids[ci], score, qi))
                qi, ci, score = qi[order], ci[order], score[order]
                place = np.arange(len(qi)) - np.searchsorted(qi, qi)
                kth = place == k - 1
                np.minimum.at(limit, qi[kth], score[kth])
                top = place < k
                yield pd.DataFrame({"query_id": qids[qi[top]], "vec_id": ids[ci[top]], "score": score[top]})
    return run


def _pack_queries(dim: int):
    """Queries of one list to blocks; ``limit`` has what is known of their k-th best distance."""
    turn = rotation(dim)

    def run(frames):
        for frame in frames:
            for at_list, rows in frame.groupby("list", sort=True):
                for at in range(0, len(rows), QUERY_BLOCK):
                    part = rows.iloc[at:at + QUERY_BLOCK]
                    x = _square(part["v"], dim)
                    yield pd.DataFrame([(at_list, part["id"].to_numpy(np.int64).tobytes(), x.tobytes(),
                                         np.ascontiguousarray((x @ turn).T).tobytes(),
                                         part["limit"].to_numpy(np.float64).tobytes())],
                                       columns=["list", "q_ids", "q_plain", "q_turned", "q_limits"])
    return run


def nearest(df: DataFrame, queries: DataFrame, k: int = 10, probes: int = PROBES, centres: int = CENTRES,
            sample: int = SAMPLE, epsilon: float = EPSILON, step: int = STEP, id_col: str = "vec_id",
            vec_col: str = "embedding") -> DataFrame:
    """About the ``k`` nearest rows of ``df`` for each row of ``queries``: query_id, rank, vec_id, score.

    ``score`` is the Euclidean distance of the original vectors; equal ones go to the smaller
    vec_id, and a query's own id is no candidate. ``probes`` lists of ``centres`` are read, so a
    neighbour may be missed; a candidate nearer than the k-th best is wrongly rejected by a test
    with small probability (less for larger ``epsilon``). With all lists probed and an infinite
    ``epsilon`` the result is exact.

    - Vectors that are null, all zero, empty or hold a null or non-finite component, and rows
      without an id, take no part. Shorter vectors are compared as if they ended in zeros.
    - Rows repeating an id count as candidates each; a repeated query id is asked once, with its
      smallest vector.
    - Fewer than ``k`` other rows in the probed lists give fewer results, empty tables none; other
      columns are ignored.
    """
    spark = df.sparkSession
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    def part(t):
        return t.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter(
            F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", good) & F.exists("v", lambda x: x != 0))

    rows = part(df)
    asked = part(queries).groupBy("id").agg(F.min("v").alias("v"))
    width = rows.agg(F.max(F.size("v")).alias("d")).unionAll(asked.agg(F.max(F.size("v")))).agg(F.max("d")).first()[0]
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = int(width)
    picked = rows.orderBy(F.xxhash64("id"), "id", "v").limit(sample).toPandas()
    shared = spark.sparkContext.broadcast((fit_centres(_square(picked["v"], dim), centres), dim))
    lists = rows.mapInPandas(_assign(shared, 1), "id long, list int, probe int, v array<double>")
    placed = materialize(lists, "lists")
    # long lists are cut into parts of about a block, so that no task has a whole one
    sizes = placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    cut = placed.withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(sizes), "list").withColumn(
        "part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    blocks = materialize(cut.repartition("list", "part").sortWithinPartitions("list", "part", "id")
                         .select("list", "part", "id", "v").mapInPandas(_pack(dim, 2 * BLOCK), _BLOCK), "blocks")
    probing = materialize(asked.mapInPandas(_assign(shared, probes), "id long, list int, probe int, v array<double>"), "probes")
    deals = probing.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / (16 * QUERY_BLOCK)).cast("int").alias("deals"))

    def search(of, limits):
        dealt = of.join(limits, "id", "left").join(F.broadcast(deals), "list").select(
            "list", "id", "v", F.coalesce("limit", F.lit(float("inf"))).alias("limit"),
            F.pmod(F.xxhash64("id"), F.col("deals")).alias("deal"))
        packed = dealt.repartition("list", "deal").sortWithinPartitions("list", "deal", "id").drop("deal").mapInPandas(
            _pack_queries(dim), "list int, q_ids binary, q_plain binary, q_turned binary, q_limits binary")
        reached = packed.join(F.broadcast(sizes), "list").withColumn(
            "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        return blocks.join(reached, ["list", "part"]).mapInPandas(
            _search(k, dim, epsilon, step), "query_id long, vec_id long, score double")

    best = Window.partitionBy("query_id").orderBy("score", "vec_id")

    def ranked(found):
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    first = materialize(search(probing.filter("probe = 0"), spark.createDataFrame([], "id long, limit double")), "first")
    limits = ranked(first).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("limit"))
    rest = search(probing.filter("probe > 0"), limits)
    return ranked(first.unionByName(rest)).select("query_id", "rank", "vec_id", "score")


def op13_nearest_vectors(spark, sf_dir: str) -> DataFrame:
    """Ten nearest rows of every hundredth vector."""
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.filter(F.col("vec_id") % 100 == 0))
