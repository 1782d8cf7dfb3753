"""Exact top-k inner-product search by columnar branch and bound.

Candidates are packed into blocks in vertical layout (one row per dimension). A block of
queries meets every block of candidates once; inside the pair, inner products accumulate a few
dimensions at a time, and after each step the pairs whose score plus the most that their
remaining dimensions can add (Cauchy-Schwarz on the remaining mass) stays below the query's
current k-th best are dropped, and the survivors are compacted. Each pair of blocks hands on
at most k rows a query, so the final ranking reads little.

The blocks meet in tiles: a tile has a cell of the candidates' blocks and a part of the
queries' blocks. A task holds the queries' blocks of its tile and reads the candidates' blocks
past them. Both sides are sent by one shuffle and never broadcast.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gamelog.llm.common import materialize, table

CAND_BLOCK, QUERY_BLOCK, DIM_BLOCK = 1024, 512, 16
# blocks of candidates in a cell: CELL until there are CELLS cells, then up to LARGE_CELL; components of queries in a part
CELL, LARGE_CELL, CELLS, PART = 8, 64, 48, 1 << 21
_EXACT = float(1 << 53)
_BLOCK = "n long, dim long, kind string, ids binary, data binary"


def _packed(data: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them all."""
    most = np.abs(data).max(initial=0)
    return data.astype(next((t for t in (np.int16, np.int32) if most <= np.iinfo(t).max), np.float64))


def _pack(limit: int):
    """Rows to blocks of ``limit``, whatever the batches they come in."""
    def block(rows):
        dim = max(map(len, rows["v"]), default=0)
        data = np.zeros((dim, len(rows)))
        for i, v in enumerate(rows["v"]):
            data[:len(v), i] = np.floor(256.0 * np.asarray(v, np.float64))
        data = _packed(data)
        return pd.DataFrame({"n": [len(rows)], "dim": [dim], "kind": [data.dtype.name],
                             "ids": [rows["id"].to_numpy(np.int64).tobytes()], "data": [data.tobytes()]})

    def run(frames):
        rest = None
        for frame in frames:
            rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            while len(rest) >= limit:
                yield block(rest.iloc[:limit])
                rest = rest.iloc[limit:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield block(rest)
    return run


def _wide(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether sums of products may leave the integers that a double holds exactly."""
    return a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * len(a) >= _EXACT


def search_block(ids, cand, qids, query, bound, k):
    """Best ``k`` of a candidate block for each query: arrays (query index, id, score).

    ``cand`` and ``query`` are (dimensions, rows); ``bound`` has each query's k-th best score so
    far (-inf if none) and is raised in place.
    """
    dim = max(len(cand), len(query))
    cand, query = (np.pad(m, ((0, dim - len(m)), (0, 0))) for m in (cand, query))
    if _wide(query, cand):
        whole = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
        score = whole(query).T @ whole(cand)
        qi, ci = np.nonzero(qids[:, None] != ids[None, :])
        if any(abs(x) >= 1 << 63 for x in score[qi, ci]):
            raise OverflowError("an inner product does not fit a long")
        return _best(qi, ci, score[qi, ci], ids, k)
    starts = range(0, dim, DIM_BLOCK)
    mass = lambda m: np.sqrt(np.cumsum((m * m)[::-1], axis=0)[::-1])
    c_mass, q_mass = mass(cand), mass(query)
    # a first k-th best for each query, from a few candidates scored whole; from all if it has none yet
    seen = len(ids) if np.isneginf(bound).any() else min(4 * k, len(ids))
    first = query.T @ cand[:, :seen]
    first[qids[:, None] == ids[None, :seen]] = -np.inf
    if seen >= k:
        np.maximum(bound, np.partition(first, seen - k, axis=1)[:, seen - k], out=bound)
    acc = np.zeros((len(qids), len(ids)))
    pairs = None
    for at in starts:
        to = min(at + DIM_BLOCK, dim)
        if pairs is None:
            acc += query[at:to].T @ cand[at:to]
        else:
            qi, ci, got = pairs
            got += np.einsum("ij,ij->j", query[at:to, qi], cand[at:to, ci])
        if to == dim:
            break
        # a hair of slack: square roots are rounded
        if pairs is None:
            alive = acc + np.outer(q_mass[to], c_mass[to]) * (1 + 1e-9) >= bound[:, None]
            if alive.mean() < 0.25:
                qi, ci = np.nonzero(alive)
                pairs = qi, ci, acc[qi, ci]
        else:
            keep = got + q_mass[to, qi] * c_mass[to, ci] * (1 + 1e-9) >= bound[qi]
            pairs = qi[keep], ci[keep], got[keep]
    if pairs is None:
        qi, ci = np.nonzero(acc >= bound[:, None])
        pairs = qi, ci, acc[qi, ci]
    qi, ci, got = pairs
    keep = (qids[qi] != ids[ci]) & (got >= bound[qi])
    qi, found, score = _best(qi[keep], ci[keep], got[keep], ids, k)
    last = np.flatnonzero(np.diff(np.append(qi, -1)))  # the worst of each query's best
    full = last[(last >= k - 1) & (qi[np.maximum(last - k + 1, 0)] == qi[last])]
    np.maximum.at(bound, qi[full], score[full].astype(float))
    return qi, found, score


def _best(qi, ci, score, ids, k):
    """The ``k`` best rows of each query, by score and then smaller id."""
    if score.dtype == object:  # beyond the integers of a double
        order = np.array(sorted(range(len(qi)), key=lambda i: (qi[i], -score[i], ids[ci[i]])), int)
    else:
        order = np.lexsort((ids[ci], -score, qi))
    qi, ci, score = qi[order], ci[order], score[order]
    top = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
    return qi[top], ids[ci[top]], score[top].astype(np.int64)


def _search(k: int):
    """Tiles to their queries' best rows: in a tile, the queries' blocks come first."""
    def run(frames):
        tile, asked = None, []
        for frame in frames:
            for r in frame.itertuples(index=False):
                if r.tile != tile:
                    tile, asked = r.tile, []
                ids = np.frombuffer(r.ids, np.int64)
                rows = np.frombuffer(r.data, r.kind).reshape(r.dim, r.n)
                if not r.turn:
                    asked.append((ids, rows, np.full(len(ids), -np.inf)))
                    continue
                cand = rows.astype(float)
                for qids, query, bound in asked:
                    qi, found, score = search_block(ids, cand, qids, query.astype(float), bound, k)
                    yield pd.DataFrame({"query_id": qids[qi], "vec_id": found, "score": score})
    return run


def _cells(blocks: int) -> int:
    """Cells for so many blocks of candidates."""
    return max(-(-blocks // LARGE_CELL), min(-(-blocks // CELL), CELLS), 1)


def top_k(df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id",
          vec_col: str = "embedding") -> DataFrame:
    """The ``k`` rows of ``df`` with the largest inner product for each row of ``queries``.

    Components become floor(256 * x). Returns query_id, rank (from 1), vec_id, score; ties go
    to the smaller vec_id, and a query's own id is no candidate. Vectors that are null or hold a
    null or non-finite component, and rows without an id, take no part. Vectors of different
    lengths are compared as if the shorter one ended in zeros; a score beyond a long raises. Rows repeating an id count as
    candidates each; a repeated query id is asked once, with its smallest vector. Empty tables
    give no rows; other columns are ignored.
    """
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    part = lambda t: t.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", good))
    # blocks get a place to be dealt by: their ids may repeat
    blocks = lambda t, limit, tag: materialize(t.mapInPandas(_pack(limit), _BLOCK).withColumn(
        "place", F.xxhash64(F.monotonically_increasing_id())), tag)
    cand = blocks(part(df), CAND_BLOCK, "candidates")
    asked = blocks(part(queries).groupBy("id").agg(F.min("v").alias("v")), QUERY_BLOCK, "queries")
    cells = _cells(cand.count())
    parts = -(-(asked.agg(F.sum(F.col("n") * F.col("dim"))).first()[0] or 0) // PART) or 1
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod("place", F.lit(n)).cast("int")
    dealt = (asked.withColumns({"turn": F.lit(0), "part": own(parts)}).withColumn("cell", each(cells))
             .unionByName(cand.withColumns({"turn": F.lit(1), "cell": own(cells)}).withColumn("part", each(parts))))
    tiles = (dealt.withColumn("tile", F.col("part") * cells + F.col("cell")).drop("place", "part", "cell")
             .repartitionById(parts * cells, "tile").sortWithinPartitions("tile", "turn"))
    found = tiles.mapInPandas(_search(k), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op3_topk_search(spark, sf_dir: str) -> DataFrame:
    """Five nearest rows of every 50th vector."""
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.filter(F.col("vec_id") % 50 == 0))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER)
        AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
