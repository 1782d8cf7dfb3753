"""Ranked lexical search of many queries at once, by a dual tree.

Documents are packed into blocks of sparse term vectors. Inside a block the rows are put in the
order of a tree (nearest of two far-apart members, halved again and again), so that the nodes of
every level are runs of four nodes of the level below; a node holds, for each term, the largest
impact of its documents. The queried items are packed and ordered in the same way, a node
holding the union of its items' weights. A cell of document blocks meets a tile of item blocks
in one task, which walks both trees together: the score of no document below one node for any
item below the other can be more than the inner product of their maxima, and where that is less
than the weakest k-th best score among the items, the whole batch is dropped. All sums are
integers, so the bounds are exact and no result is lost.

The walk is done twice: a sixteenth of the cells first, which gives each item a k-th best score
to start from, then the others.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gamelog.llm.common import NO_ID, id_or_none, materialize, rows_per_batch, table

DOC_BLOCK, BLOCK_TERMS = 1024, 200_000
ITEM_BLOCK, FAN = 256, 4
CELL, TILE = 8, 8
FIRST = 16
BITS = 24

# what ends a term, and A-Z to a-z, on UTF-8 bytes
_FOLD = bytes(32 if b < 128 and not chr(b).isalnum() else b + 32 if 65 <= b <= 90 else b for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Terms in order: runs of ASCII letters and digits and of all other characters, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


# ---- packing ----


def tree_order(indptr: np.ndarray, cols: np.ndarray, width: int) -> np.ndarray:
    """The rows of a sparse matrix in the order of a tree: near rows next to each other.

    A run of rows is split by two far-apart members: rows are sorted by how much more they share
    with one than with the other. Splits fall on multiples of powers of ``FAN``, so nodes are runs.
    """
    order = np.arange(len(indptr) - 1)
    todo = [(0, len(order))]
    seen = np.bincount(cols, minlength=width)
    weight = 1.0 / (1 + seen)  # what many rows hold tells little
    while todo:
        low, high = todo.pop()
        size = high - low
        if size <= FAN:
            continue
        rows = order[low:high]

        def shared(row):
            has = np.zeros(width)
            at = cols[indptr[row]:indptr[row + 1]]
            has[at] = weight[at]
            return np.add.reduceat(np.append(has[picked], 0.0), starts) * (counts > 0)

        counts = indptr[rows + 1] - indptr[rows]
        starts = np.cumsum(counts) - counts
        picked = cols[np.repeat(indptr[rows] - starts, counts) + np.arange(counts.sum())]
        one = rows[np.argmin(shared(rows[0]))]
        near_one = shared(one)
        other = rows[np.argmin(near_one)]
        order[low:high] = rows[np.argsort(near_one - shared(other), kind="stable")]
        part = FAN
        while part * 2 < size:
            part *= 2
        todo += [(low, low + part), (low + part, high)]
    return order


def take_rows(indptr, cols, values, rows):
    """The given rows of a sparse matrix."""
    counts = indptr[rows + 1] - indptr[rows]
    out = np.concatenate(([0], np.cumsum(counts)))
    at = np.repeat(indptr[rows] - out[:-1], counts) + np.arange(out[-1])
    return out, cols[at], values[at]


_DOC_BLOCK = "docs long, length long, ids binary, sizes binary, starts binary, cols binary, tf binary, terms binary"


class _Block:
    """Rows gathered into one block of sparse vectors."""

    def __init__(self):
        self.docs = self.length = 0
        self.ids, self.sizes, self.counts, self.cols, self.tf, self.names = [], [], [], [], [], {}

    def add(self, doc, size, found):
        if found:
            self.ids.append(doc)
            self.sizes.append(size)
            self.counts.append(len(found))
            names = self.names
            self.cols += [names.setdefault(t, len(names)) for t in found]
            self.tf += found.values()

    def frame(self):
        starts = np.concatenate(([0], np.cumsum(self.counts))).astype(np.int64)
        cols, tf = np.array(self.cols, np.int32), np.array(self.tf, np.int32)
        order = tree_order(starts, cols, len(self.names))
        starts, cols, tf = take_rows(starts, cols, tf, order)
        flat = [np.array(self.ids, np.int64)[order], np.array(self.sizes, np.int64)[order], starts, cols, tf]
        return pd.DataFrame([(self.docs, self.length, *(a.tobytes() for a in flat), b" ".join(self.names))],
                            columns=["docs", "length", "ids", "sizes", "starts", "cols", "tf", "terms"])


def _pack_docs(bits):
    def run(frames):
        flags, known, block = bits.value, {}, _Block()
        for frame in frames:
            for doc, text in zip(frame["id"], frame["text"]):
                terms = terms_of(text)
                if not terms:
                    continue
                if len(known) > 1_000_000:
                    known.clear()
                found = {}
                for t in terms:
                    ok = known.get(t)
                    if ok is None:
                        cut = zlib.crc32(t) & ((1 << BITS) - 1)
                        ok = known[t] = bool(flags[cut >> 3] >> (cut & 7) & 1)
                    if ok:
                        found[t] = found.get(t, 0) + 1
                block.docs += 1
                block.length += len(terms)
                block.add(doc, len(terms), found)
                if len(block.ids) >= DOC_BLOCK or len(block.cols) >= BLOCK_TERMS:
                    yield block.frame()
                    block = _Block()
        if block.docs:
            yield block.frame()
    return run


def _block_terms(frames):
    """How many documents of a block hold each of its terms."""
    for frame in frames:
        for names, cols, n in zip(frame["terms"], frame["cols"], frame["ids"]):
            if len(n):
                names = names.split(b" ")
                yield pd.DataFrame({"term": names, "df": np.bincount(np.frombuffer(cols, np.int32), minlength=len(names))})


def _item_terms(frames):
    for frame in frames:
        out = [(item, t) for item, text in zip(frame["id"], frame["text"]) for t in set(terms_of(text))]
        yield pd.DataFrame(out, columns=["item_id", "term"])


def term_map(terms: DataFrame) -> np.ndarray:
    """One flag per value of the last 24 bits of a term's crc32: 2 MB, whatever the number of terms."""
    cut = F.crc32("term").bitwiseAND((1 << BITS) - 1)
    rows = terms.select(F.shiftright(cut, 6).alias("at"), cut.bitwiseAND(63).cast("int").alias("bit")).groupBy(
        "at").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toPandas()
    bits = np.zeros(1 << (BITS - 6), np.int64)
    bits[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return bits.view(np.uint8)


_ITEM_BLOCK = "ids binary, starts binary, cols binary, weights binary, kth binary, terms binary"


def _pack_items(frame: pd.DataFrame) -> pd.DataFrame:
    names: dict[bytes, int] = {}
    counts = [len(t) for t in frame["terms"]]
    cols = np.array([names.setdefault(t, len(names)) for ts in frame["terms"] for t in ts], np.int32)
    weights = np.concatenate([np.asarray(w, np.int64) for w in frame["weights"]])
    starts = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
    order = tree_order(starts, cols, len(names))
    starts, cols, weights = take_rows(starts, cols, weights, order)
    flat = [frame["item_id"].to_numpy(np.int64)[order], starts, cols, weights, frame["kth"].to_numpy(np.int64)[order]]
    return pd.DataFrame([(*(a.tobytes() for a in flat), b" ".join(names))],
                        columns=["ids", "starts", "cols", "weights", "kth", "terms"])


# ---- trees and their walk ----


def levels(starts, cols, values):
    """Coordinate maxima of a tree: level 0 the rows themselves, each next one of runs of ``FAN`` nodes."""
    out = [(starts, cols, values)]
    while len(starts) > 2:
        node = np.repeat(np.arange(len(starts) - 1) // FAN, np.diff(starts))
        order = np.lexsort((cols, node))
        node, cols, values = node[order], cols[order], values[order]
        new = np.flatnonzero(np.concatenate(([True], (np.diff(node) != 0) | (np.diff(cols) != 0)))[:len(node)])
        values = np.maximum.reduceat(values, new) if len(new) else values
        node, cols = node[new], cols[new]
        starts = np.searchsorted(node, np.arange((len(starts) - 2) // FAN + 2))
        out.append((starts, cols, values))
    return out


def impacts(tf, size, docs: int, length: int):
    """What an occurrence count is worth in a document of ``size`` terms, times 1,000,000 / 1,000."""
    m = 100 - 50 + (50 * size * docs) // length
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class Best:
    """The ``k`` best documents of one item so far: highest score, then smallest id."""

    def __init__(self, k: int, kth: int):
        self.k, self.kth, self.score, self.doc = k, kth, np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, score, doc):
        score, doc = np.concatenate((self.score, score)), np.concatenate((self.doc, doc))
        keep = np.lexsort((doc, -score))[:self.k]
        self.score, self.doc = score[keep], doc[keep]
        if len(keep) == self.k:
            self.kth = max(self.kth, int(self.score[-1]))


def walk(items, docs, doc_ids, best: list[Best], width: int) -> int:
    """Find the best documents of all items by both trees; returns the number of exact scores.

    ``items`` and ``docs`` are ``levels`` over the same ``width`` columns.
    """
    scored = 0
    dense = np.zeros(width, np.int64)
    per = [FAN ** level for level in range(len(items))]

    def bound(level, nodes):
        starts, cols, values = docs[level]
        first, counts = starts[nodes], starts[nodes + 1] - starts[nodes]
        ends = np.cumsum(counts)
        at = np.repeat(first - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)
        sums = np.concatenate(([0], np.cumsum(dense[cols[at]] * values[at])))
        return sums[ends] - sums[ends - counts]

    todo = [(len(items) - 1, 0, len(docs) - 1, np.zeros(1, np.int64))]
    while todo:
        up, node, level, nodes = todo.pop()
        own = best[node * per[up]:(node + 1) * per[up]]
        weakest = min(b.kth for b in own)
        starts, cols, values = items[up]
        span = slice(starts[node], starts[node + 1])
        dense[cols[span]] = values[span]
        most = bound(level, nodes)
        dense[cols[span]] = 0
        keep = (most >= weakest) & (most > 0)
        nodes, most = nodes[keep], most[keep]
        if not len(nodes):
            continue
        if level == 0 and up == 0:
            scored += len(nodes)
            named = doc_ids[nodes] != NO_ID
            own[0].add(most[named], doc_ids[nodes][named])
            continue
        if level and level >= up:
            level -= 1
            size = len(docs[level][0]) - 1
            nodes = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
            nodes = nodes[nodes < size]
            todo.append((up, node, level, nodes))
        else:
            size = len(items[up - 1][0]) - 1
            todo += [(up - 1, child, level, nodes) for child in range(node * FAN, min((node + 1) * FAN, size))]
    return scored


def _search(k: int, docs: int, length: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left):
            for item in right.itertuples(index=False):
                names = {t: i for i, t in enumerate(item.terms.split(b" "))}
                starts, cols = np.frombuffer(item.starts, np.int64), np.frombuffer(item.cols, np.int32)
                item_tree = levels(starts, cols, np.frombuffer(item.weights, np.int64))
                best = [Best(k, kth) for kth in np.frombuffer(item.kth, np.int64).tolist()]
                for doc in left[left["ids"].str.len() > 0].itertuples(index=False):
                    place = np.array([names.get(t, -1) for t in doc.terms.split(b" ")], np.int64)
                    first, at = np.frombuffer(doc.starts, np.int64), place[np.frombuffer(doc.cols, np.int32)]
                    value = impacts(np.frombuffer(doc.tf, np.int32).astype(np.int64),
                                    np.repeat(np.frombuffer(doc.sizes, np.int64), np.diff(first)), docs, length)
                    has = at >= 0
                    first = np.concatenate(([0], np.cumsum(has)))[first]
                    walk(item_tree, levels(first, at[has], value[has]), np.frombuffer(doc.ids, np.int64), best, len(names))
                ids = np.frombuffer(item.ids, np.int64)
                out += [pd.DataFrame({"item_id": i, "doc_id": b.doc, "score": b.score}) for i, b in zip(ids, best) if len(b.doc)]
        return pd.concat(out) if out else pd.DataFrame({c: np.empty(0, np.int64) for c in ("item_id", "doc_id", "score")})
    return run


# ---- the operator ----


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` highest-scoring rows of ``docs`` for each of ``items``: item_id, rank, doc_id, score.

    A document scores, for each different term of the item, weight x impact: the weight falls
    with the number of documents holding the term, the impact grows with its occurrences and
    falls with the document's length, all in integers. Ranks start at 1; equal scores go to the
    smaller doc_id; a score of 0 is not listed.

    - Texts that are null, empty or without terms have no terms and count in no statistic.
    - Documents without an id count in the statistics and are not listed; rows repeating a doc_id
      are documents each.
    - Items without an id or terms give no rows; rows repeating an item_id are one item with the
      terms of all.
    - Empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows_per_batch(spark)
    asked = materialize(items.select(F.col("item_id").cast("long").alias("id"), "text").filter("id IS NOT NULL")
                        .mapInPandas(_item_terms, "item_id long, term binary").distinct(), "item-terms")
    bits = spark.sparkContext.broadcast(term_map(asked))
    # texts are read and cut into terms once; what the items do not hold stays out
    blocks = materialize(docs.select(id_or_none("doc_id").alias("id"), "text").mapInPandas(_pack_docs(bits), _DOC_BLOCK),
                         "doc-blocks")
    total = blocks.agg(F.sum("docs"), F.sum("length"), F.count(F.lit(1))).first()
    n_docs, length, n_blocks = (int(x or 0) for x in total)
    held = blocks.select("terms", "cols", "ids").mapInPandas(_block_terms, "term binary, df long").groupBy("term").agg(
        F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(float(n_docs)) + 2) / (2 * F.col("df").cast("double") + 1))).cast("long")
    weighted = materialize(asked.join(held, "term").groupBy("item_id").agg(
        F.collect_list(F.struct("term", weight.alias("w"))).alias("t")).select(
        "item_id", F.col("t.term").alias("terms"), F.col("t.w").alias("weights")), "weighted-items")
    n_items = weighted.count()
    cells, groups = -(-n_blocks // CELL) or 1, -(-n_items // ITEM_BLOCK) or 1
    tiles = -(-groups // TILE)

    def each(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    dealt = blocks.withColumn("cell", F.pmod(F.xxhash64("ids", "cols"), F.lit(cells)).cast("int"))
    dealt = dealt.select("cell", each(tiles).alias("tile"), "ids", "sizes", "starts", "cols", "tf", "terms")

    def search(of_cells, kth):
        packed = weighted.join(kth, "item_id", "left").select(
            "item_id", "terms", "weights", F.coalesce("kth", F.lit(0).cast("long")).alias("kth"),
            F.pmod(F.xxhash64("item_id"), F.lit(groups)).cast("int").alias("g")).groupBy("g").applyInPandas(
            _pack_items, _ITEM_BLOCK)
        packed = packed.withColumn("tile", F.pmod(F.xxhash64("ids"), F.lit(tiles)).cast("int")).withColumn(
            "cell", each(cells)).filter(of_cells)
        return materialize(dealt.filter(of_cells).groupBy("cell", "tile").cogroup(
            packed.groupBy("cell", "tile")).applyInPandas(
            _search(k, n_docs, max(length, 1)), "item_id long, doc_id long, score long"), "ranked")

    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")

    def ranked(rows):
        return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    first = search(F.col("cell") % FIRST == 0, spark.createDataFrame([], "item_id long, kth long"))
    kth = ranked(first).filter(F.col("rank") == k).select("item_id", F.col("score").alias("kth"))
    rest = search(F.col("cell") % FIRST != 0, kth)
    return ranked(first.unionByName(rest)).select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    """Fifty best documents of every benchmark item."""
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = ("regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")

OP11_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS row_no, doc_id, {_TERMS} AS terms FROM documents),
size AS (SELECT row_no, doc_id, CAST(len(terms) AS BIGINT) AS n FROM d WHERE len(terms) > 0),
total AS (SELECT count(*) AS docs, CAST(coalesce(sum(n), 0) AS BIGINT) AS length FROM size),
wanted AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL),
tf AS (
  SELECT row_no, term, count(*) AS tf FROM (SELECT row_no, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM wanted) GROUP BY row_no, term),
weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * CAST(docs AS DOUBLE) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, total GROUP BY term, docs),
impact AS (
  SELECT row_no, term, doc_id,
         (1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // length))) AS impact
  FROM tf JOIN size USING (row_no), total WHERE doc_id IS NOT NULL),
s AS (
  SELECT item_id, row_no, doc_id, CAST(sum(w * impact) AS BIGINT) AS score
  FROM wanted JOIN weight USING (term) JOIN impact USING (term) GROUP BY item_id, row_no, doc_id),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""
