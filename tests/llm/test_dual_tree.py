"""Dual-tree lexical search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from gamelog.llm import dual_tree
from gamelog.llm.dual_tree import Best, levels, rank_documents, take_rows, terms_of, tree_order, walk

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_rank(docs, items, k):
    counts = [(d, Counter(plain_terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(plain_terms(text))
    out = []
    for item, terms in asked.items():
        found = []
        for doc, c in counts:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0 and doc is not None:
                found.append((-score, doc))
        out += [(item, r + 1, doc, -s) for r, (s, doc) in enumerate(sorted(found)[:k])]
    return sorted(out)


def ranked(spark, docs, items, k):
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string")
    return sorted(tuple(r) for r in rank_documents(docs, items, k).collect())


def some_texts(rng, n, words):
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_terms():
    assert [t.decode() for t in terms_of("Ab-cÉd 1x\n_É\x00")] == ["ab", "cÉd", "1x", "É"]
    for text in ("", None, " \t--", "naïve Ünï 你好,世界 a b"):
        assert [t.decode() for t in terms_of(text)] == plain_terms(text)


@pytest.mark.parametrize("seed", range(2))
def test_equals_scoring_everything(spark, monkeypatch, seed):
    # small blocks, so that there are several cells, tiles and both walks
    monkeypatch.setattr(dual_tree, "DOC_BLOCK", 40)
    monkeypatch.setattr(dual_tree, "ITEM_BLOCK", 7)
    monkeypatch.setattr(dual_tree, "TILE", 2)
    monkeypatch.setattr(dual_tree, "CELL", 1)
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Été", "the", "The", "of"] * 5
    docs = list(enumerate(some_texts(rng, 400, words)))
    docs += [(i, docs[5][1]) for i in range(2000, 2200)]  # many copies: ties
    docs += [(None, "w1 w2"), (7, "w1 w1"), (7, "w1 w1"), (9000, None), (9001, " - "), (9002, "w3 " * 5000)]
    items = list(enumerate(some_texts(rng, 40, words))) + [(3, "w7 w8"), (None, "w1"), (90, None), (91, "unseen"), (92, docs[5][1])]
    assert ranked(spark, docs, items, 5) == plain_rank(docs, items, 5)


def test_empty_tables_and_clashing_names(spark):
    assert ranked(spark, [], [(1, "a")], 5) == []
    assert ranked(spark, [(1, "a b")], [], 5) == []
    rows = [(i, "z", "y", 3) for i in range(10, 20)]
    docs = spark.createDataFrame([(1, "a b", "x", 2), (2, "b", "y", 3), *rows], "doc_id long, text string, term string, kth int")
    items = spark.createDataFrame([(5, "B c", "q")], "item_id long, text string, cell string")
    got = [(r.item_id, r.rank, r.doc_id) for r in rank_documents(docs, items).orderBy("rank").collect()]
    assert got == [(5, 1, 2), (5, 2, 1)]


def test_bounds_drop_whole_batches():
    """Documents on two subjects: those of the other subject are never scored."""
    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 30, 12)) + 30 * (i % 2) for i in range(512)]
    starts = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    cols, values = np.concatenate(rows), rng.integers(1, 1000, starts[-1])
    order = tree_order(starts, cols, 60)
    assert sorted(order) == list(range(512))
    starts, cols, values = take_rows(starts, cols, values, order)
    item = levels(np.array([0, 4]), np.array([1, 5, 9, 20]), np.array([900, 800, 700, 600]))
    best = [Best(10, 0)]
    scored = walk(item, levels(starts, cols, values), np.arange(512), best, 60)
    dense = np.zeros((512, 60), np.int64)
    dense[np.repeat(np.arange(512), np.diff(starts)), cols] = values
    score = dense[:, [1, 5, 9, 20]] @ np.array([900, 800, 700, 600])
    want = np.lexsort((np.arange(512), -score))[:10]
    assert best[0].doc.tolist() == want.tolist() and best[0].score.tolist() == score[want].tolist()
    assert scored <= 256


def test_a_known_kth_score_drops_most():
    rng = np.random.default_rng(6)
    starts = np.arange(0, 4096 * 8 + 1, 8)
    values = rng.integers(1, 1000, 4096 * 8)
    cols = np.concatenate([np.sort(rng.choice(400, 8, replace=False)) for _ in range(4096)])
    tree = levels(starts, cols, values)
    item = levels(np.array([0, 3]), np.array([3, 50, 333]), np.array([5, 9, 7]))
    free = [Best(5, 0)]
    all_scored = walk(item, tree, np.arange(4096), free, 400)
    bound = [Best(5, free[0].kth)]
    assert walk(item, tree, np.arange(4096), bound, 400) < all_scored
    assert bound[0].doc.tolist() == free[0].doc.tolist()
