import random
import time

import numpy as np

from gamelog.llm.decontaminate import align, contaminated, covered_words, needed_words, words_of


def plain_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1][j + 1] = max(0, h[i][j] + (1 if x == y else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
    return max(map(max, h))


def test_align_equals_the_plain_recurrence():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 25))] for _ in range(2))
        assert align(np.array(a), np.array(b)) == (plain_align(a, b) if a and b else 0)


def test_finds_whole_cut_and_edited_items_and_nothing_else(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(["the", "of", "and", "a", "in"]) if rng.random() < 0.3 else (
        rng.choice("bcdfg") + rng.choice("aeiou") + rng.choice("lmnrst") + str(rng.randint(0, 300)))
    text = lambda n: [word() for _ in range(n)]
    items = [text(rng.randint(15, 60)) for _ in range(40)]
    docs, planted = [], set()
    for d in range(400):
        body = text(rng.randint(30, 400))
        if d % 8 == 0:
            i = rng.randrange(40)
            found = list(items[i])
            if d % 16 == 0:
                for k in range(0, len(found), 7):
                    found[k] = "EDITED"
            elif d % 24 == 0:
                found = found[: max(len(found) * 2 // 5, 14)]
            at = rng.randrange(len(body))
            body[at:at] = found
            planted.add((d, i))
        docs.append((d, " ".join(body).capitalize() + ".", "x"))
    # one item in a third of all documents
    hot = text(30)
    docs += [(1000 + i, " ".join(text(50) + hot + text(20)), "x") for i in range(200)]
    planted |= {(1000 + i, 40) for i in range(200)}
    long = " ".join(text(60_000) + items[0])
    docs += [(2000, None, "x"), (2001, "", "x"), (2002, "a b", "x"), (None, " ".join(items[0]), "x"), (2003, long, "x"),
             (2004, " ".join(items[1]), "x"), (2004, "nothing here", "x")]
    planted |= {(2003, 0), (2004, 1), (2004, 50)}
    planted |= {(d, 50) for d, i in planted if i == 1}
    tests = [(i, " ".join(t), 1) for i, t in enumerate([*items, hot])]
    tests += [(50, ", ".join(items[1]).upper(), 1), (51, None, 1), (52, "two words", 1), (None, "x y z", 1)]
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string, item_id string"),
                       spark.createDataFrame(tests, "item_id long, text string, doc_id int")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == planted
    by = {r["doc_id"]: r["text"] for r in spark.createDataFrame(docs, "doc_id long, text string, x string").filter(
        "doc_id < 400").collect()}
    for r in got:
        if r["doc_id"] in by:
            item = words_of(tests[r["item_id"]][1] if r["item_id"] < 50 else tests[41][1])
            assert r["score"] == round(min(1, plain_align(
                words_of(by[r["doc_id"]]).tolist(), item.tolist()) / min(len(item), 32)), 6)


def test_finds_a_passage_that_many_items_share(spark):
    rng = random.Random(9)
    text = lambda n: ["w" + str(rng.randint(0, 10**6)) for _ in range(n)]
    passage = text(40)
    items = [(i, " ".join(passage + text(15))) for i in range(12)] + [(100 + i, " ".join(text(20))) for i in range(20)]
    docs = [(1, " ".join(text(50) + passage + text(50))), (2, " ".join(text(140)))]
    docs += [(10 + i, " ".join(text(100))) for i in range(30)]
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                       spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"], r["score"]) for r in got} == {(1, i, 1.0) for i in range(12)}


def test_finds_an_edited_short_item_however_often_it_is_copied(spark):
    rng = random.Random(10)
    text = lambda n: ["w" + str(rng.randint(0, 10**6)) for _ in range(n)]
    items = [text(8) for _ in range(3)]
    edit = lambda words, *at: [("EDIT" if i in at else w) for i, w in enumerate(words)]
    # 3, 2 and 1 trigrams left; each in a third of all documents
    left = [(edit(items[0], 3), 0.75), (edit(items[1], 3, 4), 0.5), (edit(items[2], 3, 6), 0.5)]
    docs = [(i, " ".join(text(30) + left[i % 3][0] + text(30))) for i in range(120)]
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                       spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"], r["score"]) for r in got.collect()} == {
        (i, i % 3, plain_align(left[i % 3][0], items[i % 3]) / 8) for i in range(120)}


def test_a_phrase_that_all_share_pairs_nothing(spark):
    """2,000 items and 20,000 documents with a common phrase: only the planted copies become pairs."""
    rng = random.Random(12)
    text = lambda n: ["w" + str(rng.randint(0, 10**6)) for _ in range(n)]
    phrase = "answer which of the following".split()
    items = [phrase + text(20) for _ in range(2000)]
    docs = [(i, " ".join(text(10) + phrase + text(10))) for i in range(20_000)]
    planted = {(30_000 + i, i * 7) for i in range(100)}
    for doc, i in planted:
        copy = list(items[i])
        copy[9] = copy[17] = "edited"
        docs.append((doc, " ".join(text(20) + copy + text(20))))
    began = time.time()
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                       spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == planted
    assert time.time() - began < 120


def test_items_of_common_phrases_only(spark):
    """Items put together from phrases that many items share are found by them."""
    rng = random.Random(13)
    phrases = [["p" + str(rng.randint(0, 10**6)) for _ in range(5)] for _ in range(12)]
    items = [sum(rng.sample(phrases, 6), []) for _ in range(60)]
    noise = lambda n: ["n" + str(rng.randint(0, 10**6)) for _ in range(n)]
    docs = [(i, " ".join(noise(20) + items[i] + noise(20))) for i in range(10)]
    docs += [(100 + i, " ".join(noise(20) + phrases[i] + noise(20))) for i in range(12)]
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                       spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in got.collect()}
    want = {}
    for d, t in docs:
        for i, item in enumerate(items):
            score = round(min(1, plain_align(t.split(), item) / min(len(item), 32)), 6)
            if score >= 0.4:
                want[d, i] = score
    assert got == want and all((i, i) in want for i in range(10))


def test_seeds_leave_out_common_phrases_but_no_leak():
    assert covered_words(np.array([], int)) == 0 and covered_words(np.array([4])) == 3
    assert covered_words(np.array([0, 1, 2, 9])) == 8
    assert [needed_words(n, 0.4) for n in (3, 5, 8, 32, 500)] == [2, 2, 4, 13, 13]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    assert [tuple(r)[:3] for r in contaminated(docs, items).collect()] == [(1, 1, 1.0)]
    assert contaminated(docs.limit(0), items).collect() == []
    assert contaminated(docs, items.limit(0)).collect() == []
