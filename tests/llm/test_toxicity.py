import random
import zlib

import pytest

from gamelog.llm.toxicity import Model, automaton, fit, fold, matches, score, strength, toxic_scores


@pytest.mark.parametrize("text, folded", [
    (None, ""), ("", ""), ("!!!", ""), ("St​upid", " stupid "), ("ѕtuріd", " stupid "), ("stup1d $tupid", " stupid stupid "),
    ("ｓｔｕｐｉｄ", " stupid "), ("in 2024 a 5 b", " in 2024 a 5 b "), ("LOL!!", " ioi "), ("thoner$$$", " thoner "),
])
def test_fold(text, folded):
    assert fold(text) == folded


def test_best_weight_per_word_and_exceptions():
    auto = automaton([(" bad", 2.0), (" badger ", 5.0), (" wor", 1.0)], [" good bad "])
    assert matches(auto, fold("bad badger abad work")) == {0: 2.0, 4: 5.0, 16: 1.0}
    assert matches(auto, fold("so good bad words")) == {12: 1.0}
    assert matches(automaton([], []), fold("bad")) == {}


@pytest.mark.parametrize("text", ["so krass now", "so kra$$ now", "so kra55 now", "so kra$$! now", "so KRA5$, now",
                                  "so (kr4$$) now", "so !krass now", "6rumm x y", "9rumm x y"])
def test_words_with_signs_match_in_any_reading(text):
    auto = automaton([(" krass ", 3.0), (" grumm ", 3.0)], [])
    assert strength(auto, text) == strength(auto, "so krass now") > 0


def test_readings_count_once_and_keep_exceptions():
    auto = automaton([(" krass ", 3.0), (" thoner ", 2.0)], [" very krass "])
    assert strength(auto, "a thoner$$$ b") == strength(auto, "a thoner b") > 0
    assert strength(auto, "a krass! b") == strength(auto, "a krass b")
    assert strength(auto, "very kra$$ b") == strength(auto, "very krass b") == 0
    assert strength(auto, "in 2024 $$$ 55 !!") == 0


def make(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(1200):
        words = ["".join(rng.choice("aeioubcdfgmnprst") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(20, 120))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(rng.randint(2, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(["zumpf", "zumpfig", "zumpfer", "krax"]))
        docs.append((i, " ".join(words), "en"))
        labels.append((i, toxic))
    # a clean text copied often with one label of each kind, and rows without text or id
    docs += [(5000 + i, "the very same clean text in many copies " * 3, "en") for i in range(200)]
    labels += [(5000 + i, 1) for i in range(200)]
    docs += [(6000, None, "en"), (6001, "", None), (6002, "ZUMPF " * 20_000, "en"), (None, "zumpf krax", "en"),
             (6003, "ein zum𝗽f? nein: z​umpf und kra x", "de")]
    return (spark.createDataFrame(docs, "doc_id long, text string, score string"),
            spark.createDataFrame(labels + [(None, 1), (7, None)], "doc_id long, toxic int"), dict(labels))


def test_held_out_accuracy_and_edge_rows(spark):
    docs, labels, truth = make(spark)
    rows = {r["doc_id"]: r for r in toxic_scores(docs, labels).collect()}
    assert len(rows) == docs.select("doc_id").distinct().count()
    assert all(r["held_out"] == (d is not None and zlib.crc32(str(d).encode()) % 5 == 0) for d, r in rows.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows.values())
    held = [r for d, r in rows.items() if d is not None and d < 5000 and r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert rows[6000]["score"] == rows[6001]["score"] < 0.5
    assert rows[6002]["predicted"] == rows[None]["predicted"] == 1


def test_without_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["predicted"] for r in toxic_scores(docs, none).collect()] == [0]
    assert toxic_scores(docs.limit(0), none).collect() == []
    assert fit(docs, none).terms == []
    kept = score(docs.selectExpr("*", "1 AS score", "2 AS x"), Model([], [], (0.0, 0.0))).collect()
    assert [r.asDict() for r in kept] == [{"doc_id": 1, "text": "a", "x": 2, "score": 0.5}]


def test_exception_phrases_take_linear_time_and_spare_the_same_words():
    import random
    import time

    from gamelog.llm.toxicity import _outside
    rng = random.Random(8)
    for _ in range(200):
        best = {rng.randrange(60): 1.0 for _ in range(20)}
        spared = [(a, a + rng.randrange(1, 12)) for a in (rng.randrange(60) for _ in range(rng.randrange(8)))]
        plain = {x: w for x, w in best.items() if not any(a <= x < b for a, b in spared)}
        assert _outside(dict(best), list(spared)) == plain
    auto = automaton([(" bad", 2.0)], [" not bad "])
    took = []
    for n in (4000, 16_000):
        text = fold("not bad so bad " * n)
        began = time.perf_counter()
        assert len(matches(auto, text)) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 0.2


def test_the_automaton_equals_searching_every_term():
    import random
    rng = random.Random(9)
    for _ in range(100):
        word = lambda: "".join(rng.choice("ab ") for _ in range(rng.randint(1, 4)))
        terms = {word(): float(rng.randint(1, 5)) for _ in range(6)}
        phrases = [p for p in {word() + word() for _ in range(3)} if p not in terms]
        text = "".join(rng.choice("ab ") for _ in range(60))
        spared = [(i, i + len(p) - 1) for p in phrases for i in range(len(text)) if text.startswith(p, i)]
        want = {}
        for i in range(len(text)):
            own = [w for t, w in terms.items() if text.startswith(t, i)]
            if own and not any(a <= i < b for a, b in spared):
                want[i] = max(own)
        assert matches(automaton(list(terms.items()), phrases), text) == want
