import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gamelog.llm.mixing import _rates, fit_rates, mixed, mixed_with_totals


def make(spark, n=600):
    rng = random.Random(7)
    docs, labels = [], []
    alphabets = {"en": "abcdefgh", "de": "ijklmnop"}
    for i in range(n):
        lang = "en" if rng.random() < 0.7 else "de"
        good = rng.random() < 0.6
        words = ["".join(rng.choice(alphabets[lang]) for _ in range(rng.randint(2, 6))) + ("" if good else "###")
                 for _ in range(rng.randint(1, 100))]
        docs.append((i, " ".join(words), lang, "s", 5))
        if i % 2:
            labels.append((i, int(good)))
    docs += [(n, None, "en", "s", 0), (n + 1, "", None, None, 0), (None, "abc abc", None, "s", 7), (3, docs[3][1], "en", "s", 5)]
    return (spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, mix_rate int"),
            spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, quality int"), docs)


TARGETS = {"en/1": 0.5, "en/0": 0.1, "de/1": 0.35, "de/0": 0.05}


def test_expected_totals_meet_the_targets(spark):
    docs, labels, rows = make(spark)
    out = mixed(docs, labels, TARGETS, budget=1.1).collect()
    assert len(out) == len(rows) and set(out[0].asDict()) == {
        "doc_id", "text", "lang", "source", "mix_tokens", "mix_domain", "mix_rate", "mix_copies"}
    total = sum(len((t or "").split()) for _, t, *_ in rows)
    assert sum(r["mix_tokens"] for r in out) == total
    for name, share in TARGETS.items():
        got = sum(r["mix_rate"] * r["mix_tokens"] for r in out if r["mix_domain"] == name)
        assert abs(got - 1.1 * total * share) < 0.06 * total * share + 20
    assert all(r["mix_rate"] >= 0 and r["mix_copies"] in (int(r["mix_rate"]), int(r["mix_rate"]) + 1) for r in out)
    # the classifier tells the domains apart
    named = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 600 and r["mix_tokens"] > 5]
    right = sum(r["mix_domain"] == f"{r['lang']}/{int('#' not in r['text'])}" for r in named)
    assert right >= 0.97 * len(named)


def test_projected_gradient_reaches_feasible_targets(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.3] * 3, 500)
    tokens = rng.integers(1, 1000, 500)
    df = spark.createDataFrame([(i, int(t), *map(float, r)) for i, (t, r) in enumerate(zip(tokens, p))],
                               "key long, tokens long, p0 double, p1 double, p2 double")
    want = np.array([0.7, 0.1, 0.05])
    rate = _rates(p, fit_rates(df, 3, want))
    assert (rate >= 0).all()
    assert np.abs((rate * tokens / tokens.sum()) @ p - want).max() < 1e-3


def test_a_rare_domain_meets_its_target_and_a_miss_is_reported(spark):
    docs, labels, _ = make(spark)
    docs = docs.filter("lang = 'en' OR doc_id % 20 = 1")  # German is about 2% of the tokens
    out, totals = mixed_with_totals(docs, labels, {"en/1": 0.6, "en/0": 0.1, "de/1": 0.2, "de/0": 0.1}, budget=1.0)
    rows = out.collect()
    assert max(r["mix_rate"] for r in rows) > 4
    assert all(abs(got - want) < 0.01 * want for want, got in totals.values())
    for name, (want, got) in totals.items():
        real = sum(r["mix_rate"] * r["mix_tokens"] for r in rows if r["mix_domain"] == name)
        assert abs(real - got) < 0.1 * want + 20
    out, totals = mixed_with_totals(docs, labels, {"en/1": 0.6, "en/0": 0.1, "de/1": 0.2, "de/0": 0.1}, 1.0, max_rate=4.0)
    assert out.agg({"mix_rate": "max"}).first()[0] <= 4
    assert totals["de/1"][1] < 0.8 * totals["de/1"][0]
    with pytest.warns(UserWarning, match="de/1"):
        mixed(docs, labels, {"en/1": 0.6, "en/0": 0.1, "de/1": 0.2, "de/0": 0.1}, 1.0, max_rate=4.0)


def test_rows_without_an_id_and_repeated_rows_are_drawn_each(spark):
    docs, labels, _ = make(spark, 20)
    texts = [f"abc {i}" for i in range(300)]
    rows = [(None, t) for t in texts] + [(900, t) for t in texts] + [(901, "the same")] * 300 + [(None, None)] * 300
    some = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    out = mixed(some.repartition(4), labels.limit(0), TARGETS, budget=0.6).collect()
    assert len(out) == len(rows)
    for group in ([r for r in out if r["doc_id"] is None and r["text"]], [r for r in out if r["doc_id"] == 900],
                  [r for r in out if r["doc_id"] == 901]):
        want = sum(r["mix_rate"] for r in group)
        assert 0.3 < want / len(group) < 0.9 and abs(sum(r["mix_copies"] for r in group) - want) < 0.15 * len(group)


def test_without_labels_and_empty(spark):
    docs, labels, rows = make(spark, 20)
    out = mixed(docs, labels.limit(0), TARGETS).collect()
    assert len(out) == len(rows) and len({round(r["mix_rate"], 6) for r in out if r["mix_tokens"]}) == 1
    assert mixed(docs.limit(0), labels, TARGETS).collect() == []
