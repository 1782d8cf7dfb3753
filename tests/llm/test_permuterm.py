"""Spelling variants against comparing all pairs of words."""

import random
from collections import Counter
from zlib import crc32

import pytest

from gamelog.llm.permuterm import neighbours, rotations, variants, word_counts, words_of


def near(a, b):
    """Whether one inserted, deleted or replaced character makes ``a`` into ``b``."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(words):
    form, links = {}, {}
    for w in words:
        others = [v for v in words if near(w, v)]
        links[w] = len(others)
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], links[w], words[form[w]] if form[w] else None))
    return sorted(out, key=lambda r: r[0])


def by_word(rows):
    return sorted(rows, key=lambda r: r[0])


@pytest.mark.parametrize("seed", range(3))
def test_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    words = {}
    while len(words) < 400:
        w = "".join(rng.choice("abé") for _ in range(rng.randint(4, 8)))
        words[w] = rng.choice([3, 3, 5, 10, 40, 200])
    docs = []
    for i, (w, n) in enumerate(words.items()):
        docs += [(i * 10 + j, f"{w} {w.upper().replace('É', 'é')}, {w}" if j else f" {w}\n" * max(n - 3, 1)) for j in range(2)]
    docs += [(None, "missingid " * 4), (1, None), (2, ""), (3, "12 --"), (5, "abababa"), (5, "abababa")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    counts = Counter()
    for doc, text in docs:
        counts.update(words_of(doc, text))
    kept = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    got = by_word([tuple(r) for r in variants(df.repartition(5)).select("word", "form", "root", "n", "n_near", "form_n").collect()])
    assert got == plain_variants(kept)


def test_slips_follow_the_rule():
    seen = 0
    for doc in range(300):
        for run in ("sample", "échantillon", "x"):
            h = crc32(f"{doc}:{run}".encode())
            want = run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run
            seen += want != run
            assert words_of(doc, f"{run.title()} {run}".translate({ord("É"): "é"}))[want] == 2
    assert seen
    assert words_of(0, "Éa AÉ") == Counter({"Éa": 1, "aÉ": 1})  # only A-Z are lower-cased
    assert words_of(None, "abc") == words_of("", "abc")


def test_entries_of_a_word(spark):
    rows = rotations(spark.createDataFrame([("abb", 3)], "word string, n long")).collect()
    assert {(r.key, r.lead) for r in rows if r.open} == {("bb$", True), ("b$a", True), ("$ab", False)}
    assert {r.key for r in rows if not r.open} == {"abb$", "bb$a", "b$ab", "$abb"}


def test_doubled_letters_count_once(spark):
    words = spark.createDataFrame([("aabbb", 5), ("aabb", 9), ("abbb", 2), ("aaabbb", 1), ("xxxxx", 7)], "word string, n long")
    got = {r.word: (r.n_near, r.near, r.near_n) for r in neighbours(words).collect()}
    assert got == {"aabbb": (3, "aabb", 9), "aabb": (2, "aabbb", 5), "abbb": (2, "aabb", 9), "aaabbb": (1, "aabbb", 5)}


def test_long_chain_and_long_words(spark):
    chain = ["aaaaaaaa", "baaaaaaa", "bbaaaaaa", "bbbaaaaa", "bbbbaaaa", "bbbbbaaa"]
    docs = [(i, f"{w} " * (3 * 2 ** i)) for i, w in enumerate(chain)] + [(50, "z" * 3000 + " " + "z" * 2999), (51, ("z" * 3000 + " ") * 5)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.word: r for r in variants(df, slip=0, min_count=1).collect()}
    assert all(got[w].root == chain[-1] for w in chain)
    assert got["z" * 2999].form == "z" * 3000 and got["z" * 3000].form is None


def test_empty_and_clashing_names(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert variants(none).collect() == []
    df = spark.createDataFrame([(1, "hello hello hello", "w", 4)], "doc_id long, text string, word string, n int")
    assert [tuple(r) for r in variants(df, slip=0).collect()] == [("hello", None, "hello", 3, 0, None)]
    assert word_counts(df, slip=0).columns == ["word", "n"]
