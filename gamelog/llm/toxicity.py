"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: lower case, homoglyphs and accents of look-alike scripts to Latin
letters, invisible characters away, digits and signs inside words to the letters they stand for;
words with signs are also matched in their other readings, of which the strongest counts.
The lexicon is learned from labelled documents: word stems (3 to 9 letters, or a whole word)
weighted by the lower confidence bound of their log odds in toxic against clean text. Evidence is
counted by distinct contexts (the words before and after), so that copies of one document count
once. Matches inside learned exception phrases count nothing. A document's weights are summed,
normalised by its length, and turned into a probability by a logistic curve.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gamelog.llm.common import materialize, rows_per_batch, table

# ---- fixed values: look-alike characters and signs, folded to Latin letters ----
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k",
    "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԛ": "q",
    "ԝ": "w", "ё": "e", "ѵ": "v", "ӏ": "l", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i",
    "ɑ": "a", "ɡ": "g", "ℓ": "l", "ս": "u", "օ": "o",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s",
         "!": "i", "|": "i"}
INVISIBLE = "­​‌‍⁠﻿"
# ---- end of fixed values ----

SAMPLE_DOCS = 20_000
MAX_TERMS, MAX_PHRASES = 1_000, 1_000
MIN_SUPPORT, MIN_WEIGHT = 8, 1.5
SHORTEST, LONGEST = 3, 9

_FOLD = {ord(k): v for k, v in HOMOGLYPHS.items()}
_FOLD |= {0xFF01 + i: chr(0x21 + i).lower() for i in range(94)}  # full-width forms
_FOLD |= {ord(c): None for c in INVISIBLE}
_ODD = re.compile("[" + "".join(map(re.escape, [chr(c) for c in _FOLD])) + "]")
_SIGNED = re.compile(r"(?<![0-9@$!|])[013457@$!|]{1,2}(?=[^\W\d_])|(?<=[^\W\d_])[013457@$](?![\w@$!|])")
_SIGN_MAP = str.maketrans(SIGNS)
_GAP = re.compile(r"[\W_]+")
#: signs of words read in other ways than ``fold`` reads them
_OTHER_SIGNS = (str.maketrans(SIGNS | {"6": "b", "8": "b", "9": "g"}), str.maketrans(SIGNS | {"6": "g", "8": "b", "9": "p"}))
_SIGN = re.compile(r"[0-9@$!|]")
_EDGE = re.compile(r"^[^\w@$]+|[^\w@$]+$")


def fold(text: str | None) -> str:
    """Folded words, each between single spaces; '' for no words. l counts as i."""
    t = (text or "").lower()
    if _ODD.search(t):
        t = t.translate(_FOLD)
    t = _SIGNED.sub(lambda m: m[0].translate(_SIGN_MAP), t)
    t = _GAP.sub(" ", t).strip().replace("l", "i")
    return f" {t} " if t else ""


def _contexts(frames):
    """Distinct (word, context, label) of each batch."""
    for frame in frames:
        seen = set()
        for text, toxic in zip(frame["text"], frame["toxic"]):
            w = ["", *fold(text).split(), ""]
            seen.update((b, f"{a} {c}", int(toxic)) for a, b, c in zip(w, w[1:], w[2:]))
        yield pd.DataFrame(list(seen), columns=["word", "context", "toxic"])


def lexicon_of(contexts: DataFrame, max_terms: int = MAX_TERMS) -> list[tuple[str, float]]:
    """Terms (' stem' or ' word ') and weights, strongest first, at most ``max_terms``."""
    words = contexts.distinct().groupBy("word").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("c"))
    words = materialize(words, "words")
    total = words.agg(F.sum("a"), F.sum("c")).first()
    if not total[0] or not total[1]:
        return []
    size = F.length("word")
    stems = F.transform(
        F.sequence(F.lit(SHORTEST), F.greatest(F.least(size, F.lit(LONGEST)), F.lit(SHORTEST))),
        lambda n: F.concat(F.lit(" "), F.substring("word", F.lit(1), n)))
    stems = F.when(size >= SHORTEST, stems).otherwise(F.array().cast("array<string>"))
    whole = F.array(F.concat(F.lit(" "), "word", F.lit(" ")))
    terms = words.select(F.explode(F.concat(stems, whole)).alias("term"), "a", "c").groupBy(
        "term").agg(F.sum("a").alias("a"), F.sum("c").alias("c"))
    a, c, ta, tc = F.col("a"), F.col("c"), float(total[0]), float(total[1])
    weight = (F.log((a + 0.5) / (ta + 1)) - F.log((c + 0.5) / (tc + 1))
              - 2 * F.sqrt(1 / (a + 0.5) + 1 / (c + 0.5)))
    strong = materialize(terms.withColumn("w", weight).filter(
        (a >= MIN_SUPPORT) & (F.col("w") >= MIN_WEIGHT)), "terms")
    # a stem with a longer one of nearly the same support is only a part of it
    longer = strong.select(F.expr("substring(term, 1, length(term) - 1)").alias("term"),
                           F.col("a").alias("more")).groupBy("term").agg(F.max("more").alias("more"))
    kept = strong.join(longer, "term", "left").filter(F.coalesce("more", F.lit(0)) < 0.95 * a)
    rows = kept.orderBy(F.desc(F.col("w") * F.sqrt(a)), "term").limit(max_terms).collect()
    return [(r["term"], float(r["w"])) for r in rows]


def automaton(terms: list[tuple[str, float]], phrases: list[str]):
    """An Aho-Corasick automaton over terms and exception phrases (phrases weigh None)."""
    out = ahocorasick.Automaton()
    for term, weight in terms:
        out.add_word(term, (len(term), weight))
    for phrase in phrases:
        out.add_word(phrase, (len(phrase), None))
    if len(out):
        out.make_automaton()
    return out


def matches(auto, folded: str) -> dict[int, float]:
    """The best weight at each matched word's start, without words in exception phrases."""
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    if not len(auto) or not folded:
        return best
    for end, (size, weight) in auto.iter(folded):
        at = end - size + 1
        if weight is None:
            spared.append((at, end))
        elif weight > best.get(at, 0.0):
            best[at] = weight
    return _outside(best, spared) if spared and best else best


def _outside(best: dict[int, float], spared: list[tuple[int, int]]) -> dict[int, float]:
    """The matches that start in none of the ranges; both are gone through once, in order."""
    spared.sort()
    out, i, reach = {}, 0, -1
    for at in sorted(best):
        while i < len(spared) and spared[i][0] <= at:
            reach = max(reach, spared[i][1])
            i += 1
        if at >= reach:
            out[at] = best[at]
    return out


def _readings(token: str) -> list[str]:
    """Other readings of a word with signs or digits: as it is, and all of them letters."""
    core = _EDGE.sub("", token)
    texts = [core, *(x.translate(m) for m in _OTHER_SIGNS for x in (core, token))]
    return [t for t in dict.fromkeys(_GAP.sub(" ", x).strip().replace("l", "i") for x in texts) if t]


def _more(auto, text: str) -> float:
    """Weight that other readings of words with signs add to ``fold``'s reading of them."""
    t = text.lower()
    if not _SIGN.search(t):
        return 0.0
    tokens = (t.translate(_FOLD) if _ODD.search(t) else t).split()
    more = 0.0
    for i, token in enumerate(tokens):
        if not _SIGN.search(token) or token.upper() == token:  # no letters
            continue
        core = _EDGE.sub("", token)
        if not _SIGN.search(core) and token.startswith(core):
            continue  # only signs at its end, which no reading takes for letters of it
        # exception phrases have two words: those beside the token decide as well
        before = fold(" ".join(tokens[max(i - 3, 0):i])).rstrip().rpartition(" ")[2]
        after = fold(" ".join(tokens[i + 1:i + 4])).lstrip().partition(" ")[0]

        def weight(reading: str) -> float:
            start = f" {before} " if before else " "
            found = matches(auto, start + reading + (f" {after} " if after else " "))
            low, high = len(start) - 1, len(start) + len(reading)
            return sum(w for at, w in found.items() if low <= at < high)

        best = max(map(weight, _readings(token)), default=0.0)
        if best:
            mine = fold(token).strip()
            more += max(best - (weight(mine) if mine else 0.0), 0.0)
    return more


def strength(auto, text: str | None) -> float:
    """Summed weights of a text's matches, normalised by its length in words.

    A word with signs or digits counts by its strongest reading.
    """
    if not len(auto) or not text:
        return 0.0
    folded = fold(text)
    found = sum(matches(auto, folded).values()) + _more(auto, text)
    if not found:
        return 0.0
    return found / math.log(math.e + max(folded.count(" ") - 1, 1))


def _phrases(terms):
    def run(frames):
        auto = automaton(terms, [])
        for frame in frames:
            seen = set()
            for text, toxic in zip(frame["text"], frame["toxic"]):
                folded = fold(text)
                for at in matches(auto, folded):
                    end = folded.index(" ", at + 1)
                    before, after = folded.rfind(" ", 0, at), folded.find(" ", end + 1)
                    left, right = folded[max(before, 0):at], folded[end:after] if after >= 0 else ""
                    word = folded[at:end]
                    if left:
                        seen.add((f"{left}{word} ", right, int(toxic)))
                    if right:
                        seen.add((f"{word}{right} ", left, int(toxic)))
            yield pd.DataFrame(list(seen), columns=["phrase", "context", "toxic"])
    return run


def _strengths(terms, phrases):
    def run(frames):
        auto = automaton(terms, phrases)
        for frame in frames:
            yield pd.DataFrame({"x": [round(min(strength(auto, t), 50.0), 2) for t in frame["text"]],
                                "toxic": frame["toxic"]})
    return run


def fit_logistic(x: np.ndarray, n: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Ridge logistic fit of counts: ``toxic`` of ``n`` rows at each ``x``."""
    beta = np.zeros(2)
    design = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (toxic - n * p) - 0.01 * beta
        hess = (design * (n * p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), max(float(beta[1]), 0.0)


class Model:
    """A fitted lexicon: terms, exception phrases and the logistic curve (a, b)."""

    def __init__(self, terms, phrases, curve):
        self.terms, self.phrases, self.curve = terms, phrases, curve


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, max_terms: int = MAX_TERMS,
        max_phrases: int = MAX_PHRASES) -> Model:
    """Learn from labelled documents that are not held out, at most ``sample_docs`` of them.

    The sample takes the ids with the smallest hashes; a document labelled both ways is toxic. The
    lexicon has the ``max_terms`` strongest terms and the ``max_phrases`` most frequent exception
    phrases: the size of the model, which every task holds.
    Without usable labels of both kinds the lexicon is empty.
    """
    rows_per_batch(docs.sparkSession)
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy(
        "doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    # bounded by sample_docs rows of 12 bytes
    rows = materialize(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select(
        "text", "toxic"), "toxicity-sample").repartition(32)
    terms = lexicon_of(rows.mapInPandas(_contexts, "word string, context string, toxic int"), max_terms)
    counts = rows.mapInPandas(_phrases(terms), "phrase string, context string, toxic int").distinct().groupBy(
        "phrase").agg(F.count_if(F.col("toxic") == 0).alias("clean"), F.sum("toxic").alias("bad"))
    phrases = [r["phrase"] for r in counts.filter("clean >= 5 AND bad < 0.02 * clean")
               .orderBy(F.desc("clean"), "phrase").limit(max_phrases).collect()] if terms else []
    # at most 5,001 values of x
    bins = rows.mapInPandas(_strengths(terms, phrases), "x double, toxic int").groupBy("x").agg(
        F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic")).orderBy("x").collect()
    if not bins or not sum(r["toxic"] for r in bins):
        return Model([], [], (-10.0, 0.0))
    curve = fit_logistic(*(np.array([r[c] for r in bins], float) for c in ("x", "n", "toxic")))
    return Model(terms, phrases, curve)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``score`` (0 to 1) to each document, from its whole text and nothing else.

    A missing or empty text has no match and gets the score of matching nothing. Input columns
    named score are replaced; all others stay.
    """
    terms, phrases, (a, b) = model.terms, model.phrases, model.curve
    keep = docs.drop("score")

    @F.pandas_udf("double")
    def toxicity(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        auto = automaton(terms, phrases)
        for texts in parts:
            x = np.array([strength(auto, t) for t in texts], float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(a + b * x, -30, 30))))

    return keep.withColumn("score", toxicity("text"))


def toxic_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels that are not held out."""
    return toxic_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
