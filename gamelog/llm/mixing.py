"""Mixing documents to target domain weights with soft membership.

A classifier learned from the labelled table (naive Bayes on hashed byte trigrams, its sharpness
fitted on the same sample) gives every document a posterior over domains: here language and
quality. A document then has a nonnegative rate, and the expected tokens of a domain are the
sum over documents of rate * tokens * posterior. Projected gradient descent with momentum on the weighted
least squares distance to the target totals fits all rates: each step needs only the current
totals, one sum per domain, and a document's rate is recomputed from its posterior and the
few vectors of the steps so far. Steps are measured per token, so that documents alike in
membership get one rate whatever their length, and the distance is weighted by the inverse Gram
matrix of the posteriors, so that a unit step suits every domain. The expected totals of the fitted
rates are given beside the targets, so that a target out of reach or an unfinished fit is seen.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gamelog.llm.common import materialize, rows_per_batch, table

BUCKETS = 1 << 14
SAMPLE_DOCS = 20_000
SHARPNESS = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0, 256.0, 512.0)
STEPS, TOLERANCE = 60, 1e-6
MISSED = 0.01  # of a target: so far away the expected total is reported as a miss
RIDGE = 1e-3  # of the mean diagonal; keeps steps towards nearly absent domains short

# ---- fixed values: target shares of tokens by domain (language/quality) and of all tokens ----
TARGETS = {
    "en/1": 0.5225, "de/1": 0.1425, "fr/1": 0.1425, "es/1": 0.1425,
    "en/0": 0.0275, "de/0": 0.0075, "fr/0": 0.0075, "es/0": 0.0075,
}
BUDGET = 1.2
# ---- end of fixed values ----


def _codes(text: str | None) -> tuple[np.ndarray, int]:
    """Buckets of a text's byte trigrams, and its number of words."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    words = int((~gap[1:] & gap[:-1]).sum() + (~gap[:1]).sum())
    if len(data) < 3:
        return np.empty(0, np.int64), words
    wide = data.astype(np.uint32)
    code = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
    return ((code * np.uint32(2654435769)) >> np.uint32(32 - 14)).astype(np.int64), words


def _count(domains: int):
    def run(frames):
        counts = np.zeros((domains, BUCKETS), np.int64)
        for frame in frames:
            for text, k in zip(frame["text"], frame["domain"]):
                counts[k] += np.bincount(_codes(text)[0], minlength=BUCKETS)
        k, b = np.nonzero(counts)
        yield pd.DataFrame({"domain": k, "bucket": b, "n": counts[k, b]})
    return run


class Classifier:
    """Log likelihood of each bucket per domain, log prior, and sharpness."""

    def __init__(self, names, table_, prior, sharp=1.0):
        self.names, self.table, self.prior, self.sharp = names, table_, prior, sharp

    def mean(self, codes: np.ndarray) -> np.ndarray:
        if not len(codes):
            return np.zeros(len(self.names))
        return self.table[codes].mean(0, dtype=np.float64)

    def posterior(self, codes: np.ndarray, sharp: float | None = None) -> np.ndarray:
        x = self.prior + (self.sharp if sharp is None else sharp) * (self.mean(codes) if len(codes) else 0)
        x = np.exp(x - x.max())
        return x / x.sum()


def _loss(model):
    def run(frames):
        lost = np.zeros(len(SHARPNESS))
        for frame in frames:
            for text, k in zip(frame["text"], frame["domain"]):
                codes, _ = _codes(text)
                lost += [-np.log(max(model.posterior(codes, s)[k], 1e-12)) for s in SHARPNESS]
        yield pd.DataFrame({"at": range(len(SHARPNESS)), "loss": lost})
    return run


def fit_classifier(docs: DataFrame, labels: DataFrame, names: list[str],
                   sample_docs: int = SAMPLE_DOCS) -> Classifier:
    """Learn domains (language/quality) from at most ``sample_docs`` labelled documents.

    The sample takes the ids with the smallest hashes; a document labelled twice takes its
    smaller quality. Documents of other domains than ``names`` are not learned from.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    place = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    # bounded by sample_docs rows of 12 bytes
    rows = materialize(docs.select("doc_id", "text", "lang").join(F.broadcast(known), "doc_id").select(
        "text", F.try_element_at(place, F.concat_ws("/", "lang", F.col("quality").cast("string"))).alias("domain"))
        .filter("domain IS NOT NULL"), "mixing-sample")
    # at most domains * 2^14 sums
    sums = rows.mapInPandas(_count(len(names)), "domain int, bucket int, n long").groupBy("domain", "bucket").agg(
        F.sum("n").alias("n")).toPandas()
    counts = np.full((len(names), BUCKETS), 0.5)
    counts[sums["domain"].to_numpy(int), sums["bucket"].to_numpy(int)] += sums["n"].to_numpy(float)
    logs = np.log(counts / counts.sum(1, keepdims=True)).T.astype(np.float32)
    size = np.full(len(names), 1.0)
    for r in rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect():
        size[r["domain"]] += r["n"]
    model = Classifier(names, np.ascontiguousarray(logs), np.log(size / size.sum()))
    loss = rows.mapInPandas(_loss(model), "at int, loss double").groupBy("at").agg(
        F.sum("loss").alias("loss")).orderBy("loss", "at").limit(1).collect()
    if loss:
        model.sharp = SHARPNESS[loss[0]["at"]]
    return model


def _members(model):
    def run(frames):
        m = model.value
        for frame in frames:
            p, tokens = np.zeros((len(frame), len(m.names))), np.zeros(len(frame), np.int64)
            for i, text in enumerate(frame["text"]):
                codes, tokens[i] = _codes(text)
                p[i] = m.posterior(codes)
            out = pd.DataFrame(p, columns=[f"p{i}" for i in range(len(m.names))])
            out.insert(0, "tokens", tokens)
            out.insert(0, "doc", frame["doc"].to_numpy())
            out.insert(0, "key", frame["key"].to_numpy())
            yield out
    return run


def _rates(p: np.ndarray, steps: list[np.ndarray], ahead: bool = False, top: float = np.inf) -> np.ndarray:
    """Rates of documents with posteriors ``p`` after the given steps, from 1.

    ``ahead``: the point, moved on by the momentum, at which the next step is measured.
    ``top``: the highest rate.
    """
    before = rate = np.ones(len(p))
    t = 1.0
    for s in [*steps, None]:
        point = rate + (t - 1) / (0.5 + (0.25 + t * t) ** 0.5) * (rate - before)
        if s is None:
            return point if ahead else rate
        before, rate = rate, np.clip(point - p @ s, 0.0, top)
        t = 0.5 + (0.25 + t * t) ** 0.5


def _posteriors(frame: pd.DataFrame, k: int) -> np.ndarray:
    return frame[[f"p{i}" for i in range(k)]].to_numpy()


def _totals(k: int, total: float, steps: list[np.ndarray], ahead: bool, top: float):
    def run(frames):
        sums = np.zeros(k)
        for frame in frames:
            p = _posteriors(frame, k)
            sums += (_rates(p, steps, ahead, top) * frame["tokens"].to_numpy() / total) @ p
        yield pd.DataFrame([sums], columns=[f"s{i}" for i in range(k)])
    return run


def _gram(k: int, total: float):
    def run(frames):
        gram = np.zeros((k, k))
        for frame in frames:
            p = _posteriors(frame, k)
            gram += (p * (frame["tokens"].to_numpy()[:, None] / total)).T @ p
        i, j = np.indices((k, k))
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "g": gram.ravel()})
    return run


def _shares(members: DataFrame, k: int, total: float, steps: list[np.ndarray], ahead: bool, top: float) -> np.ndarray:
    """Expected share of all tokens of each domain under the rates after ``steps``."""
    row = members.mapInPandas(_totals(k, total, steps, ahead, top), ", ".join(f"s{i} double" for i in range(k))).agg(
        *[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)]).first()
    return np.array([row[i] or 0.0 for i in range(k)])


def fit_rates(members: DataFrame, k: int, want: np.ndarray, steps: int = STEPS, top: float = np.inf) -> list[np.ndarray]:
    """Step vectors of projected gradient descent.

    ``want`` has the wanted share of all tokens of each of the ``k`` domains.
    """
    total = float(members.agg(F.sum("tokens")).first()[0] or 0)
    if not total:
        return []
    gram = np.zeros((k, k))
    for r in members.mapInPandas(_gram(k, total), "i int, j int, g double").groupBy("i", "j").agg(
            F.sum("g").alias("g")).collect():
        gram[r["i"], r["j"]] = r["g"]
    weight = np.linalg.inv(gram + np.eye(k) * RIDGE * np.trace(gram) / k)
    done: list[np.ndarray] = []
    last = np.full(k, np.inf)
    for _ in range(steps):
        away = _shares(members, k, total, done, True, top) - want
        if min(np.abs(away).max(), np.abs(away - last).max()) <= TOLERANCE * max(want.sum(), TOLERANCE):
            break  # met, or as near as the documents allow
        last = away
        done.append(weight @ away)
    return done


def _rated(k: int, steps: list[np.ndarray], top: float):
    def run(frames):
        for frame in frames:
            p = _posteriors(frame, k)
            yield pd.DataFrame({"key": frame["key"], "doc": frame["doc"], "tokens": frame["tokens"],
                                "domain": p.argmax(1), "rate": _rates(p, steps, top=top)})
    return run


RATED = "key long, doc long, tokens long, domain int, rate double"


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS,
          budget: float = BUDGET, max_rate: float | None = None) -> DataFrame:
    """The documents of ``mixed_with_totals``; it warns of domains whose target is missed."""
    out, totals = mixed_with_totals(docs, labels, targets, budget, max_rate)
    missed = [f"{n}: {got:.0f} of {want:.0f}" for n, (want, got) in totals.items() if abs(got - want) > MISSED * want]
    if missed:
        warnings.warn("expected tokens miss the target in " + ", ".join(missed), stacklevel=2)
    return out


def mixed_with_totals(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float = BUDGET,
                      max_rate: float | None = None) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """All columns of ``docs`` and mix_tokens, mix_domain, mix_rate, mix_copies; and the target
    and the expected tokens of each domain under the fitted rates.

    ``targets`` are shares (they are scaled to sum 1) of ``budget`` times all tokens (words).
    ``mix_rate`` is the fitted rate, 0 or more, at most ``max_rate`` if given; ``mix_copies`` realises it: its whole part, and one more
    when a hash of the id and the text, uniform between 0 and 1, is below its fraction. Rows that
    repeat an id and its text are drawn each, by their place in the table as it is read.

    A missing or empty text has no tokens and keeps the rate 1; without labels every document
    has the same posterior; rows that repeat get the same rate; an empty table gives an empty
    table. Input columns named like the added ones are replaced.
    """
    rows_per_batch(docs.sparkSession)
    names = sorted(targets)
    want = np.array([targets[n] for n in names], float)
    want = budget * want / want.sum()
    model = docs.sparkSession.sparkContext.broadcast(fit_classifier(docs, labels, names))
    added = ("mix_tokens", "mix_domain", "mix_rate", "mix_copies")
    rows = docs.drop(*added).withColumn("__mix_row", F.monotonically_increasing_id()).withColumn("__mix_key", F.xxhash64("text")).withColumn(
        "__mix_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    members = materialize(rows.select(F.col("__mix_key").alias("key"), F.col("__mix_doc").alias("doc"), "text").mapInPandas(
        _members(model), "key long, doc long, tokens long, " + ", ".join(f"p{i} double" for i in range(len(names)))),
        "posteriors")
    top = np.inf if max_rate is None else max_rate
    steps = fit_rates(members, len(names), want, top=top)
    total = float(members.agg(F.sum("tokens")).first()[0] or 0)
    got = _shares(members, len(names), total, steps, False, top) if total else want
    totals = {n: (float(w * total), float(g * total)) for n, w, g in zip(names, want, got)}
    rated = members.mapInPandas(_rated(len(names), steps, top), RATED).groupBy("key", "doc").agg(
        *[F.first(c).alias(c) for c in ("tokens", "domain", "rate")], F.count(F.lit(1)).alias("alike"))
    label = F.element_at(F.array(*map(F.lit, names)), F.col("domain") + 1)
    place = F.when(F.col("__mix_alike") > 1, F.col("__mix_row")).otherwise(F.lit(-1))
    chance = F.pmod(F.xxhash64(F.lit("mix"), "__mix_doc", "__mix_key", place), F.lit(1 << 24)) / F.lit(float(1 << 24))
    out = (rows.join(rated.select(F.col("key").alias("__mix_key"), F.col("doc").alias("__mix_doc"), F.col("tokens").alias("mix_tokens"),
                                   label.alias("mix_domain"), F.col("rate").alias("mix_rate"),
                                   F.col("alike").alias("__mix_alike")), ["__mix_key", "__mix_doc"])
            .withColumn("mix_copies", (
                F.floor("mix_rate") + (chance < F.col("mix_rate") - F.floor("mix_rate")).cast("long")).cast("int"))
           .drop("__mix_key", "__mix_doc", "__mix_row", "__mix_alike"))
    return out, totals


def op2_mixing_rates(spark, sf_dir: str) -> DataFrame:
    """Rate and number of copies of every document under the target weights, and the target and
    the expected tokens of its domain."""
    docs = table(spark, sf_dir, "documents")
    out, totals = mixed_with_totals(docs.select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))
    of = lambda i: F.element_at(F.create_map(*[
        F.lit(x) for n, t in totals.items() for x in (n, round(t[i]))]), F.col("mix_domain")).cast("long")
    return out.select("doc_id", "mix_tokens", "mix_domain", F.round("mix_rate", 9).alias("mix_rate"), "mix_copies",
                      of(0).alias("mix_target"), of(1).alias("mix_expected"))
