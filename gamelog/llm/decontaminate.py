"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Documents and test items are sequences of words without case and punctuation. An item's seeds
are its word trigrams: all that few items share, and of those that many items share (phrases of
the kind "which of the", passages asked about again and again) only as many as it takes. A
passage can be a leak through such phrases alone only if they cover as many of its words as the
threshold asks for; so the most common ones, as long as they cover fewer words than that, are no
seeds, and the others are seeds only in documents where common trigrams cover that many words.
What shares no more with an item than a phrase is never paired with it.

One scan finds the trigrams of all documents that may be seeds (fixed-size bitmaps of hashes let
nearly all others go) and a join says which items they belong to. Every passage with a seed is a
candidate, however many documents hold it, and is aligned with the item word by word, unless it
has too few of the item's words to reach the threshold at all. The score is matches less
mismatches and gaps, as a share of the item's words (of 32 for longer items), so copies that were
cut, edited or partly reworded still score high.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gamelog.llm.common import (Scratch, hash_map, id_map, in_hash_map, in_map, materialize, rows_per_batch, shingle_hashes,
                                signed, table, word_hashes)

GRAM = 3
THRESHOLD = 0.4
FULL = 32  # so many words in a row are a whole leak, however long the item
RARE = 8  # a trigram of more items than this is common
SALT = 16  # parts of a document trigram that very many documents hold
ITEMS = 64  # items that one row of a document carries to the alignment


def words_of(text: str | None) -> np.ndarray:
    return word_hashes(text, signs=False)


def align(passage: np.ndarray, item: np.ndarray) -> int:
    """Best local alignment score of two word sequences: match 1, mismatch -1, gap -1."""
    if not len(passage) or not len(item):
        return 0
    along = np.arange(len(passage) + 1)
    row = np.zeros(len(passage) + 1, np.int64)
    best = 0
    for word in item:
        new = np.maximum(row - 1, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(passage == word, 1, -1))
        row = np.maximum.accumulate(new + along) - along  # gaps along the passage
        best = max(best, int(row.max()))
    return best


def _item_words(frames):
    for frame in frames:
        out = []
        for item, text in zip(frame["item_id"], frame["text"]):
            w = words_of(text)
            if len(w) >= GRAM:
                out.append((item, len(w), w.tobytes()))
        yield pd.DataFrame(out, columns=["item_id", "n", "words"])


def _item_grams(frames):
    for frame in frames:
        out = []
        for item, data in zip(frame["item"], frame["words"]):
            grams = np.unique(shingle_hashes(np.frombuffer(data, np.uint64), GRAM))
            out.append(pd.DataFrame({"item": item, "gram": signed(grams)}))
        if out:
            yield pd.concat(out)


def covered_words(at: np.ndarray) -> int:
    """How many words the trigrams that start at the sorted places ``at`` cover."""
    return int(np.minimum(np.diff(at), GRAM).sum()) + GRAM if len(at) else 0


def needed_words(n: int, threshold: float) -> int:
    """Words that must match for an item of ``n`` words."""
    return int(np.ceil(threshold * min(n, FULL) - 1e-6))


def _common_seeds(threshold: float):
    """Of the common trigrams of an item, those that must be looked for (see ``seed_table``)."""
    def run(frames):
        for frame in frames:
            out = []
            for item, data, grams, shared in zip(*(frame[c] for c in ("item", "words", "grams", "shared"))):
                here = signed(shingle_hashes(np.frombuffer(data, np.uint64), GRAM))
                need = needed_words(len(here) + GRAM - 1, threshold)
                grams, shared = np.asarray(grams, np.int64), np.asarray(shared, np.int64)
                if covered_words(np.flatnonzero(np.isin(here, grams))) < need:
                    continue
                grams = grams[np.lexsort((grams, -shared))]
                left_out = 0
                while covered_words(np.flatnonzero(np.isin(here, grams[:left_out + 1]))) < need:
                    left_out += 1
                out.append(pd.DataFrame({"item": item, "gram": grams[left_out:], "need": need}))
            if out:
                yield pd.concat(out)
    return run


def seed_table(items: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Seeds (item, gram, need) of ``items`` (item, words), and the common trigrams (gram).

    Every trigram of at most ``RARE`` items is a seed of each, with ``need`` 0. An item whose
    common trigrams cover fewer words than the threshold asks for cannot be found by them alone.
    Of the others, the most common are left out as long as they cover fewer; the rest are seeds in
    documents where common trigrams cover ``need`` words.
    """
    grams = materialize(items.select("item", "words").mapInPandas(_item_grams, "item long, gram long"), "grams")
    common = materialize(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") > RARE), "common")
    rare = grams.join(common, "gram", "left_anti").select("item", "gram", F.lit(0).alias("need"))
    held = grams.join(common, "gram").groupBy("item").agg(F.collect_list(F.struct("gram", "shared")).alias("g"))
    more = held.join(items, "item").select("item", "words", F.col("g.gram").alias("grams"), F.col("g.shared").alias("shared"))
    more = more.mapInPandas(_common_seeds(threshold), "item long, gram long, need int")
    return materialize(rare.unionByName(more), "seeds"), common.select("gram")


def _hits(bits, common):
    """Places of possible seeds, each with how many words common trigrams cover around it."""
    def run(frames):
        for frame in frames:
            out = []
            for doc, text in zip(frame["doc_id"], frame["text"]):
                w = words_of(text)
                if len(w) < GRAM:
                    continue
                grams = shingle_hashes(w, GRAM)
                at = np.flatnonzero(in_hash_map(bits.value, grams))
                if not len(at):
                    continue
                covered = np.zeros(len(at), np.int64)
                phrases = np.flatnonzero(in_hash_map(common.value, grams))
                # a gap of more words than a whole leak has is never part of the best alignment
                for part in np.split(phrases, np.flatnonzero(np.diff(phrases) > 2 * FULL) + 1):
                    if len(part):
                        covered[np.searchsorted(at, part[0]):np.searchsorted(at, part[-1], "right")] = covered_words(part)
                out.append((np.full(len(at), doc), signed(grams[at]), at, covered))
            if out:
                doc, gram, at, covered = map(np.concatenate, zip(*out))
                yield pd.DataFrame({"doc_id": doc, "gram": gram, "at": at, "covered": covered})
    return run


def _only(docs_in):
    def run(frames):
        for frame in frames:
            yield frame[in_map(docs_in.value, frame["doc_id"])]
    return run


def _windows(at: np.ndarray, reach: int, end: int):
    """Stretches (from, to) of words within ``reach`` of the seeds at ``at``, merged where they meet."""
    at = np.sort(at)
    at = at[at <= end - GRAM]
    for part in np.split(at, np.flatnonzero(np.diff(at) > 2 * reach + GRAM) + 1):
        if len(part):
            yield max(int(part[0]) - reach, 0), min(int(part[-1]) + GRAM + reach, end)


def _align(threshold):
    def run(frames):
        for frame in frames:
            out = []
            for doc, text, *pairs in zip(*(frame[c] for c in ("doc_id", "text", "item", "n", "words", "at"))):
                words = words_of(text)
                for item, n, data, at in zip(*pairs):
                    target = np.frombuffer(data, np.uint64)
                    full = min(n, FULL)
                    for low, high in _windows(np.asarray(at, np.int64), 2 * n, len(words)):
                        passage = words[low:high]
                        # no more words can match than the passage has of the item
                        if int(np.isin(target, passage).sum()) / full < threshold - 1e-6:
                            continue
                        score = round(min(align(passage, target) / full, 1.0), 6)
                        if score >= threshold:
                            seeds = np.intersect1d(shingle_hashes(passage, GRAM), shingle_hashes(target, GRAM))
                            out.append((doc, item, len(seeds), score))
            yield pd.DataFrame(out, columns=["doc_id", "item", "seeds", "score"])
    return run


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of a document and a test item found in it: doc_id, item_id, score, seeds.

    ``score`` is the alignment score over the item's words, or over 32 for longer items,
    ``threshold`` to 1; ``seeds`` the number of different seeds in the passage, the largest of an item's passages.

    - Items of fewer than three words identify nothing and are left out, as are documents
      without an id, text or three words.
    - Items with the same words are aligned once and given out each.
    - A passage is looked at if it keeps a trigram that at most ``RARE`` items have, or if trigrams
      of the item that more have cover as many words as the threshold asks for.
    - Rows sharing a doc_id are one document, found by the best of them.
    - Empty tables give no pairs; other columns are ignored.
    """
    with Scratch(docs.sparkSession) as scratch:
        out = materialize(_contaminated(docs, items, threshold), "contaminated")
        scratch.keep(out)
    return out


def _contaminated(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    spark = docs.sparkSession
    rows_per_batch(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(
        "doc_id IS NOT NULL AND text IS NOT NULL")
    listed = materialize(items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(
        "item_id IS NOT NULL").mapInPandas(_item_words, "item_id long, n int, words binary"), "items")
    own = listed.groupBy("words").agg(F.min("item_id").alias("item"), F.first("n").alias("n"))
    own = materialize(own, "items")
    seeds, common = seed_table(own, threshold)
    bits, phrases = (spark.sparkContext.broadcast(hash_map(t, "gram")) for t in (seeds, common))
    # a trigram that very many documents hold goes to several tasks
    dealt = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    hits = rows.mapInPandas(_hits(bits, phrases), "doc_id long, gram long, at int, covered int").withColumn(
        "salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int"))
    # one seed is enough: what lies between seeds may still carry a passage over the threshold
    pairs = materialize(hits.join(dealt, ["gram", "salt"]).filter("covered >= need").groupBy("doc_id", "item").agg(
        F.collect_set("at").alias("at")), "pairs")
    # a document's items go with its text, some in a row
    per = pairs.groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / ITEMS).alias("parts"))
    found = materialize(pairs.join(per, "doc_id").join(own, "item").groupBy(
        "doc_id", F.expr("pmod(xxhash64(item), parts)").alias("part")).agg(
        F.collect_list(F.struct("item", "n", "words", "at")).alias("p")).select(
        "doc_id", "p.item", "p.n", "p.words", "p.at"), "candidates")
    # the texts that are joined with their candidates are few: a map of ids leaves the others out
    docs_in = spark.sparkContext.broadcast(id_map(found, "doc_id"))
    scored = (rows.mapInPandas(_only(docs_in), "doc_id long, text string").join(found, "doc_id")
              .select("doc_id", "text", "item", "n", "words", "at")
              .mapInPandas(_align(threshold), "doc_id long, item long, seeds long, score double"))
    best = scored.groupBy("doc_id", "item").agg(F.max("score").alias("score"), F.max("seeds").alias("seeds"))
    alike = listed.join(own.select("words", "item"), "words").select("item", "item_id")
    return best.join(alike, "item").select("doc_id", "item_id", "score", "seeds")


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, whole, cut or edited."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
