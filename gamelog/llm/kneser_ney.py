"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is a byte 5-gram model per language, trained on all trusted documents. Its counts are
tables keyed by (language, gram): full counts for the highest order, numbers of different left
neighbours below, with three discounts an order from the counts of counts. Every table is spread
over the cluster by its key; probabilities of seen grams and backoff weights of contexts come
from joins of an order with the one below.

Documents are scored by joins as well, and to keep those small the grams of a block of documents
(a task's share of the text) are first taken together: each different gram of a block is joined
with the model once, and the answers meet the block again, where they are summed along each
document. Blocks are written compressed and bucketed, so the text is never shuffled. Nothing of
the model is broadcast, and what is shuffled grows with the text.
"""

from __future__ import annotations

import pickle
import uuid

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gamelog.llm.common import Scratch, id_map, in_map, materialize, register, rows_per_batch, table
from gamelog.session import scratch_dir

ORDER = 5
BLOCK_BYTES = 64 << 20  # of text, at most, in a block
BLOB_BYTES = 8 << 20  # of a block's text compressed together
PART_BYTES = 2 << 20  # of text looked at together
QUANTILE = 0.99
HELD_OUT = 10  # one trusted document in so many is for the limit
START = 0x02  # stands before the text, ORDER - 1 times


def _bytes(text: str | None) -> bytes:
    """Bytes of a text, lower case, runs of white space as one space."""
    return " ".join((text or "").lower().split()).encode("utf-8", "surrogatepass")


def _grams(texts: list[bytes]) -> np.ndarray:
    """The gram (as a number of 40 bits) that ends at each byte of the texts, one after another."""
    pad = bytes([START] * (ORDER - 1))
    wide = np.frombuffer(pad + pad.join(texts), np.uint8).astype(np.uint64)
    out = np.zeros(len(wide) - ORDER + 1, np.uint64)
    for k in range(ORDER):
        out = (out << np.uint64(8)) | wide[k:k + len(out)]
    # without those that end in the padding between texts
    keep = np.ones(len(out), bool)
    ends = np.cumsum([len(t) + ORDER - 1 for t in texts[:-1]], dtype=np.int64)
    for k in range(1, ORDER):
        keep[ends - k] = False
    return out[keep]


def _counted(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of the texts and their counts."""
    gram, n = np.empty(0, np.uint64), np.empty(0, np.int64)
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= PART_BYTES):
            size += len(texts[to])
            to += 1
        g, c = np.unique(_grams(texts[at:to]), return_counts=True)
        gram, place = np.unique(np.concatenate((gram, g)), return_inverse=True)
        n = np.bincount(place, np.concatenate((n, c)), len(gram)).astype(np.int64)
        at = to
    return gram, n


def _count_grams(frames):
    """Gram counts of each language in a task's share of trusted texts (zstd frames)."""
    expand = zstandard.ZstdDecompressor().decompress
    held: dict[str, list[bytes]] = {}
    sums: dict[str, list[np.ndarray]] = {}

    def take(lang):
        gram, n = _counted(held.pop(lang))
        old = sums.get(lang)
        if old:
            gram, place = np.unique(np.concatenate((old[0], gram)), return_inverse=True)
            n = np.bincount(place, np.concatenate((old[1], n)), len(gram)).astype(np.int64)
        sums[lang] = [gram, n]

    size = 0
    for frame in frames:
        for lang, packed in zip(frame["lang"], frame["packed"]):
            data = expand(packed)
            held.setdefault(lang, []).append(data)
            size += len(data)
            if size >= PART_BYTES:
                for key in list(held):
                    take(key)
                size = 0
    for key in list(held):
        take(key)
    for lang, (gram, n) in sums.items():
        yield pd.DataFrame({"lang": lang, "gram": gram.astype(np.int64), "n": n})


def packed_texts(docs: DataFrame, known=None) -> DataFrame:
    """doc_id, lang and packed (a zstd frame of the normalised text) of ``docs`` (doc_id, lang, text).

    ``known``: a broadcast map of ids; rows surely outside it are left out.
    """
    def run(frames):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for frame in frames:
            frame = frame if known is None else frame[in_map(known.value, frame["doc_id"])]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "lang": frame["lang"],
                                "packed": [squeeze(_bytes(t)) for t in frame["text"]]})
    return docs.select("doc_id", "lang", "text").mapInPandas(run, "doc_id long, lang string, packed binary")


def _discounts(level: DataFrame) -> DataFrame:
    """Discounts d1, d2, d3 of each language from the counts of counts of an order."""
    n = [F.sum((F.col("n") == i).cast("double")).alias(f"c{i}") for i in (1, 2, 3, 4)]
    c = level.groupBy("lang").agg(*n)
    y = F.col("c1") / (F.col("c1") + 2 * F.col("c2"))
    rule = lambda k: F.when((F.col(f"c{k}") > 0) & (F.col("c1") > 0), F.greatest(
        F.lit(0.0), k - (k + 1) * y * F.col(f"c{k + 1}") / F.col(f"c{k}"))).otherwise(F.lit(k * 0.5))
    return c.select("lang", *[rule(k).alias(f"d{k}") for k in (1, 2, 3)])


def train(trusted: DataFrame) -> DataFrame:
    """Model lines (lang, order, gram, p, backoff) from the ``packed_texts`` of trusted documents.

    ``p`` is the interpolated probability of the gram's last byte after the bytes before it (null
    for a line that is only a context), ``backoff`` the weight left to the shorter context when
    the whole gram is a context.
    """
    top = trusted.select("lang", "packed").mapInPandas(
        _count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    levels = {ORDER: materialize(top, "grams")}
    for k in range(ORDER - 1, 0, -1):
        # continuation counts: each line one order up is one left neighbour
        low = F.col("gram").bitwiseAND((1 << (8 * k)) - 1).alias("gram")
        levels[k] = materialize(levels[k + 1].select("lang", low).groupBy("lang", "gram").agg(
            F.count(F.lit(1)).alias("n")), "grams")
    below = None
    lines = []
    for k in range(1, ORDER + 1):
        one = levels[k].join(F.broadcast(_discounts(levels[k])), "lang")  # one line a language
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        one = one.withColumn("cut", F.least(cut, F.col("n").cast("double")))
        context = F.shiftright("gram", 8)
        whole = one.groupBy("lang", context.alias("context")).agg(
            F.sum("n").alias("total"), F.sum("cut").alias("freed"))
        one = one.withColumn("context", context).join(whole, ["lang", "context"])
        mass = F.col("freed") / F.col("total")
        if below is None:
            base = F.lit(1.0 / 256)
        else:
            one = one.withColumn("low", F.col("gram").bitwiseAND((1 << (8 * (k - 1))) - 1)).join(
                below.select("lang", F.col("gram").alias("low"), F.col("p").alias("base")), ["lang", "low"])
            base = F.col("base")
        p = (F.col("n") - F.col("cut")) / F.col("total") + mass * base
        below = materialize(one.select("lang", "gram", p.alias("p")), "probabilities")
        lines.append(below.select("lang", F.lit(k).alias("order"), "gram", "p", F.lit(None).cast("double").alias("backoff")))
        lines.append(whole.select("lang", F.lit(k - 1).alias("order"), F.col("context").alias("gram"),
                                  F.lit(None).cast("double").alias("p"),
                                  (F.col("freed") / F.col("total")).alias("backoff")))
    model = lines[0]
    for more in lines[1:]:
        model = model.unionByName(more)
    return materialize(model.groupBy("lang", "order", "gram").agg(
        F.max("p").alias("p"), F.max("backoff").alias("backoff")), "model")


def gram_probabilities(grams: DataFrame, model: DataFrame) -> DataFrame:
    """lang, gram and ``logp``, the log probability of the gram's last byte, of (lang, gram).

    Starts at the longest order; where a gram is unknown, the backoff weight of its context (1 for
    an unknown context) multiplies the probability one order down. Only unknown grams go on.
    """
    left, done = grams.select("lang", "gram", F.lit(0.0).alias("weight")), []
    for k in range(ORDER, 0, -1):
        own = F.col("gram").bitwiseAND((1 << (8 * k)) - 1)
        seen = model.filter((F.col("order") == k) & F.col("p").isNotNull()).select(
            "lang", F.col("gram").alias("own"), "p")
        found = materialize(left.withColumn("own", own).join(seen, ["lang", "own"], "left"), "seen")
        done.append(found.filter("p IS NOT NULL").select("lang", "gram", (F.col("weight") + F.log("p")).alias("logp")))
        held = model.filter((F.col("order") == k - 1) & F.col("backoff").isNotNull()).select(
            "lang", F.col("gram").alias("context"), "backoff")
        left = (found.filter("p IS NULL").withColumn("context", F.shiftright("own", 8))
                .join(held, ["lang", "context"], "left")
                .select("lang", "gram", (F.col("weight") + F.log(F.greatest(
                    F.coalesce("backoff", F.lit(1.0)), F.lit(1e-12)))).alias("weight")))
    out = left.select("lang", "gram", (F.col("weight") + F.lit(float(np.log(1 / 256)))).alias("logp"))
    for part in done:
        out = out.unionByName(part)
    return out


def _blocks(frames):
    """Blocks of a task's rows, one a language: compressed texts in parts, and the distinct grams.

    A block has one language, so that its number alone is the key of the scoring join: with a second key Spark
    does not take the buckets for the join's partitions, and shuffles the texts.
    """
    task = TaskContext.get()
    part = task.partitionId() if task else 0
    squeeze = zstandard.ZstdCompressor(level=9).compress
    count, size, held, grams, number = 0, 0, {}, {}, {}

    def line(lang, gram=None, blob=None):
        return pd.DataFrame({"block": [(part << 24) | number[lang]], "lang": [lang], "grams": [gram], "blob": [blob]})

    def texts_of(lang):
        rows, docs, texts = held.pop(lang)
        gram, _ = _counted(texts)
        grams[lang] = np.union1d(grams[lang], gram) if lang in grams else gram
        sizes = np.array([len(t) for t in texts], np.int64)
        texts = b"".join(texts)  # one copy at a time
        blob = pickle.dumps((np.array(rows, np.int64), np.array(docs, np.int64), sizes, texts))
        del texts
        return line(lang, blob=squeeze(blob))

    def rest():
        for lang in list(held):
            yield texts_of(lang)
        for lang in list(grams):
            yield line(lang, gram=grams.pop(lang).astype(np.int64))

    waiting: dict[str, int] = {}
    for frame in frames:
        for row, doc, lang, text in zip(*(frame[c] for c in ("row", "doc", "lang", "text"))):
            data = _bytes(text)
            if not data:
                continue
            if size and size + len(data) > BLOCK_BYTES:
                yield from rest()
                size, waiting, number = 0, {}, {}
            if lang not in number:
                number[lang], count = count, count + 1
            for column, value in zip(held.setdefault(lang, ([], [], [])), (row, doc, data)):
                column.append(value)
            size += len(data)
            waiting[lang] = waiting.get(lang, 0) + len(data)
            if waiting[lang] >= BLOB_BYTES:
                yield texts_of(lang)
                waiting[lang] = 0
    yield from rest()


def _score(key, blocks: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    known = known.sort_values("gram")
    gram, logp = known["gram"].to_numpy().astype(np.uint64), known["logp"].to_numpy()
    out = []
    for blob in blocks["blob"]:
        rows, docs, sizes, data = pickle.loads(zstandard.ZstdDecompressor().decompress(blob))
        ends = np.cumsum(sizes)
        at = 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + PART_BYTES, "right")))
            texts = [data[e - n:e] for e, n in zip(ends[at:to], sizes[at:to])]
            value = logp[np.searchsorted(gram, _grams(texts))]
            total = np.add.reduceat(value, np.cumsum(sizes[at:to]) - sizes[at:to])
            out.append(pd.DataFrame({"row": rows[at:to], "doc": docs[at:to], "size": sizes[at:to], "total": total}))
            at = to
    return pd.concat(out) if out else pd.DataFrame(columns=["row", "doc", "size", "total"])


def _bucketed(df: DataFrame, key: str) -> DataFrame:
    """``df`` written to the shared folder in buckets of ``key``; joins on it need no shuffle of it."""
    spark = df.sparkSession
    name = f"blocks_{uuid.uuid4().hex}"
    path = scratch_dir(spark, name)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).option("path", path).option("compression", "zstd").saveAsTable(name)
    register(spark, path)
    out = spark.table(name)
    out.schema  # resolved: the files stay when the name goes
    spark.sql(f"DROP TABLE {name}")
    return out


def perplexities(docs: DataFrame, model: DataFrame) -> DataFrame:
    """row, doc, size (bytes) and perplexity per byte of ``docs`` (row, doc, lang, text).

    Texts without bytes have none. Rows with the same row and doc are given once.
    """
    blocks = _bucketed(docs.select("row", "doc", "lang", "text").mapInPandas(
        _blocks, "block long, lang string, grams array<bigint>, blob binary"), "block")
    grams = blocks.select("block", "lang", F.explode("grams").alias("gram"))
    with Scratch(docs.sparkSession) as scratch:
        own = materialize(gram_probabilities(grams.select("lang", "gram").distinct(), model), "own")
        scratch.keep(own)
    known = grams.join(own, ["lang", "gram"]).select(F.col("block").alias("in_block"), "gram", "logp")
    scored = (blocks.filter("blob IS NOT NULL").select("block", "blob").groupBy("block")
              .cogroup(known.groupBy("in_block"))
              .applyInPandas(_score, "row long, doc long, size long, total double"))
    return scored.dropDuplicates(["row", "doc"]).select("row", "doc", "size", F.exp(
        -F.col("total") / F.col("size")).alias("perplexity"))


def quantile_by_language(scored: DataFrame, q: float) -> DataFrame:
    """lang, and the value that a share ``q`` of the language's rows do not exceed (exact).

    Values are counted in bins first; only the bin that holds the rank is looked into.
    """
    bins = scored.withColumn("bin", F.floor(F.log("perplexity") * 1000))
    counts = bins.groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy("lang").orderBy("bin")
    whole = Window.partitionBy("lang")
    hit = (counts.withColumn("below", F.sum("c").over(upto) - F.col("c"))
           .withColumn("rank", F.greatest(F.ceil(F.sum("c").over(whole) * F.lit(q)), F.lit(1)))
           .filter("rank > below AND rank <= below + c").select("lang", "bin", "rank", "below"))
    # equal values are counted first, so that a text copied often is one row
    inside = bins.join(hit, ["lang", "bin"]).groupBy("lang", "perplexity", "rank", "below").agg(F.count(F.lit(1)).alias("c"))
    upto_here = F.sum("c").over(Window.partitionBy("lang").orderBy("perplexity"))
    return inside.withColumn("upto", F.col("below") + upto_here).filter("rank <= upto AND rank > upto - c").select(
        "lang", F.col("perplexity").alias("limit"))


def kept_out(doc_id) -> Column:
    """Whether a trusted document serves the limit and not the training: one in ``HELD_OUT``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT == 0


def quality(docs: DataFrame, labels: DataFrame, q: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, max_perplexity and keep of every document.

    Trusted text is that of documents labelled quality 1 (and never 0). One in ``HELD_OUT`` of them
    is kept out of the training. A document is kept when its perplexity per byte is at most the ``q``
    quantile of those of its language (of all trusted ones, in a language where none is kept out).

    - An empty or missing text has no perplexity and is not kept.
    - A missing language is a language of its own ('').
    - A language without trusted text has no limit: its documents are kept. Its grams are unknown
      and score as uniform bytes.
    - Rows that repeat are scored each; an empty table gives an empty table; other columns are
      ignored.
    """
    spark = docs.sparkSession
    rows_per_batch(spark)
    doc = F.col("doc_id").cast("long")
    rows = docs.select(F.xxhash64("lang", "text").alias("row"), F.coalesce(doc, F.lit(-(1 << 63))).alias("doc"),
                       doc.alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), "text")
    good = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q")).filter(
        "q = 1").select("doc_id")
    known = docs.sparkSession.sparkContext.broadcast(id_map(good, "doc_id"))
    slim = rows.select("row", "doc", "lang", "text").filter("length(text) > 0")
    with Scratch(spark) as scratch:
        with Scratch(spark) as training:
            trusted = packed_texts(rows.filter("doc_id IS NOT NULL AND text IS NOT NULL"), known)
            held = kept_out(F.col("doc_id"))
            # a language that has no other text trains on all; one line a language
            taught = rows.filter(~held).select("doc_id", "lang").join(good, "doc_id", "left_semi").select("lang").distinct()
            model = train(trusted.join(good, "doc_id", "left_semi").join(F.broadcast(
                taught.withColumn("taught", F.lit(True))), "lang", "left").filter(~held | F.col("taught").isNull()).drop("taught"))
            training.keep(model)
        scored = materialize(perplexities(slim, model), "perplexities")
        scratch.keep(scored)
    base = rows.select("row", "doc", "doc_id", "lang")
    trusted = base.join(good, "doc_id", "left_semi").join(scored, ["row", "doc"]).withColumn("held", kept_out(F.col("doc_id")))
    apart = trusted.filter("held").select("lang").distinct().withColumn("apart", F.lit(True))  # a line a language
    limits = quantile_by_language(trusted.join(F.broadcast(apart), "lang", "left").filter("held OR apart IS NULL"), q)
    out = base.join(scored, ["row", "doc"], "left").join(F.broadcast(limits), "lang", "left")  # one line a language
    return out.select("doc_id", "lang", F.coalesce("size", F.lit(0)).cast("long").alias("n_bytes"), "perplexity",
                      F.col("limit").alias("max_perplexity"),
                      (F.col("perplexity").isNotNull() & (F.col("limit").isNull() | (F.col("perplexity") <= F.col("limit")))
                       ).alias("keep"))


def rejected(decisions: DataFrame, labels: DataFrame) -> DataFrame:
    """lang, quality, docs and rejected (a share) of the labelled rows of ``quality``.

    A document with labels of both kinds is bad.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        F.min("quality").alias("quality"))
    return decisions.join(known, "doc_id").groupBy("lang", "quality").agg(
        F.count(F.lit(1)).alias("docs"), F.avg((~F.col("keep")).cast("double")).alias("rejected"))


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Perplexity and decision for every document."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
