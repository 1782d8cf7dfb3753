"""Corpus pipeline: toxicity, near duplicates, decontamination, mixing, packed token ids.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read
again as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gamelog.llm.common import Scratch, drop, materialize, table
from gamelog.llm.decontaminate import contaminated
from gamelog.llm.hamming_dedup import near_groups
from gamelog.llm.mixing import mixed
from gamelog.llm.packing import pack
from gamelog.llm.toxicity import fit, score

#: Near duplicates share 80 percent of their five-word shingles or more.
SHINGLE, PERCENT = 5, 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5, from their whole texts."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).filter("score < 0.5").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id.

    Documents without words and rows without an id are in no group and stay. Rows that share an
    id are one document, of which the first row (in order of the columns' values) stays.
    """
    with Scratch(spark) as scratch:
        ids = materialize(near_groups(docs, width=SHINGLE, percent=PERCENT).filter(
            "kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "kept")
        scratch.keep(ids)
    single = docs.join(ids.filter("n = 1").select("doc_id"), "doc_id", "left_semi")
    again = docs.join(ids.filter("n > 1").select("doc_id"), "doc_id", "left_semi")
    first = again.groupBy(F.col("doc_id").alias("id")).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return single.select(docs.columns).unionByName(first).unionByName(docs.filter("doc_id IS NULL"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found. Rows without an id stay."""
    found = contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rates say, towards the target domain weights."""
    out = mixed(docs, table(spark, sf_dir, "labels"))
    return out.withColumn("__copy", F.explode(F.expr("array_repeat(1, mix_copies)"))).select(docs.columns)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of 2,048 token ids."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("pack", pack_tokens),
]

# Learned lexicons, fitted rates and token ids are beyond SQL: tests hold each stage against a
# plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; a stage's input and own tables go when its result is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with Scratch(spark) as scratch:
            docs = materialize(stage(spark, docs, sf_dir), name)
            scratch.keep(docs)
        drop(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
