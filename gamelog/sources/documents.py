"""Landed JSON documents: schedules and live feeds, one document per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole-file text documents: ``doc_id`` (file path) and ``value``.

    Landing folders may be partitioned (``date=YYYY-MM-DD/``); the partition column is kept
    so date filters prune folders before any file is opened.
    """
    docs = spark.read.option("wholetext", "true").text(path)
    return docs.select(F.col("_metadata.file_path").alias("doc_id"), "*")


def read_schedules(spark: SparkSession, path: str, date: str | None = None) -> DataFrame:
    """Schedule documents, optionally only those landed for one ``date`` partition."""
    docs = read_documents(spark, path)
    if date is not None:
        docs = docs.filter(F.col("date") == F.lit(date))
    return docs


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Live-feed documents, one per game per poll."""
    return read_documents(spark, path)
