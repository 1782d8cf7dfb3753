"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gamelog.session import scratch_dir


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    Cuts the lineage with files every executor can read, so a lost executor costs a re-read
    and not a recomputation, and a result used several times is computed once. The table stays
    until ``drop``, the end of the ``Scratch`` it was made in, or else the end of the session.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, f"{tag}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    register(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


_OPEN: list[Scratch] = []
_FACTOR = "spark.sql.sources.fileCompressionFactor"


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def register(spark: SparkSession, path: str) -> None:
    """A folder of intermediate files, for the innermost open ``Scratch`` or the end of the session."""
    if _OPEN:
        _OPEN[-1].paths.add(path)
    else:
        fs, folder = _folder(spark, path)
        fs.deleteOnExit(folder)


def drop(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for t in tables:
        fs, folder = _folder(t.sparkSession, t.scratch_path)
        fs.delete(folder, True)
        for scope in _OPEN:
            scope.paths.discard(t.scratch_path)


class Scratch:
    """The intermediate tables of an operator: on leaving, all go but those its result reads.

    These are named with ``keep`` and pass to the scope around this one.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, set(), set()

    def keep(self, *tables: DataFrame) -> None:
        self.kept.update(t.scratch_path for t in tables)

    def __enter__(self):
        _OPEN.append(self)
        # files are compressed: a join must not take a table for small because its files are
        self.factor = self.spark.conf.get(_FACTOR)
        self.spark.conf.set(_FACTOR, "10")
        return self

    def __exit__(self, *_):
        _OPEN.pop()
        self.spark.conf.set(_FACTOR, self.factor)
        for path in self.paths - self.kept:
            fs, folder = _folder(self.spark, path)
            fs.delete(folder, True)
        for path in self.paths & self.kept:
            register(self.spark, path)
        # lets Spark's cleaner see that the shuffles of the steps behind are free
        self.spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Stands for a missing id on the way through pandas, where a null would turn ids into doubles.
NO_ID = -(1 << 63)


def id_or_none(column) -> Column:
    """An id as a long, ``NO_ID`` for a missing one."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def text_bytes(text) -> Column:
    """UTF-8 length of a text; a missing text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


TEXT_ROWS = 1000


def rows_per_batch(spark: SparkSession, n: int = TEXT_ROWS) -> None:
    """Rows per Arrow batch from here on, so that a batch of long texts stays small in JVM and Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(n))


# ---- words and shingles as 64-bit numbers ----

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_SIGN = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])  # gaps between letters and digits
_BYTE = np.random.default_rng(20240716).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_MUL1, _MUL2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(1 << 16, 0x5851F42D4C957F2D, np.uint64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of ``x``."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MUL1
    x ^= x >> np.uint64(27)
    x *= _MUL2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    if n <= len(_POWERS):
        return _POWERS[:n]
    return np.cumprod(np.full(n, 0x5851F42D4C957F2D, np.uint64))


def word_hashes(text: str | None, signs: bool = True) -> np.ndarray:
    """64-bit hash of each word (run of non-space characters, A-Z lower-cased) in order.

    Without ``signs``, ASCII characters that are no letters or digits also end a word.
    """
    if not text:
        return np.empty(0, np.uint64)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_LOWER), np.uint8)
    gap = (_SPACE if signs else _SIGN)[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    start, size = edge[0::2], edge[1::2] - edge[0::2]
    if not len(start):
        return np.empty(0, np.uint64)
    # the bytes of all words, and the place of each byte in its word
    value = _BYTE[data[~gap]]
    first = np.cumsum(size) - size
    value *= _powers(int(size.max()))[np.arange(len(value)) - np.repeat(first, size)]
    return mix64(np.add.reduceat(value, first) + size.astype(np.uint64))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words; with fewer words, of the whole sequence; none: empty."""
    if not len(words):
        return words
    width = min(n, len(words))
    count = len(words) - width + 1
    out = words[:count].copy()
    for k in range(1, width):
        out = mix64(out * _STEP + words[k:k + count])
    return out + np.uint64(width)


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark longs."""
    return x.view(np.int64)


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_words(text: str | None) -> list[str]:
    """The words that ``word_hashes`` hashes, as text."""
    return WORD.findall((text or "").translate(_ASCII_LOWER))


# ---- a fixed-size map of ids, to leave most other rows out before a join ----

MAP_BITS = 24


def hash_map(hashes: DataFrame, column: str) -> np.ndarray:
    """One flag per value of the last 24 bits of ``column`` (long): 2 MB sent, whatever the input."""
    cut = F.col(column).bitwiseAND((1 << MAP_BITS) - 1)
    rows = hashes.select(F.shiftright(cut, 6).alias("at"), cut.bitwiseAND(63).cast("int").alias("bit")).groupBy(
        "at").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toPandas()
    bits = np.zeros(1 << (MAP_BITS - 6), np.int64)
    bits[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return bits.view(np.uint8)


def in_hash_map(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    cut = (hashes & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)
    return (bits[cut >> 3] >> (cut & 7).astype(np.uint8)) & 1 == 1


def id_map(ids: DataFrame, column: str) -> np.ndarray:
    """A map of integer ids: rows outside it are surely not among them."""
    spread = F.col(column).cast("long").bitwiseXOR(F.shiftrightunsigned(F.col(column).cast("long"), 24))
    return hash_map(ids.select(spread.alias("h")), "h")


def in_map(bits: np.ndarray, ids) -> np.ndarray:
    """Whether each of ``ids`` (no nulls) may be in the map."""
    ids = np.asarray(ids, np.int64).view(np.uint64)
    return in_hash_map(bits, ids ^ (ids >> np.uint64(24)))
