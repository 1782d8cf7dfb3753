"""Sharding by extendible hashing, with DataFrame operations only.

A row's hash is the first 60 bits of the md5 of its key. A directory indexed by hash-prefix
bits points to shards; a shard is one prefix, and only a prefix whose rows exceed the byte
limit splits on another bit. The directory is found from a histogram of bytes per prefix:
the first round looks at 16 bits, and later rounds look 8 bits deeper, reading only the rows
under prefixes that are still too large. Every shard therefore fits its limit, except that a
single row longer than the limit is a shard of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gamelog.llm.common import materialize, table, text_bytes

HASH_BITS = 60
FIRST_BITS, STEP_BITS = 16, 8
SHARD_BYTES = 1 << 20

_H, _N = "__ext_hash", "__ext_bytes"
OUTPUT = ("shard", "shard_depth", "shard_bytes")


def _hash(key: str):
    text = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _bits(prefix, depth):
    """A prefix as text of ``depth`` binary digits."""
    return F.lpad(F.conv(prefix.cast("string"), 10, 2), depth, "0")


def _prefix(bits: int):
    return F.shiftright(F.col(_H), HASH_BITS - bits)


def _split(cells: DataFrame, base: int, bits: int, max_bytes: int) -> DataFrame:
    """Nodes of the prefix tree from ``base`` to ``bits`` whose parent had to split.

    ``cells`` has the bytes and rows of each prefix of ``bits`` bits. Sums per shorter prefix
    come from the cells, so the work is bounded by the directory and not by the rows.
    """
    depths = F.sequence(F.lit(base), F.lit(bits))
    nodes = (cells.select(F.explode(depths).alias("depth"), "cell", "bytes", "n")
             .withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)"))
             .groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
             .withColumn("fits", (F.col("bytes") <= max_bytes) | (F.col("n") == 1)))
    parents = nodes.filter(~F.col("fits")).select(
        (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
    below = (nodes.withColumn("up", F.shiftright("prefix", 1))
             .join(parents, ["depth", "up"], "left_semi").drop("up"))
    if base == 0:
        below = below.unionByName(nodes.filter(F.col("depth") == 0))
    return below


def assign_shards(df: DataFrame, key: str = "doc_id", text: str = "text",
                  max_bytes: int = SHARD_BYTES) -> DataFrame:
    """Add ``shard`` (its hash prefix as binary digits), ``shard_depth`` and ``shard_bytes``.

    - A missing text counts 0 bytes; a missing key hashes like the text 'null'.
    - A row longer than ``max_bytes`` is alone in its shard.
    - Rows that share a key share a hash; when they exceed the limit together, they split on
      the bits of a second hash, of their row number, appended to the first.
    - An empty table gives an empty table. Input columns named like the three added ones are
      replaced.
    """
    rows = (df.drop(*OUTPUT).withColumn(_N, text_bytes(F.col(text)))
            .withColumn(_H, _hash(key)))
    slim = rows.select(_H, _N)
    out, frontier, base, bits = rows, slim, 0, FIRST_BITS
    found, tables = [], []
    overflow = None
    while True:
        cells = (frontier.groupBy(_prefix(bits).alias("cell"))
                 .agg(F.sum(_N).alias("bytes"), F.count(F.lit(1)).alias("n")))
        nodes = materialize(_split(cells, base, bits, max_bytes), "exthash")
        leaves = nodes.filter("fits").select(
            F.explode(F.expr(f"sequence(shiftleft(prefix, {bits} - depth), "
                             f"shiftleft(prefix + 1, {bits} - depth) - 1)")).alias("__ext_cell"),
            _bits(F.col("prefix"), F.col("depth")).alias("__ext_shard"),
            F.col("depth").alias("__ext_depth"), F.col("bytes").alias("__ext_total"))
        tables.append((bits, leaves))
        large = nodes.filter(f"depth = {bits} AND NOT fits").select(F.col("prefix").alias("cell"))
        if large.isEmpty():
            break
        if bits == HASH_BITS:
            overflow = large
            break
        frontier = slim.join(large, _prefix(bits) == F.col("cell"), "left_semi")
        base, bits = bits, min(bits + STEP_BITS, HASH_BITS)
    for i, (bits, leaves) in enumerate(tables):
        names = {c: f"{c}_{i}" for c in leaves.columns}
        out = out.join(leaves.withColumnsRenamed(names),
                       _prefix(bits) == F.col(f"__ext_cell_{i}"), "left").drop(f"__ext_cell_{i}")
        found.append(i)
    pick = lambda c: F.coalesce(*[F.col(f"{c}_{i}") for i in found])
    keep = [c for c in df.columns if c not in OUTPUT]
    done = out.select(*keep, _H, pick("__ext_shard").alias("shard"),
                      pick("__ext_depth").alias("shard_depth"),
                      pick("__ext_total").alias("shard_bytes"))
    if overflow is None:
        return done.drop(_H)
    # Rows of one key: number them once, in a table, and hash the number.
    same = materialize(rows.join(overflow, F.col(_H) == F.col("cell"), "left_semi")
                       .withColumn("__ext_row", F.monotonically_increasing_id()), "exthash-rows")
    head = _bits(F.col(_H), F.lit(HASH_BITS))
    split = assign_shards(same.withColumn("__ext_head", head).drop(_H, _N),
                          "__ext_row", text, max_bytes)
    split = split.select(*keep, F.concat("__ext_head", "shard").alias("shard"),
                         (F.col("shard_depth") + HASH_BITS).alias("shard_depth"), "shard_bytes")
    return done.filter(F.col("shard").isNotNull()).drop(_H).unionByName(split)


def write_shards(df: DataFrame, path: str, **options) -> None:
    """Write each shard of ``assign_shards`` to its own folder ``shard=<prefix>``."""
    (assign_shards(df, **options).repartition("shard")
     .write.mode("overwrite").partitionBy("shard").parquet(path))


def op9_extendible_shards(spark, sf_dir: str) -> DataFrame:
    """Shard of every document at 1 MiB per shard."""
    docs = table(spark, sf_dir, "documents")
    out = assign_shards(docs.select("doc_id", "text"))
    return out.select("doc_id", text_bytes(F.col("text")).alias("n_bytes"), "shard",
                      "shard_depth", "shard_bytes")


OP9_SQL = f"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h
  FROM documents),
e AS (SELECT d.*, CAST(k.range AS INTEGER) AS k, h >> CAST(60 - k.range AS INTEGER) AS p
      FROM d, range(0, 61) k),
s AS (SELECT k, p, sum(n_bytes) AS b FROM e GROUP BY k, p
      HAVING sum(n_bytes) <= {SHARD_BYTES} OR count(*) = 1),
f AS (SELECT doc_id, n_bytes, h, min(k) AS k FROM e JOIN s USING (k, p)
      GROUP BY doc_id, n_bytes, h)
SELECT f.doc_id, f.n_bytes,
       CASE WHEN f.k = 0 THEN '' ELSE lpad(bin(s.p), f.k, '0') END AS shard,
       f.k AS shard_depth, CAST(s.b AS BIGINT) AS shard_bytes
FROM f JOIN s ON s.k = f.k AND s.p = f.h >> CAST(60 - f.k AS INTEGER)
"""
