"""Token ids packed into fixed-length rows by best-fit decreasing.

Documents become token ids with a public vocabulary, and a document longer than a row is cut
into pieces of at most a row, in order and without loss. Packing is global: pieces of one length
are alike, so best-fit decreasing runs on the histogram of lengths (at most one line per
length, whatever the corpus), with a segment tree over the free space of open rows. The plan
says which pieces of a length, by their number among that length, go to which rows. Numbers are
given out by counting per partition, rows are put together where their pieces meet after one
shuffle, and no task sees more than one row at a time.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gamelog.llm.common import NO_ID, id_or_none, materialize, rows_per_batch, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# ---- fixed values: word pattern of the vocabulary, its free id ----
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PAD = 50256
# ---- end of fixed values ----
CAPACITY = 2048


def read_vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    """Ranks of a vocabulary file, read on the driver and sent with the tasks (about 1 MB)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def encoder(ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Runs of white space this long overflow the matcher's stack; they are one piece by themselves.
_LONG_GAP = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{512,}")


def encode_with(enc):
    """Ids of a whole text, the same as ``enc.encode_ordinary`` also where that gives up."""
    def encode(text: str) -> list[int]:
        out, at = [], 0
        for m in _LONG_GAP.finditer(text):
            # the last white space goes with what follows, as the pattern has it
            end = m.end() if m.end() == len(text) else m.end() - 1
            out += enc.encode_ordinary(text[at:m.start()])
            out += enc._core_bpe.encode_single_piece(text[m.start():end].encode())
            at = end
        return out + enc.encode_ordinary(text[at:]) if at else enc.encode_ordinary(text)
    return encode


def _pieces(ranks, capacity: int):
    def run(frames):
        encode = encode_with(encoder(ranks.value))
        squeeze = zstandard.ZstdCompressor(level=1, write_checksum=False).compress
        for frame in frames:
            out = []
            for doc, text in zip(frame["doc_id"], frame["text"]):
                ids = np.array(encode(text or ""), np.uint16)
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at:at + capacity]
                    out.append((doc, k, len(part), squeeze(part.tobytes())))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "n", "ids"])
    return run


def token_pieces(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """doc_id (``NO_ID`` if missing), piece, n and ids (16-bit little endian, zstd frame) of each piece
    of a document's tokens."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    return docs.select(id_or_none("doc_id").alias("doc_id"), "text").mapInPandas(
        _pieces(ranks, capacity), "doc_id long, piece int, n int, ids binary")


class SegmentTree:
    """Which capacities have open rows; finds the smallest one at least as large as asked."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.any = [False] * (2 * self.leaves)

    def set(self, at: int, value: bool) -> None:
        node = at + self.leaves
        self.any[node] = value
        while node > 1:
            node //= 2
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]

    def at_least(self, low: int) -> int | None:
        node = low + self.leaves
        if self.any[node]:
            return low
        while node > 1:
            if node % 2 == 0 and self.any[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.any[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def best_fit_plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over ``counts`` (length: pieces).

    Returns lines (length, first, count, row, per): pieces number first .. first + count - 1 of
    that length go to rows row, row + 1, ..., ``per`` of them to each; and the number of rows.
    Rows of equal free space are alike, so they are kept as ranges; what one piece at a time
    would do (the fullest row that fits takes pieces until it no longer does) is done to a
    whole range at once.
    """
    free: dict[int, list[list[int]]] = {}
    tree, lines, rows = SegmentTree(capacity), [], 0

    def put(space: int, row: int, count: int) -> None:
        if count and space:
            if not free.get(space):
                tree.set(space, True)
            free.setdefault(space, []).append([row, count])

    for length in sorted(counts, reverse=True):
        first, left = 0, counts[length]
        while left:
            space = tree.at_least(length)
            if space is None:
                space = capacity
                row, count = rows, -(-left // (capacity // length))
                rows += count
            else:
                row, count = free[space].pop()
                if not free[space]:
                    tree.set(space, False)
            per = space // length
            taken = min(left, count * per)
            whole, some = divmod(taken, per)
            put(space - per * length, row, whole)
            put(space - some * length, row + whole, 1 if some else 0)
            used = whole + bool(some)
            put(space, row + used, count - used)
            lines.append((length, first, taken, row, per))
            first, left = first + taken, left - taken
    return np.array(lines, np.int64).reshape(-1, 5), rows


def _rows_of(plan):
    def run(frames):
        lines = plan.value
        lengths = lines[:, 0]
        low = np.searchsorted(lengths, np.arange(lengths.max() + 2)) if len(lines) else None
        for frame in frames:
            n, number = frame["n"].to_numpy(), frame["number"].to_numpy()
            at = np.empty(len(frame), np.int64)
            for length in np.unique(n):
                here = n == length
                own = lines[low[length]:low[length + 1]]
                at[here] = low[length] + np.searchsorted(own[:, 1], number[here], "right") - 1
            row = lines[at, 3] + (number - lines[at, 1]) // lines[at, 4]
            yield pd.DataFrame({"pid": frame["pid"], "row": row})
    return run


def _assemble(capacity: int, pad: int):
    """Whole rows from pieces that come sorted by row."""
    def finish(row, parts, expand):
        sizes = [p[2] for p in parts]
        ids = np.full(capacity, pad, np.uint16)
        places = np.zeros(capacity, np.uint16)
        ends = np.cumsum([0, *sizes])
        for (_, _, n, data), at in zip(parts, ends):
            ids[at:at + n] = np.frombuffer(expand(data), np.uint16)
            places[at:at + n] = np.arange(n)
        return (row, int(ends[-1]), ids.tobytes(), ends.tolist(), ends[:-1].tolist(), places.tobytes(),
                [p[0] for p in parts], [p[1] for p in parts])

    names = [c.split()[0] for c in PACKED.split(", ")]

    def run(frames):
        expand = zstandard.ZstdDecompressor().decompress
        row, parts = None, []
        for frame in frames:
            out = []
            for r, d, k, n, data in zip(*(frame[c] for c in ("row", "doc_id", "piece", "n", "ids"))):
                if r != row:
                    if parts:
                        out.append(finish(row, parts, expand))
                    row, parts = r, []
                parts.append((None if d == NO_ID else d, k, n, data))
            yield pd.DataFrame(out, columns=names)
        if parts:
            yield pd.DataFrame([finish(row, parts, expand)], columns=names)
    return run


PACKED = ("row_id long, n_tokens int, input_ids binary, cu_seqlens array<int>, position_resets array<int>, "
          "position_ids binary, doc_ids array<bigint>, pieces array<int>")


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, pad: int = PAD) -> DataFrame:
    """Rows of ``capacity`` token ids, each holding whole pieces of documents.

    Columns: row_id; n_tokens in use; input_ids and position_ids (``capacity`` 16-bit numbers,
    little endian; ids are padded with ``pad``, positions restart at 0 with each piece and are 0
    in the padding); cu_seqlens (0 and the end of each piece); position_resets (where positions
    restart); doc_ids and pieces (which piece of which document, in order).

    A missing or empty text has no tokens and is in no row; a document without an id is packed
    under a null id; rows that repeat are packed as often as they occur; an empty table gives no
    rows; other columns are ignored.
    """
    if not 0 < capacity <= 1 << 16:
        raise ValueError("capacity must be 1 to 65536")
    spark = docs.sparkSession
    rows_per_batch(spark)
    pieces = materialize(token_pieces(docs, vocabulary, capacity).withColumn(
        "pid", F.monotonically_increasing_id()), "pieces")
    slim = pieces.select("pid", "n", F.shiftright("pid", 33).alias("part"))
    tally = materialize(slim.groupBy("n", "part").agg(F.count(F.lit(1)).alias("c")), "tally")
    counts = {r["n"]: r["c"] for r in tally.groupBy("n").agg(F.sum("c").alias("c")).collect()}  # <= capacity lines
    lines, _ = best_fit_plan(counts, capacity)
    plan = spark.sparkContext.broadcast(lines[np.lexsort((lines[:, 1], lines[:, 0]))])
    before = F.coalesce(F.sum("c").over(Window.partitionBy("n").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    numbered = (slim.withColumn("k", F.row_number().over(Window.partitionBy("n", "part").orderBy("pid")))
                .join(tally.select("n", "part", before.alias("before")), ["n", "part"])
                .select("pid", "n", (F.col("before") + F.col("k") - 1).alias("number")))
    placed = numbered.mapInPandas(_rows_of(plan), "pid long, row long")
    return (pieces.join(placed, "pid").repartition("row").sortWithinPartitions("row", F.desc("n"), "pid")
            .select("row", "doc_id", "piece", "n", "ids").mapInPandas(_assemble(capacity, pad), PACKED))


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """Write ``pack`` as Parquet: each row's ids and positions are one fixed-length binary."""
    pack(docs, **options).write.mode("overwrite").parquet(path)


def op7_packed_tokens(spark, sf_dir: str) -> DataFrame:
    """All documents as packed rows of 2,048 token ids."""
    return pack(table(spark, sf_dir, "documents"))
