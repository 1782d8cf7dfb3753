"""Ordered scans per group that stay bounded when one group holds most of the rows.

A plain ``Window.partitionBy(group).orderBy(...)`` sends a whole group to one task. Here every
group is cut into chunks by a column the caller gives, a plain formula on the order columns
that never decreases along the order (a log offset or a time divided by a step, say). The scan
runs inside each (group, chunk) with ordinary window functions, and a summary with one row per
(group, chunk) carries the state across chunks: a parallel prefix scan in DataFrame operations.
The summary is scanned the same way, in spans of ``SPAN`` chunks, so that no window holds all
chunks of a large group. Nothing runs while the plan is built.

Where a caller can tell cheaply how large groups are (``sizes``), only the large ones are cut and the
others are scanned by plain windows. The large ones are told by hashes of their keys in a broadcast
table of bounded size; where there are none, adaptive execution drops the part for them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gamelog.functions.cols import shared_shuffle

SPAN = 1024
# A group of more rows than this is large.
WHOLE_ROWS = 1 << 16
# hashes of keys that tell large groups apart; groups that share one with a large group are cut too
BUCKETS = 4096
_CHUNK, _SPAN, _RN = "_scan_chunk", "_scan_span", "_scan_rn"


def ordered_scan(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    *,
    prev: Sequence[str] = (),
    fill: Sequence[str] = (),
    before: Sequence[str] = (),
    first: Sequence[str] = (),
    ordinal: str | None = None,
    sizes: DataFrame | None = None,
    whole: int = WHOLE_ROWS,
) -> DataFrame:
    """Add scan columns per ``group`` in ascending ``order`` (group + order should be unique).

    - ``prev_<c>``: value of ``c`` in the previous row of the group (NULL on the first row);
    - ``fill_<c>``: last non-null ``c`` up to and including this row (forward fill);
    - ``before_<c>``: last non-null ``c`` strictly before this row;
    - ``first_<c>``: value of ``c`` in the first row of the group;
    - ``ordinal``: 0-based position of the row in its group.

    ``chunk`` is a whole number that does not decrease along ``order``; NULL sorts first.
    ``sizes``, rows with the ``group`` columns, tell how many rows a group has; without them, or if it has more than
    ``whole``, a group is cut. They decide how the work is dealt, never the result.
    """
    group, order = list(group), list(order)
    if sizes is None:
        return _cut_scan(df, group, order, chunk, prev, fill, before, first, ordinal)
    small, large = by_size(df, group, sizes, whole)
    return _whole_scan(small, group, order, prev, fill, before, first, ordinal).unionByName(
        _cut_scan(large, group, order, chunk, prev, fill, before, first, ordinal))


def by_size(df: DataFrame, group: Sequence[str], sizes: DataFrame, whole: int = WHOLE_ROWS) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose groups have at most ``whole`` rows in ``sizes``, and the others."""
    bucket = F.pmod(F.xxhash64(*group), F.lit(BUCKETS))
    large = F.broadcast(sizes.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > whole)
                        .select(bucket.alias("_scan_bucket")).distinct())
    return tuple(df.join(large, bucket == F.col("_scan_bucket"), how) for how in ("left_anti", "left_semi"))


def _whole_scan(df: DataFrame, group, order, prev, fill, before, first, ordinal) -> DataFrame:
    """``ordered_scan`` of groups that a task can hold, by windows over them."""
    w = Window.partitionBy(*group).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    added = [F.lag(c).over(w).alias(f"prev_{c}") for c in prev]
    added += [F.last(c, ignorenulls=True).over(run).alias(f"fill_{c}") for c in fill]
    added += [F.last(c, ignorenulls=True).over(earlier).alias(f"before_{c}") for c in before]
    added += [F.first(c).over(run).alias(f"first_{c}") for c in first]
    if ordinal:
        added.append((F.row_number().over(w) - 1).cast("long").alias(ordinal))
    return df.select("*", *added)


def _cut_scan(df: DataFrame, group, order, chunk, prev, fill, before, first, ordinal) -> DataFrame:
    """``ordered_scan`` of groups of any size, each cut into chunks."""
    base = df.withColumn(_CHUNK, F.coalesce(chunk.cast("long"), F.lit(-(1 << 62))))
    base = shared_shuffle(base, [*group, *order, _CHUNK, *prev, *fill, *before, *first], *group, _CHUNK)
    w = Window.partitionBy(*group, _CHUNK).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    carried = list(dict.fromkeys([*fill, *before]))
    local = base.select(
        "*", F.row_number().over(w).alias(_RN),
        *[F.lag(c).over(w).alias(f"_lp_{c}") for c in prev],
        *[F.last(c, ignorenulls=True).over(run).alias(f"_lf_{c}") for c in fill],
        *[F.last(c, ignorenulls=True).over(earlier).alias(f"_lb_{c}") for c in before])

    # One summary row per (group, chunk), combined map-side before any shuffle.
    pos = F.struct(*order)
    last_set = {c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), pos)) for c in carried}
    summary = base.groupBy(*group, _CHUNK).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.max_by(F.struct(c), pos).alias(f"_p_{c}") for c in prev],
        *[e.alias(f"_f_{c}") for c, e in last_set.items()],
        *[F.min_by(F.struct(c), pos).alias(f"_1_{c}") for c in first])
    carry = _carry(summary, group, prev, carried, first)

    cond = [F.col(g).eqNullSafe(F.col(f"_k_{i}")) for i, g in enumerate(group)]
    out = local.join(carry, [*cond, F.col(_CHUNK) == F.col("_k_chunk")], "left")
    head = F.col(_RN) == 1
    added = [F.when(head, F.col(f"_c_p_{c}")[c]).otherwise(F.col(f"_lp_{c}")).alias(f"prev_{c}") for c in prev]
    added += [F.coalesce(f"_lf_{c}", f"_c_f_{c}").alias(f"fill_{c}") for c in fill]
    added += [F.coalesce(f"_lb_{c}", f"_c_f_{c}").alias(f"before_{c}") for c in before]
    added += [F.col(f"_c_1_{c}")[c].alias(f"first_{c}") for c in first]
    if ordinal:
        added.append((F.col("_c_n") + F.col(_RN) - 1).cast("long").alias(ordinal))
    return out.select(*df.columns, *added)


def _carry(summary: DataFrame, group, prev, carried, first) -> DataFrame:
    """What precedes each (group, chunk), from windows over a span's chunks and over spans."""
    summary = summary.withColumn(_SPAN, F.floor(F.col(_CHUNK) / SPAN))
    names = [*[f"_p_{c}" for c in prev], *[f"_f_{c}" for c in carried]]

    def scanned(rows: DataFrame, keys: list[str], step: str, tag: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
        return rows.select(
            "*", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias(f"{tag}_n"),
            *[F.last(n, ignorenulls=True).over(w).alias(f"{tag}{n}") for n in names])

    spans = summary.groupBy(*group, _SPAN).agg(
        F.sum("_n").alias("_n"),
        *[F.max_by(n, F.when(F.col(n).isNotNull(), F.col(_CHUNK))).alias(n) for n in names],
        *[F.min_by(f"_1_{c}", _CHUNK).alias(f"_1_{c}") for c in first])
    whole = Window.partitionBy(*group).orderBy(_SPAN).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    above = scanned(spans, group, _SPAN, "_s").select(
        *[F.col(g).alias(f"_g_{i}") for i, g in enumerate(group)], F.col(_SPAN).alias("_g_span"), "_s_n",
        *[f"_s{n}" for n in names], *[F.first(f"_1_{c}").over(whole).alias(f"_c_1_{c}") for c in first])
    inside = scanned(summary, [*group, _SPAN], _CHUNK, "_i")
    cond = [F.col(g).eqNullSafe(F.col(f"_g_{i}")) for i, g in enumerate(group)]
    # null-safe: a filter for nulls on one side only would keep the sides from sharing the summary
    return inside.join(above, [*cond, F.col(_SPAN).eqNullSafe(F.col("_g_span"))]).select(
        *[F.col(g).alias(f"_k_{i}") for i, g in enumerate(group)], F.col(_CHUNK).alias("_k_chunk"),
        (F.col("_s_n") + F.col("_i_n")).alias("_c_n"),
        *[F.coalesce(f"_i{n}", f"_s{n}").alias(f"_c{n}") for n in names],
        *[f"_c_1_{c}" for c in first])


def chunk_of(column: str, step: int) -> Column:
    """Chunk of a number: rows whose ``column`` falls into one stretch of length ``step``."""
    return F.floor(F.col(column) / F.lit(step)).cast("long")


def time_chunk(column: str, seconds: int) -> Column:
    """Chunk of a timestamp: rows of one stretch of ``seconds``."""
    return F.floor(F.unix_micros(F.col(column).cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")
