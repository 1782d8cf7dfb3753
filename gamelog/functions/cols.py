"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(x) -> Column:
    """Column names become columns; other Python values become literals."""
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def blank_to_null(c) -> Column:
    """Python truthiness for text: '' behaves like an absent value."""
    c = as_col(c)
    return F.when(c == "", F.lit(None).cast("string")).otherwise(c)


def zero_to_null(c) -> Column:
    """Python truthiness for numbers: 0 behaves like an absent value."""
    c = as_col(c)
    return F.when(c == 0, F.lit(None)).otherwise(c)


def seconds_between(later, earlier) -> Column:
    """Exact difference of two timestamps in seconds, as a double."""
    return (F.unix_micros(as_col(later).cast("timestamp"))
            - F.unix_micros(as_col(earlier).cast("timestamp"))) / F.lit(1_000_000.0)


def evaluate_once(df, expr: Column, name: str):
    """Add ``expr`` as column ``name``, evaluated exactly once per row.

    Filters on columns derived from an expensive expression (a JSON parse) are otherwise
    pushed below the projection with the expression inlined into the predicate, so it would
    run once per reference. A one-element ``explode`` is a generator node the optimizer does
    not inline through, so the parse happens once and downstream filters stay above it.
    """
    return df.select("*", F.explode(F.array(expr)).alias(name))


def shared_shuffle(df, needed, *by):
    """``df`` shuffled by the columns ``by`` where ``needed`` are all its columns, else ``df`` as it is.

    Readers that take the same columns from one shuffle share it, so that what comes before (a log's decoding)
    runs once. A wider frame is left alone: readers of a few of its columns read, and combine, less by themselves.
    """
    return df.repartition(*by) if set(df.columns) == set(needed) else df
