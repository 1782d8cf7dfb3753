"""Upstream time parsing and ISO-8601 output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gamelog.functions.cols import as_col, blank_to_null

# ---- fixed values: text forms ----
COMPACT_UPSTREAM_FORMAT = "yyyyMMdd_HHmmss"
ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss"
ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
UTC_SUFFIX = "+00:00"
# ---- end of fixed values ----


def parse_upstream_time(text) -> Column:
    """Upstream timestamp text to a UTC timestamp.

    Empty or absent -> NULL; a trailing ``Z`` means UTC; text without an offset is read as
    UTC (the session zone); the compact ``yyyyMMdd_HHmmss`` form is accepted as well.
    """
    t = blank_to_null(as_col(text))
    return F.coalesce(F.try_to_timestamp(t), F.try_to_timestamp(t, F.lit(COMPACT_UPSTREAM_FORMAT)))


def iso_utc(ts) -> Column:
    """ISO-8601 text with ``+00:00``; no fraction when the microseconds are 0, else 6 digits."""
    ts = as_col(ts)
    whole = F.date_format(ts, "SSSSSS") == "000000"
    body = F.when(whole, F.date_format(ts, ISO_SECONDS)).otherwise(F.date_format(ts, ISO_MICROS))
    return F.concat(body, F.lit(UTC_SUFFIX))


def iso_utc_plain(ts) -> Column:
    """ISO text of a timestamp that carried no offset upstream (no ``+00:00``)."""
    ts = as_col(ts)
    whole = F.date_format(ts, "SSSSSS") == "000000"
    return F.when(whole, F.date_format(ts, ISO_SECONDS)).otherwise(F.date_format(ts, ISO_MICROS))


def to_ntz(ts) -> Column:
    """UTC wall-clock time without zone (matches zone-less parquet and SQL engines)."""
    return as_col(ts).cast("timestamp_ntz")
