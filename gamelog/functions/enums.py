"""Enum numbers <-> lowercase short names, as map lookups that stay JVM-side."""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

from gamelog.functions.cols import as_col
from gamelog.sources.schemas import EVENT_TYPES, SPORTS


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in itertools.chain.from_iterable(pairs.items())])


def sport_name(number) -> Column:
    """Sport number to short name; an unknown number gives NULL (quarantined later)."""
    return _map(SPORTS)[as_col(number)]


def event_type_name(number) -> Column:
    return _map(EVENT_TYPES)[as_col(number)]


def sport_number(name) -> Column:
    """Inverse lookup; an unknown name gives NULL, which callers treat as an error."""
    return _map({v: k for k, v in SPORTS.items()})[as_col(name)]


def event_type_number(name) -> Column:
    return _map({v: k for k, v in EVENT_TYPES.items()})[as_col(name)]


def short_name(full_name, enum_type_name: str) -> Column:
    """Generic rule: drop the UPPER_SNAKE form of the enum type name as prefix, lowercase.

    ``SPORT_MLB`` with type ``Sport`` -> ``mlb``; ``EVENT_TYPE_PITCH`` with ``EventType`` ->
    ``pitch``.
    """
    prefix = "".join("_" + ch if ch.isupper() and i else ch
                     for i, ch in enumerate(enum_type_name)).upper() + "_"
    c = as_col(full_name)
    stripped = F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 1 << 30)).otherwise(c)
    return F.lower(stripped)
