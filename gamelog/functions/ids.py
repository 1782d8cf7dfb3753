"""Deterministic event ids as column expressions.

Every id is ``namespace:game:kind:ordinals``; the game key comes second so an id doubles as
its partition key. Inputs must be non-null (validate first): ``concat_ws`` skips nulls.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gamelog.functions.cols import as_col


# ---- fixed values: first part and kind of each id text, and how many parts follow the game ----
RULES = {
    "pitch": ("mlb", "pitch", 2),
    "atbat_start": ("mlb", "ab_start", 1),
    "atbat_end": ("mlb", "ab_end", 1),
    "pickoff": ("mlb", "pickoff", 2),
    "mound_visit": ("mlb", "mound_visit", 2),
    "pitching_change": ("mlb", "pitching_change", 2),
    "substitution": ("mlb", "substitution", 3),
    "defensive_shift": ("mlb", "defensive_shift", 2),
    "inning_state": ("mlb", "inning", 3),
    "nfl_play": ("nfl", "play", 1),
    "game_state": ("mlb", "game", 2),
}
# ---- end of fixed values ----


def event_id(rule: str, game, *parts) -> Column:
    """Id of an event by a rule of ``RULES``; ``parts`` are its ordinals, names or hash."""
    space, kind, count = RULES[rule]
    if len(parts) != count:
        raise ValueError(f"an id of rule {rule!r} has {count} parts after the game, not {len(parts)}")
    texts = [F.lit(space), as_col(game), F.lit(kind), *map(as_col, parts)]
    return F.concat_ws(":", *[t.cast("string") for t in texts])


def struct_payload_hash(**fields) -> Column:
    """First 16 hex chars of SHA-256 over the compact, key-sorted JSON of typed fields.

    Runs JVM-side. Equal to the Python ``json.dumps(sort_keys=True, separators=(",", ":"))``
    form for integers, booleans, nulls and ASCII strings.
    """
    ordered = [as_col(fields[name]).alias(name) for name in sorted(fields)]
    text = F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})
    return F.substring(F.sha2(text, 256), 1, 16)


def _hash_json_text(text: str | None) -> str | None:
    if text is None:
        return None
    canonical = json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(canonical.encode()).hexdigest()[:16]


@F.pandas_udf(T.StringType())
def json_payload_hash(texts: pd.Series) -> pd.Series:
    """Payload hash of free-form JSON text, with Python's number and escape forms.

    Arrow-batched helper; the typed form ``struct_payload_hash`` stays JVM-side.
    """
    return texts.map(_hash_json_text)
