"""Event <-> flat JSON payload, as column expressions (``to_json`` / variant, JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gamelog.functions.cols import evaluate_once
from gamelog.functions.times import iso_utc, parse_upstream_time
from gamelog.sources.schemas import CONTEXT_FIELDS, PITCH_FIELDS, SPINE_FIELDS

_TIMES = ("event_time", "source_time", "ingest_time")
# Plain scalars are always present in a payload; every other pitch field is optional.
ALWAYS_PRESENT = ("at_bat_index", "pitch_number")


def _spine_items(prefix: str = "") -> list[Column]:
    out = []
    for c in SPINE_FIELDS:
        col = F.col(prefix + c)
        out.append((iso_utc(col) if c in _TIMES else col).alias(c))
    return out


def raw_payload_value(raw_text: Column) -> Column:
    """Raw JSON text embedded as an object; '' becomes JSON null; absent stays absent."""
    return (F.when(raw_text == "", F.parse_json(F.lit("null")))
            .otherwise(F.try_parse_json(raw_text)))


def _pitch_items(prefix: str = "", keep_raw_text: bool = False,
                 available: set | None = None) -> list[Column]:
    """Pitch fields; a column missing from ``available`` is an unset optional (NULL)."""
    items = []
    for name, dtype in PITCH_FIELDS:
        present = available is None or name in available
        col = F.col(prefix + name) if present else F.lit(None).cast(dtype)
        if name == "raw_payload_json":
            items.append(col.alias(name) if keep_raw_text
                         else raw_payload_value(col).alias("raw_payload"))
        elif name in ALWAYS_PRESENT:
            items.append(F.coalesce(col, F.lit(0)).alias(name))
        else:
            items.append(col.alias(name))
    return items


def pitch_payload(pitches: DataFrame) -> Column:
    """Flat payload of a pitch: spine at the top level, enum short names, ISO-8601 UTC
    times, absent optionals omitted (``to_json`` drops NULLs), raw JSON as ``raw_payload``."""
    return F.to_json(F.struct(*_spine_items(), *_pitch_items(available=set(pitches.columns))))


def enriched_payload(enriched: DataFrame) -> Column:
    """Payload of an enriched event: spine flattened, ``pitch`` kept nested with its own
    spine and ``raw_payload_json`` as text, then the context fields."""
    nested_spine = F.struct(*_spine_items("pitch."))
    pitch = F.struct(nested_spine.alias("spine"), *_pitch_items("pitch.", keep_raw_text=True))
    return F.to_json(F.struct(*_spine_items("spine."), pitch.alias("pitch"),
                              *[F.col(c) for c in CONTEXT_FIELDS if c in enriched.columns]))


# A stored payload as it is read: every field at its type, times as text, raw JSON as it is.
_PAYLOAD = T.StructType([T.StructField(c, T.StringType()) for c in SPINE_FIELDS]
                        + [T.StructField(n, t) for n, t in PITCH_FIELDS if n != "raw_payload_json"]
                        + [T.StructField("raw_payload", T.VariantType())])


def payload_to_pitch(payloads: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Inverse of ``pitch_payload``: NULLs and unknown keys skipped, times parsed,
    ``raw_payload`` re-serialized into ``raw_payload_json``. One parse, by schema."""
    payloads = evaluate_once(payloads, F.from_json(F.col(payload_col), _PAYLOAD), "_pv")
    cols = [(parse_upstream_time(F.col(f"_pv.{c}")) if c in _TIMES else F.col(f"_pv.{c}")).alias(c) for c in SPINE_FIELDS]
    raw = F.col("_pv.raw_payload")
    for name, _ in PITCH_FIELDS:
        cols.append((F.when(~F.is_variant_null(raw), F.to_json(raw)) if name == "raw_payload_json"
                     else F.col(f"_pv.{name}")).alias(name))
    return payloads.select(*[c for c in payloads.columns if c not in SPINE_FIELDS
                             and c not in [n for n, _ in PITCH_FIELDS]
                             and c not in (payload_col, "_pv")], *cols)


def events_row(pitches: DataFrame) -> DataFrame:
    """Row layout of the events table: spine columns + payload text."""
    return pitches.select(*[F.col(c) for c in SPINE_FIELDS], pitch_payload(pitches).alias("payload"))
