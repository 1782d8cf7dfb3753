"""Validation, error classes and dead-letter envelopes for decoded log records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gamelog.functions.cols import evaluate_once
from gamelog.functions.enums import event_type_name, event_type_number, sport_name, sport_number
from gamelog.sources.schemas import POISON, REPLAYED, TRANSIENT

# ---- fixed values: messages ----
DECODE_PREFIX = "decode failed: "
DECODE_DETAIL = "malformed record"
SPINE_PREFIX = "spine validation failed: "
WRITE_PREFIX = "write-path poison pill: "
UNKNOWN_ENUM = "unknown_enum"
BAD_RAW_JSON = "raw_payload_json is not valid JSON"
SPINE_RULES = (
    ("event_id", "spine.event_id is empty"),
    ("event_type", "spine.event_type is unspecified"),
    ("sport", "spine.sport is unspecified"),
    ("game_pk", "spine.game_pk is empty"),
    ("event_time", "spine.event_time is missing"),
    ("source_time", "spine.source_time is missing"),
    ("ingest_time", "spine.ingest_time is missing"),
)
# error kinds that can never succeed on retry
POISON_KINDS = ("decode", "value")
# an enum number this version does not know, which a newer one may
LOOKUP_KIND = "lookup"
# ---- end of fixed values ----


def _failed(field: str) -> Column:
    if field in ("event_id", "game_pk"):
        return F.coalesce(F.col(field), F.lit("")) == ""
    if field in ("event_type", "sport"):
        return F.col(f"{field}_number") == 0
    return F.col(field).isNull()


def spine_reason(df: DataFrame) -> Column:
    """The first failing spine rule, in field order; NULL when the spine is complete."""
    expr = None
    for field, message in SPINE_RULES:
        expr = (F.when(_failed(field), F.lit(message)) if expr is None
                else expr.when(_failed(field), F.lit(message)))
    return expr


def classify_kind(kind: Column) -> Column:
    """Error kind -> class: decode and value errors are poison, anything else transient."""
    return F.when(kind.isNull(), F.lit(None)).when(kind.isin(*POISON_KINDS), F.lit(POISON)) \
        .otherwise(F.lit(TRANSIENT))


def validate(decoded: DataFrame, unknown_enum: str = "value") -> DataFrame:
    """Add ``event_type`` / ``sport`` names, ``error_kind``, ``error_class`` and
    ``error_message`` (all NULL for a valid record). One pass, no shuffle.

    ``unknown_enum`` is the kind of an enum number without a name: ``value`` makes it poison, a
    dead letter; ``lookup`` makes it transient, to be tried again after an upgrade (``retryable``).
    """
    reason = spine_reason(decoded)
    et_name, sp_name = event_type_name(F.col("event_type_number")), sport_name(F.col("sport_number"))
    enum_bad = et_name.isNull() | sp_name.isNull()
    enum_detail = F.concat(
        F.lit(UNKNOWN_ENUM), F.lit(" event_type="), F.col("event_type_number").cast("string"),
        F.lit(" sport="), F.col("sport_number").cast("string"))
    raw_bad = F.lit(False)
    if "raw_payload_json" in decoded.columns:
        raw = F.col("raw_payload_json")
        raw_bad = F.coalesce(raw != "", F.lit(False)) & F.try_parse_json(raw).isNull()
    # which rule fails is decided once; the raw text is parsed only for records that pass the others
    rule = (F.when(~F.col("decoded"), F.lit(1)).when(reason.isNotNull(), F.lit(2)).when(enum_bad, F.lit(3))
            .when(raw_bad, F.lit(4)))
    # once per row: filters on the kind would otherwise take the rule, and the parse, apart three times over
    found = evaluate_once(decoded.withColumn("event_type", et_name).withColumn("sport", sp_name), rule, "_rule")
    failed = F.col("_rule")
    kind = (F.when(failed == 1, F.lit("decode")).when(failed == 3, F.lit(unknown_enum)).when(failed.isNotNull(), F.lit("value")))
    message = (F.when(failed == 1, F.lit(DECODE_PREFIX + DECODE_DETAIL)).when(failed == 2, F.concat(F.lit(SPINE_PREFIX), reason))
               .when(failed == 3, F.concat(F.lit(WRITE_PREFIX), enum_detail))
               .when(failed == 4, F.lit(WRITE_PREFIX + BAD_RAW_JSON)))
    return (found.withColumn("error_kind", kind)
            .withColumn("error_class", classify_kind(F.col("error_kind")))
            .withColumn("error_message", message).drop("_rule"))


def good_records(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("error_kind").isNull())


def bad_records(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("error_kind").isNotNull())


def retryable(validated: DataFrame) -> DataFrame:
    """Bad records that a later try may accept: those of a transient class."""
    return validated.filter(F.col("error_class") == TRANSIENT)


def poison(validated: DataFrame) -> DataFrame:
    """Bad records that no try can accept: the dead letters."""
    return validated.filter(F.col("error_class") == POISON)


def name_reason(df: DataFrame) -> Column:
    """Why a row cannot be encoded: an event type or sport name that has no number; else NULL."""
    return (F.when(event_type_number(F.col("event_type")).isNull(), F.concat(
        F.lit("unknown event_type "), F.coalesce("event_type", F.lit("null"))))
            .when(sport_number(F.col("sport")).isNull(), F.concat(
                F.lit("unknown sport "), F.coalesce("sport", F.lit("null")))))


def live_records(decoded: DataFrame) -> DataFrame:
    """Records that come from the game itself, and not from a replay of stored events."""
    return decoded.filter(F.col("source") != F.lit(REPLAYED))


def dead_letters(bad: DataFrame, first_seen_ts: Column, attempts: int = 1) -> DataFrame:
    """Dead-letter envelopes; the source key is kept so a letter stays with its game."""
    return bad.select(
        F.col("key"),
        # one line of base64 (the built-in may wrap lines MIME-style)
        F.translate(F.base64(F.coalesce(F.col("value"), F.lit(b"").cast("binary"))), "\r\n", "")
        .alias("original_payload_b64"),
        F.col("error_class"), F.col("error_message"),
        F.col("topic").alias("source_topic"), F.col("partition").alias("source_partition"),
        F.col("offset").alias("source_offset"),
        first_seen_ts.alias("first_seen_ts"), F.lit(attempts).alias("attempts"))


def envelope_json(letters: DataFrame) -> DataFrame:
    """Envelope as JSON text in a log record (key, value)."""
    cols = [c for c in letters.columns if c != "key"]
    return letters.select("key", F.to_json(F.struct(*cols)).cast("binary").alias("value"))


def enrichable(decoded: DataFrame) -> DataFrame:
    """Records the enricher accepts: decodable with a non-empty game; other fields unchecked."""
    return decoded.filter(F.col("decoded") & (F.coalesce(F.col("game_pk"), F.lit("")) != ""))
