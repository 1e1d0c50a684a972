"""Edge validation: every record gets the complete, ordered list of its faults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sluiceway.config import EVENT_REQUIRED, TRANSFER_REQUIRED, EventRules, TransferRules
from sluiceway.functions import jsontext as J
from sluiceway.functions.isotime import with_instant

INVALID_JSON = "invalid JSON"
VALIDATION_FAILED = "validation failed"


def _fault(bad: Column, message: str | Column) -> Column:
    """One message, or none."""
    said = F.lit(message) if isinstance(message, str) else message
    return F.when(bad, F.array(said)).otherwise(F.array().cast("array<string>"))


def _missing(name: str) -> Column:
    f = J.field(name)
    return _fault(
        ~J.is_present(f) | (J.is_string(f) & (f.text == "")), f"missing required field: {name}"
    )


def _not_member(name: str, allowed: tuple[str, ...], message: Column) -> Column:
    f = J.field(name)
    member = J.is_string(f) & f.text.isin(*allowed)
    return _fault(J.is_present(f) & ~member, message)


def _bad_time() -> Column:
    f = J.field("timestamp")
    return _fault(
        J.is_present(f) & F.col("micros").isNull(),
        F.concat(F.lit("timestamp is not ISO-8601: "), J.shown(f, "timestamp")),
    )


def _bad_number(name: str, too_low: Column, rule: str) -> Column:
    f = J.field(name)
    message = F.when(~J.is_number(f), F.lit(f"{name} must be a number")).otherwise(
        F.lit(f"{name} must be {rule}")
    )
    return _fault(J.is_present(f) & (~J.is_number(f) | too_low), message)


def _nested_key(name: str) -> Column:
    return _fault(J.is_nested(J.field(name)), f"{name} must not be an array or object")


def _with_fields(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Add type and text per field, and the parsed `timestamp`."""
    parsed = J.with_fields(J.with_document(df), names)
    stamp = J.field("timestamp")
    return with_instant(
        parsed.withColumn("_stamp", F.when(J.is_string(stamp), stamp.text)), "_stamp"
    )


def _errors(not_object: str, faults: list[Column]) -> Column:
    return (
        F.when(F.col("doc").isNull(), F.array(F.lit(INVALID_JSON)))
        .when(~J.is_object_text(F.col("raw")), F.array(F.lit(not_object)))
        .otherwise(F.concat(*faults))
    )


def _result(fields: DataFrame, kept: list[str], *columns: Column) -> DataFrame:
    """The computed columns, fixed per row.

    A generator of one row keeps a later filter on `errors` above this point. Pushed
    further down, the filter would repeat the whole parse once per mention of a field.
    """
    computed = fields.select(*kept, *columns)
    names = [c for c in computed.columns if c not in kept]
    return computed.select(*kept, F.inline(F.array(F.struct(*names))))


def _double(name: str) -> Column:
    f = J.field(name)
    return F.when(J.is_number(f), f.value.try_cast("double"))


def _quoted_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in sorted(values)) + "]"


def validate_events(df: DataFrame, rules: EventRules = EventRules()) -> DataFrame:
    """Add `errors` and the typed event columns to a frame with a `raw` JSON column."""
    kept = df.columns
    fields = _with_fields(df, (*EVENT_REQUIRED, "value")).withColumn("value", _double("value"))
    faults = [
        *(_missing(n) for n in EVENT_REQUIRED),
        _not_member(
            "event_type",
            rules.allowed_types,
            F.concat(
                F.lit("invalid event_type "),
                J.shown(J.field("event_type"), "event_type"),
                F.lit(f"; allowed: {_quoted_list(rules.allowed_types)}"),
            ),
        ),
        _bad_time(),
        _bad_number("value", F.col("value") < 0, ">= 0"),
        _nested_key("event_id"),
        _nested_key("user_id"),
    ]
    return _result(
        fields,
        kept,
        _errors("event must be a JSON object", faults).alias("errors"),
        J.key_text("event_id").alias("event_id"),
        J.key_text("user_id").alias("user_id"),
        J.field("event_type").text.alias("event_type"),
        J.field("timestamp").text.alias("timestamp"),
        F.col("value"),
    )


def validate_transfers(df: DataFrame, rules: TransferRules = TransferRules()) -> DataFrame:
    """Add `errors` and the typed transfer columns to a frame with a `raw` JSON column."""
    kept = df.columns
    fields = _with_fields(df, TRANSFER_REQUIRED).withColumn("amount", _double("amount"))
    faults = [
        *(_missing(n) for n in TRANSFER_REQUIRED),
        _bad_number("amount", F.col("amount") <= 0, "> 0"),
        _not_member(
            "currency",
            rules.currencies,
            F.concat(F.lit("unsupported currency "), J.shown(J.field("currency"), "currency")),
        ),
        _bad_time(),
        *(_nested_key(n) for n in ("txn_id", "account_id", "payee_id")),
    ]
    return _result(
        fields,
        kept,
        _errors("transaction must be a JSON object", faults).alias("errors"),
        *(J.key_text(n).alias(n) for n in ("txn_id", "account_id", "payee_id")),
        "amount",
        J.field("currency").text.alias("currency"),
        J.field("timestamp").text.alias("timestamp"),
        F.col("micros").alias("ts"),
        F.col("hour"),
        F.col("minute"),
    )


def is_valid(errors: str = "errors") -> Column:
    return F.size(errors) == 0


def accepted(validated: DataFrame) -> DataFrame:
    return validated.where(is_valid())


def rejected(validated: DataFrame) -> DataFrame:
    """Rejects as the sender sees them: what was wrong, and every detail of it."""
    unreadable = F.col("errors")[0] == INVALID_JSON
    return validated.where(~is_valid()).select(
        "raw",
        F.when(unreadable, F.lit(INVALID_JSON)).otherwise(F.lit(VALIDATION_FAILED)).alias("error"),
        F.when(~unreadable, F.col("errors")).alias("details"),
    )


def intake_counts(validated: DataFrame) -> DataFrame:
    """One row: accepted, rejected."""
    return validated.agg(
        F.count_if(is_valid()).alias("accepted"), F.count_if(~is_valid()).alias("rejected")
    )
