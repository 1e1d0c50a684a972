"""Records of several schema versions read as one table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from sluiceway.functions.jsontext import with_document

Step = Callable[[dict[str, Column]], dict[str, Column]]


def _to_2(fields: dict[str, Column]) -> dict[str, Column]:
    """Version 2 calls the amount `amount`; older senders say `value`."""
    return {**fields, "amount": F.coalesce(fields["amount"], fields["value"])}


def _to_3(fields: dict[str, Column]) -> dict[str, Column]:
    """Version 3 names the channel; older records came from the web."""
    return {**fields, "channel": F.coalesce(fields["channel"], F.lit("web"))}


#: What lifts a record to each version from the one before.
STEPS: dict[int, Step] = {2: _to_2, 3: _to_3}
FIELDS = {"event_id": "string", "user_id": "string", "event_type": "string", "timestamp": "string",
          "value": "double", "amount": "double", "channel": "string"}


def upcast(records: DataFrame, steps: dict[int, Step] = STEPS) -> DataFrame:
    """(offset, version, event_id, user_id, event_type, timestamp, amount, channel).

    `raw` is read once as a variant; a record goes through the steps above its
    `schema_version` (1 where it has none), in order. A record from a version that is
    not known yet, or one that is no JSON object, has a null version and is for the
    caller to put aside.
    """
    read = with_document(records).select(
        "offset",
        F.coalesce(F.try_variant_get("doc", "$.schema_version", "int"), F.lit(1)).alias("_found"),
        F.col("doc").isNotNull().alias("_json"),
        *(F.try_variant_get("doc", f"$.{n}", kind).alias(n) for n, kind in FIELDS.items()),
    )
    fields = {n: F.col(n) for n in FIELDS}
    for version in sorted(steps):
        lifted = steps[version](fields)
        fields = {
            n: c if c is fields[n] else F.when(F.col("_json") & (F.col("_found") < version), c).otherwise(fields[n])
            for n, c in lifted.items()
        }
    known = F.col("_json") & F.col("_found").between(1, max(steps))
    return read.select(
        "offset", F.when(known, F.col("_found")).alias("version"),
        *(fields[n].alias(n) for n in FIELDS if n != "value"),
    )
