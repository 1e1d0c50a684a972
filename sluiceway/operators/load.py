"""Log -> events table: validate again, keep the first record of each id, count."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from sluiceway.config import EventRules
from sluiceway.operators.validate import is_valid, validate_events
from sluiceway.schemas import EVENTS
from sluiceway.sources.staging import stage
from sluiceway.sources.tables import KeyedTable


class Loaded(NamedTuple):
    written: int
    skipped: int
    duplicates: int


def load_records(
    records: DataFrame,
    table: KeyedTable,
    rules: EventRules = EventRules(),
    batch: str | None = None,
) -> Loaded:
    """Load a frame (offset, raw). Every record is written, skipped or a duplicate.

    The typed columns are staged, so the JSON is parsed once and the counts are of
    stored rows, which task retries cannot inflate.
    """
    typed = stage(
        validate_events(records.select("offset", "raw"), rules).select(
            "offset", is_valid().alias("ok"), *EVENTS.names
        ),
        "load",
    )
    good, bad = typed.agg(F.count_if("ok"), F.count_if(~F.col("ok"))).first()
    written = table.insert(typed.where("ok"), batch=batch)
    return Loaded(written, bad, good - written)
