"""Score transfers, raise alerts, hold what follows them."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from sluiceway import schemas
from sluiceway.config import HOLD_REASON, DetectorParams, SkewParams, TransferRules
from sluiceway.operators.history import features, meet_large, split_by_size
from sluiceway.operators.rules import RULES, Rule, fired_rules, score
from sluiceway.operators.validate import is_valid, validate_transfers
from sluiceway.sources.staging import stage
from sluiceway.sources.tables import KeyedTable, first_per_key

TRANSFER_COLUMNS = (
    "offset", "txn_id", "account_id", "payee_id", "amount", "timestamp", "ts", "hour", "minute",
)


class Summary(NamedTuple):
    processed: int
    skipped: int
    alerts: int
    holds: int
    alerts_recorded: int
    holds_recorded: int


def typed_transfers(records: DataFrame, rules: TransferRules = TransferRules()) -> DataFrame:
    """(offset, raw) -> typed columns and `ok`, staged so that the JSON is parsed once."""
    checked = validate_transfers(records.select("offset", "raw"), rules)
    return stage(checked.select(*TRANSFER_COLUMNS, is_valid().alias("ok")), "transfers")


def score_transfers(
    transfers: DataFrame,
    params: DetectorParams = DetectorParams(),
    skew: SkewParams = SkewParams(),
    scoring: Sequence[Rule] = RULES,
) -> DataFrame:
    """Valid transfers with the list of rules each fired."""
    return score(features(transfers, params, skew), params, scoring)


def alerts_of(scored: DataFrame) -> DataFrame:
    """Every firing, in the shape of the alert table, with its offset."""
    return fired_rules(scored).select("offset", *schemas.ALERTS.names)


def holds_of(
    scored: DataFrame,
    skew: SkewParams = SkewParams(),
    flagged_before: DataFrame | None = None,
) -> DataFrame:
    """Transfers of an account that had fired a rule on an earlier transfer.

    The first firing per account is an aggregate, combined before the shuffle. The
    transfers after it meet it by account; those of accounts too large for one task
    stay where they are and get it by broadcast, one row for each such account.
    `flagged_before` names accounts that fired before any transfer of this frame.
    """
    flagged = (
        scored.where(F.size("fired") > 0)
        .groupBy("account_id")
        .agg(F.min("offset").alias("_flagged_at"))
    )
    held = F.col("offset") > F.col("_flagged_at")
    if flagged_before is not None:
        here = scored.select("account_id").distinct()
        earlier = flagged_before.select("account_id", F.lit(True).alias("_before"))
        flagged = flagged.join(
            earlier.join(here, "account_id", "left_semi"), "account_id", "full"
        )
        held = held | F.col("_before")
    small, large, names = split_by_size(
        scored.select("offset", "txn_id", "account_id", "timestamp"), skew
    )
    joined = small.join(flagged, "account_id")
    if large is not None:
        # one row for each such account, or the rows stay apart by their salts
        known = flagged.join(names, "account_id", "left_semi")
        joined = joined.unionByName(meet_large(large, known, skew))
    return joined.where(held).select(
        "offset", "txn_id", "account_id", "timestamp", F.lit(HOLD_REASON).alias("reason")
    )


def recorded_alerts(scored: DataFrame) -> DataFrame:
    return first_per_key(alerts_of(scored), schemas.ALERT_KEY).drop("offset")


def recorded_holds(scored: DataFrame, skew: SkewParams = SkewParams()) -> DataFrame:
    return first_per_key(holds_of(scored, skew), schemas.HOLD_KEY).drop("offset")


def detect(
    records: DataFrame,
    alerts: KeyedTable,
    holds: KeyedTable,
    params: DetectorParams = DetectorParams(),
    rules: TransferRules = TransferRules(),
    skew: SkewParams = SkewParams(),
    scoring: Sequence[Rule] = RULES,
) -> Summary:
    """Run the detector over log records (offset, raw) and record what it finds.

    `alerts` and `holds` of the summary count firings, the recorded ones what is new
    in the tables; they differ where a transfer id repeats or a run is repeated.
    """
    typed = typed_transfers(records, rules)
    processed, skipped = typed.agg(F.count_if("ok"), F.count_if(~F.col("ok"))).first()
    scored = stage(
        score_transfers(typed.where("ok").drop("ok"), params, skew, scoring).select(
            "offset", "txn_id", "account_id", "timestamp", "fired"
        ),
        "scored",
    )
    raised, held = alerts_of(scored), stage(holds_of(scored, skew), "holds")
    return Summary(
        processed,
        skipped,
        raised.count(),
        held.count(),
        alerts.insert(raised),
        holds.insert(held),
    )
