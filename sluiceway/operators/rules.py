"""The surveillance rules: column expressions over the feature frame.

A rule is a name with a function of the parameters that returns (fired, reason).
The feature columns a rule may use, per transfer, looking at the account's earlier
arrivals only:

    amount, payee_id, hour, minute   of the transfer itself
    win_count, win_total             transfers and amount in the trailing window,
                                     the transfer included
    hist_count, hist_mean            all earlier transfers
    payee_first                      the payee was never paid before
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from sluiceway.config import DetectorParams


class Rule(NamedTuple):
    name: str
    judge: Callable[[DetectorParams], tuple[Column, Column]]


def _money(value: Column) -> Column:
    """Two decimals, rounded from the exact binary value, ties to even.

    `value * 100` is split into two exact products, so a result that only looks like
    half a cent after rounding can be told from one that is.
    """
    high = value.cast("float").cast("double")
    near = value * 100.0
    error = (high * 100.0 - near) + (value - high) * 100.0
    tie = near - F.floor(near) == 0.5
    cents = (
        F.when(tie & (error > 0), F.ceil(near).cast("double"))
        .when(tie & (error < 0), F.floor(near).cast("double"))
        .otherwise(F.rint(near))
    )
    return F.format_string("%.2f", F.when(F.abs(value) < 1e13, cents / 100.0).otherwise(value))


def rapid_drain(p: DetectorParams) -> tuple[Column, Column]:
    many = F.col("win_count") >= p.max_count
    large = F.col("win_total") > p.max_amount
    reason = F.when(
        many,
        F.concat(F.col("win_count").cast("string"), F.lit(f" transfers in {p.window_minutes} min")),
    ).otherwise(F.concat(_money(F.col("win_total")), F.lit(f" moved in {p.window_minutes} min")))
    return many | large, reason


def new_payee_high_value(p: DetectorParams) -> tuple[Column, Column]:
    fired = F.col("payee_first") & (F.col("amount") >= p.payee_threshold)
    return fired, F.concat(
        _money(F.col("amount")), F.lit(" to never-seen payee "), F.col("payee_id")
    )


def amount_spike(p: DetectorParams) -> tuple[Column, Column]:
    enough = (F.col("hist_count") >= p.min_history) & (F.col("hist_count") > 0)
    mean = F.col("hist_mean")
    fired = enough & (mean > 0) & (F.col("amount") > F.lit(p.spike_factor) * mean)
    return fired, F.concat(_money(F.col("amount")), F.lit(" vs typical "), _money(mean))


def odd_hour(p: DetectorParams) -> tuple[Column, Column]:
    fired = (F.col("hour") >= p.start_hour) & (F.col("hour") < p.end_hour)
    return fired, F.concat(
        F.lit("transfer at "), F.format_string("%02d:%02d", F.col("hour"), F.col("minute"))
    )


RULES = (
    Rule("rapid_drain", rapid_drain),
    Rule("new_payee_high_value", new_payee_high_value),
    Rule("amount_spike", amount_spike),
    Rule("odd_hour", odd_hour),
)

ALL_FEATURES = frozenset({"window", "history", "payee"})


def score(
    features: DataFrame,
    params: DetectorParams = DetectorParams(),
    rules: Sequence[Rule] = RULES,
) -> DataFrame:
    """Add `fired`: ARRAY<STRUCT<rule, reason>> in rule order, empty when nothing fired."""
    nothing = "array<struct<rule:string,reason:string>>"
    fired = []
    for rule in rules:
        hit, reason = rule.judge(params)
        one = F.array(F.struct(F.lit(rule.name).alias("rule"), reason.alias("reason")))
        fired.append(F.when(hit, one).otherwise(F.array().cast(nothing)))
    return features.withColumn("fired", F.concat(*fired).cast(nothing))


def fired_rules(scored: DataFrame) -> DataFrame:
    """One row per transfer and fired rule."""
    return scored.select(
        "offset", "txn_id", "account_id", "timestamp", F.posexplode("fired").alias("rule_order", "f")
    ).select(
        "offset", "txn_id", "account_id", "timestamp", "rule_order", "f.rule", "f.reason"
    )
