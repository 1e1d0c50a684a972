"""What operations ask of the events: quantiles over any span, and keys that are too hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Size of a quantile sketch; its rank error is below RANK_ERROR in 99 of 100 cases.
SKETCH_SIZE = 800
RANK_ERROR = 0.01


def quantile_sketches(rows: DataFrame, value: Column, *keys: str) -> DataFrame:
    """(keys, n, sketch): one mergeable sketch for each key, a few kilobytes however many rows.

    Stored per batch or day, they answer for any span of them without the rows. Null
    values are left out.
    """
    kept = rows.withColumn("_value", value).where("_value IS NOT NULL")
    return kept.groupBy(*keys).agg(
        F.count("*").alias("n"), F.kll_sketch_agg_double("_value", SKETCH_SIZE).alias("sketch")
    )


def quantiles(sketches: DataFrame, shares: Sequence[float], *keys: str) -> DataFrame:
    """(keys, n, share, value): the stored sketches of each key merged, and their quantiles."""
    merged = sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", SKETCH_SIZE).alias("sketch")
    )
    answers = (
        F.struct(
            F.lit(float(s)).alias("share"),
            F.kll_sketch_get_quantile_double("sketch", F.lit(float(s))).alias("value"),
        )
        for s in shares
    )
    return merged.select(*keys, "n", F.inline(F.array(*answers)))


def hot_keys(rows: DataFrame, key: str, share: float) -> DataFrame:
    """(key, count, total): every key with at least `share` of the rows, and its exact count.

    One pass of mergeable counters finds who may be one, a second counts those alone, so
    the keys themselves are never shuffled. With T counters a count is off by less than
    3.5 / T of the rows; T is 32 / share, so no key above the share is missed, and the
    broadcast candidates are at most 2 / share.
    """
    if not 1e-4 <= share <= 1.0:
        raise ValueError("share must lie between 0.0001 and 1")
    most, counters = int(2 / share), int(32 / share)
    text = F.col(key).cast("string")
    found = rows.where(F.col(key).isNotNull()).agg(
        F.expr(f"approx_top_k(cast(`{key}` as string), {most}, {counters})").alias("top")
    )
    names = found.select(F.explode("top.item").alias("key"))
    total = rows.agg(F.count("*").alias("total"))  # one row
    counted = (
        rows.select(text.alias("key"))
        .join(F.broadcast(names), "key", "left_semi")
        .groupBy("key")
        .agg(F.count("*").alias("count"))
    )
    return counted.join(F.broadcast(total)).where(F.col("count") >= F.lit(share) * F.col("total"))
