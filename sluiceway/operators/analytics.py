"""The report queries over the events table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Sums are exact to this many decimals; finer parts are added up as doubles.
MONEY = "decimal(18,6)"


def money_parts(value: Column) -> dict[str, Column]:
    """The sums that `money_total` puts together; they can be added up themselves."""
    exact = value.try_cast(MONEY)
    return {
        "exact": F.sum(exact), "rest": F.sum(value - F.coalesce(exact.cast("double"), F.lit(0.0)))
    }


def money_total(exact: Column, rest: Column) -> Column:
    return F.coalesce(exact.cast("double"), F.lit(0.0)) + F.coalesce(rest, F.lit(0.0))


def money_sum(value: Column) -> Column:
    """Sum of doubles that does not depend on the order rows meet in.

    The part that fits MONEY is added as decimals. What that leaves over, which is
    zero for ordinary amounts and all of an enormous one, is added as doubles.
    """
    return money_total(**money_parts(value))


def event_count(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("count"))


def count_by_event_type(events: DataFrame) -> DataFrame:
    return (
        events.groupBy("event_type")
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), F.asc("event_type"))
    )


def top_users(events: DataFrame, limit: int = 5) -> DataFrame:
    if limit < 0:
        raise ValueError("limit must not be negative")
    return (
        events.groupBy("user_id")
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), F.asc("user_id"))
        .limit(limit)
    )


def total_purchase_value(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type") == "purchase").agg(
        money_sum(F.col("value")).alias("total")
    )


def analytics_report(events: DataFrame, limit: int = 5) -> DataFrame:
    """The four answers as rows (metric, key, value, ordinal), `ordinal` within the metric.

    The events are read twice: once combined by type, from which three of the answers
    come, and once by user.
    """
    by_type = events.groupBy("event_type").agg(
        F.count("*").alias("count"), *(part.alias(n) for n, part in money_parts(F.col("value")).items())
    )
    purchases = F.col("event_type") == "purchase"
    totals = by_type.agg(
        F.coalesce(F.sum("count"), F.lit(0)).cast("double").alias("events"),
        money_total(F.sum(F.when(purchases, F.col("exact"))), F.sum(F.when(purchases, F.col("rest")))).alias("bought"),
    )

    def answer(metric: str, key: Column, value: Column, ordinal: Column) -> Column:
        return F.struct(
            F.lit(metric).alias("metric"), key.alias("key"), value.cast("double").alias("value"),
            ordinal.cast("int").alias("ordinal"),
        )

    whole, first = F.lit("all"), F.lit(1)
    # few rows: one a type, and the top users
    place = F.row_number().over(W.orderBy(F.desc("count"), F.asc(F.col("key"))))
    types = by_type.select(F.col("event_type").alias("key"), "count")
    users = top_users(events, limit).select(F.col("user_id").alias("key"), "count")
    parts = [
        totals.select(F.inline(F.array(
            answer("total_events", whole, F.col("events"), first),
            answer("total_purchase_value", whole, F.col("bought"), first),
        ))),
        *(
            df.withColumn("_place", place).select(F.inline(F.array(
                answer(metric, F.col("key"), F.col("count"), F.col("_place")))))
            for metric, df in (("events_by_type", types), ("top_users", users))
        ),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
