"""The `events` test table read as raw event records and as transfers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

def events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/events.parquet")


def iso_text(ts: Column) -> Column:
    """ISO-8601 with microseconds. The table's times are naive and taken as UTC,
    whatever the session's time zone."""
    text = ts.cast("string")
    return F.concat(
        F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8), F.lit("."),
        F.rpad(F.substring(text, 21, 6), 6, "0"), F.lit("Z"),
    )


def _records(df: DataFrame, **fields: Column) -> DataFrame:
    """(offset, raw): one JSON object per row, null fields left out.

    A table that comes in fewer pieces than there are cores is dealt out first, since
    all the work on the JSON follows its pieces.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores, "event_id")
    return df.select(
        F.col("event_id").alias("offset"),
        F.to_json(F.struct(*(c.alias(n) for n, c in fields.items()))).alias("raw"),
    )


def event_records(df: DataFrame, **changed: Column) -> DataFrame:
    fields = {
        "event_id": F.col("event_id").cast("string"),
        "user_id": F.col("user_id").cast("string"),
        "event_type": F.col("event_type"),
        "timestamp": iso_text(F.col("ts")),
        "value": F.col("value"),
    }
    return _records(df, **{**fields, **changed})


def transfer_records(df: DataFrame, **changed: Column) -> DataFrame:
    """Each event as a transfer of `value` from its user to the payee in `props`."""
    fields = {
        "txn_id": F.col("event_id").cast("string"),
        "account_id": F.col("user_id").cast("string"),
        "payee_id": _payee(),
        "amount": F.col("value"),
        "currency": F.lit("SGD"),
        "timestamp": iso_text(F.col("ts")),
        "channel": F.lit("app"),
    }
    return _records(df, **{**fields, **changed})


def _payee() -> Column:
    return F.regexp_extract("props", "([0-9]+)", 1)


def transfers(df: DataFrame, offset: Column | None = None) -> DataFrame:
    """The valid ones of the same transfers as typed columns, without the way through JSON."""
    ts = F.col("ts")
    return df.where(F.col("value") > 0).select(
        (F.col("event_id") if offset is None else offset).alias("offset"),
        F.col("event_id").cast("string").alias("txn_id"),
        F.col("user_id").cast("string").alias("account_id"),
        _payee().alias("payee_id"),
        F.col("value").alias("amount"),
        iso_text(ts).alias("timestamp"),
        F.unix_micros(F.concat(ts.cast("string"), F.lit("Z")).cast("timestamp")).alias("ts"),
        F.hour(ts).alias("hour"),
        F.minute(ts).alias("minute"),
    )
