"""Streams that watch the log: counts by minute with late rows apart, copies, consumer lag."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from sluiceway.config import EventRules
from sluiceway.functions.isotime import with_instant
from sluiceway.functions.jsontext import DUPLICATE_KEYS_CONF, canonical, with_document
from sluiceway.operators.validate import accepted, validate_events
from sluiceway.schemas import COUNTS, MINUTES
from sluiceway.sources.log import RecordLog
from sluiceway.sources.staging import read_or_empty, stage
from sluiceway.streaming.runs import WHAT_IS_THERE, _name

MINUTE = 60_000_000


def _timed(records: DataFrame, rules: EventRules) -> DataFrame:
    """Valid events with `ts`, their event time in microseconds."""
    valid = accepted(validate_events(records, rules))
    return with_instant(valid, "timestamp").withColumnRenamed("micros", "ts")


def events_per_minute(
    spark: SparkSession,
    log: RecordLog,
    counts_path: str,
    late_path: str,
    checkpoint: str,
    delay_minutes: int,
    rules: EventRules = EventRules(),
    commits_per_batch: int | None = None,
    trigger: dict = WHAT_IS_THERE,
) -> StreamingQuery:
    """Counts of events by minute of event time; late rows go to a table of their own.

    The watermark of a micro-batch is the latest event time of those before it, less the
    delay. A row whose minute had ended by then is late: it is kept with that watermark
    under `late_path` and counted nowhere, so a minute below the watermark never changes.
    Counts are added up per micro-batch and minute (`minute_counts` merges them), and the
    watermark is kept with them, so a micro-batch that runs again gives the same.
    """
    spark.conf.set(DUPLICATE_KEYS_CONF, "true")

    def each(batch: DataFrame, batch_id: int) -> None:
        name = _name(batch.sparkSession, batch_id)
        taken = log.commits().join(batch.select("batch_id"), "batch_id", "left_semi")
        rows = stage(_timed(log.read_batches(taken), rules).select("offset", "raw", "ts"), "timed")
        past = read_or_empty(spark, counts_path, MINUTES).where(F.col("batch") != name)
        latest = past.agg(F.max("latest")).first()[0]
        mark = None if latest is None else latest - delay_minutes * MINUTE
        minute = F.expr(f"ts - pmod(ts, {MINUTE}L)")
        late = F.lit(False) if mark is None else minute + MINUTE <= mark
        rows.where(late).select("offset", "raw", "ts", F.lit(mark).cast("bigint").alias("watermark")).write.mode(
            "overwrite"
        ).parquet(f"{late_path}/batch={name}")
        rows.where(~late).groupBy(minute.alias("minute")).agg(
            F.count("*").alias("count"), F.max("ts").alias("latest")
        ).write.mode("overwrite").parquet(f"{counts_path}/batch={name}")

    return (
        log.stream_commits(commits_per_batch)
        .writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def minute_counts(spark: SparkSession, counts_path: str) -> DataFrame:
    """(minute, count) of all micro-batches."""
    return read_or_empty(spark, counts_path, MINUTES).groupBy("minute").agg(F.sum("count").alias("count"))


def distinct_contents(
    spark: SparkSession,
    log: RecordLog,
    path: str,
    checkpoint: str,
    horizon: str,
    rules: EventRules = EventRules(),
    commits_per_batch: int | None = None,
    trigger: dict = WHAT_IS_THERE,
) -> StreamingQuery:
    """Valid events of the log, those of equal content once, whatever their white space.

    A content is known by the SHA-256 of its canonical form, and forgotten `horizon` of
    event time later, so state holds what arrives within the horizon and no more.
    """
    spark.conf.set(DUPLICATE_KEYS_CONF, "true")
    events = with_document(_timed(log.stream_records(commits_per_batch), rules)).select(
        "event_id", "user_id", "event_type", "timestamp", "value",
        F.timestamp_micros("ts").alias("event_time"),
        F.sha2(canonical(F.col("doc")), 256).alias("content"),
    )
    once = events.withWatermark("event_time", horizon).dropDuplicatesWithinWatermark(["content"])

    def each(batch: DataFrame, batch_id: int) -> None:
        name = _name(batch.sparkSession, batch_id)
        batch.drop("event_time", "content").write.mode("overwrite").parquet(f"{path}/batch={name}")

    return (
        once.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def consumer_lag(spark: SparkSession, log: RecordLog, counts: dict[str, str]) -> DataFrame:
    """(consumer, consumed, lag): offsets each loading consumer is behind the log's end.

    `counts` names each consumer's path of counters, to which every micro-batch adds the
    offset it has consumed up to.
    """
    end = log.size()
    parts = [
        read_or_empty(spark, path, COUNTS)
        .agg(F.coalesce(F.max("consumed"), F.lit(0)).alias("consumed"))
        .select(F.lit(name).alias("consumer"), "consumed", (F.lit(end) - F.col("consumed")).alias("lag"))
        for name, path in counts.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
