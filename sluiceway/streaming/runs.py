"""Streaming twins of the batch runs.

Each query owns a checkpoint. The batches it writes are named after the query id the
checkpoint holds and the micro-batch number, so a micro-batch that runs again after a
failure replaces what it left. A new checkpoint, at whatever path, replays from the
start, as another consumer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from sluiceway import schemas
from sluiceway.config import DetectorParams, EventRules, SkewParams, TransferRules
from sluiceway.functions.jsontext import DUPLICATE_KEYS_CONF
from sluiceway.operators.detect import TRANSFER_COLUMNS, alerts_of, holds_of
from sluiceway.operators.history import features_after
from sluiceway.operators.load import load_records
from sluiceway.operators.rules import RULES, Rule, score
from sluiceway.operators.validate import (
    accepted,
    rejected,
    validate_events,
    validate_transfers,
)
from sluiceway.sources.lines import stream_lines
from sluiceway.sources.log import RecordLog
from sluiceway.sources.staging import stage
from sluiceway.sources.tables import KeyedTable
from sluiceway.streaming import state as K

# Take what has landed and stop; {"processingTime": "5 seconds"} keeps a query running.
WHAT_IS_THERE = {"availableNow": True}
# Set by Spark on the thread that runs a micro-batch.
QUERY_ID = "sql.streaming.queryId"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _name(spark: SparkSession, batch_id: int) -> str:
    query_id = spark.sparkContext.getLocalProperty(QUERY_ID)
    if not query_id:
        raise RuntimeError("a micro-batch has to run on the thread of its query")
    return f"{query_id}-{batch_id}"


def _write_counts(spark: SparkSession, path: str, name: str, counts: dict[str, int]) -> None:
    """One row of counters per micro-batch."""
    row = spark.range(1).select(*(F.lit(v).cast("bigint").alias(n) for n, v in counts.items()))
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={name}")


def ingest(
    spark: SparkSession,
    landing: str,
    log: RecordLog,
    rejects_path: str,
    counts_path: str,
    checkpoint: str,
    rules: EventRules = EventRules(),
    files_per_batch: int | None = None,
    trigger: dict = WHAT_IS_THERE,
) -> StreamingQuery:
    """Landed lines -> accepted records in the log, rejects with their faults.

    The accepted side answers with offsets, the rejected side with `invalid JSON` or
    `validation failed` and the details.
    """
    spark.conf.set(DUPLICATE_KEYS_CONF, "true")

    def each(batch: DataFrame, batch_id: int) -> None:
        name = _name(batch.sparkSession, batch_id)
        checked = validate_events(batch, rules).persist()
        try:
            appended = log.append(accepted(checked), source=name)
            target = f"{rejects_path}/batch={name}"
            rejected(checked).write.mode("overwrite").parquet(target)
            refused = spark.read.schema(schemas.REJECTS).parquet(target).count()
            _write_counts(
                spark, counts_path, name, {"accepted": appended.rows, "rejected": refused}
            )
        finally:
            checked.unpersist()

    return (
        stream_lines(spark, landing, files_per_batch)
        .writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def load(
    spark: SparkSession,
    log: RecordLog,
    table: KeyedTable,
    counts_path: str,
    checkpoint: str,
    rules: EventRules = EventRules(),
    batches_per_load: int | None = None,
    trigger: dict = WHAT_IS_THERE,
) -> StreamingQuery:
    """Log -> events table, following the log's commits; a missing log has none."""
    spark.conf.set(DUPLICATE_KEYS_CONF, "true")

    def each(batch: DataFrame, batch_id: int) -> None:
        name = _name(batch.sparkSession, batch_id)
        new = batch.select("batch_id")
        taken = log.commits().join(new, "batch_id", "left_semi")
        loaded = load_records(log.read_batches(taken), table, rules, batch=name)
        end = taken.agg(F.max(F.col("first_offset") + F.col("rows"))).first()[0]
        _write_counts(spark, counts_path, name, {**loaded._asdict(), "consumed": end or 0})

    return (
        log.stream_commits(batches_per_load)
        .writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def append_lines(
    spark: SparkSession,
    landing: str,
    log: RecordLog,
    checkpoint: str,
    files_per_batch: int | None = None,
    trigger: dict = WHAT_IS_THERE,
) -> StreamingQuery:
    """Landed lines -> the log, unchecked: for consumers that validate what they read."""

    def each(batch: DataFrame, batch_id: int) -> None:
        log.append(batch, source=_name(batch.sparkSession, batch_id))

    return (
        stream_lines(spark, landing, files_per_batch)
        .writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def detect(
    spark: SparkSession,
    log: RecordLog,
    alerts: KeyedTable,
    holds: KeyedTable,
    flags: KeyedTable,
    checkpoint: str,
    params: DetectorParams = DetectorParams(),
    rules: TransferRules = TransferRules(),
    skew: SkewParams = SkewParams(),
    scoring: Sequence[Rule] = RULES,
    commits_per_batch: int | None = None,
    trigger: dict = WHAT_IS_THERE,
) -> StreamingQuery:
    """Log of transfers -> alerts and holds; `flags` keeps the accounts that fired.

    Arrival order is the order of offsets. The stream keeps digests of all transfers so far
    (`streaming.state`) and hands on those that its new commits touch; the new transfers
    themselves are read from the log, so state holds no more than later ones need.
    """
    spark.conf.set(DUPLICATE_KEYS_CONF, "true")
    use_rocksdb(spark)

    def each(batch: DataFrame, batch_id: int) -> None:
        name = _name(batch.sparkSession, batch_id)
        state = stage(batch, "state")
        taken = log.commits().join(K.commits(state), "batch_id", "left_semi")
        start = taken.agg(F.min("first_offset")).first()[0]
        if start is None:
            return
        checked = validate_transfers(log.read_batches(taken).select("offset", "raw"), rules)
        new = stage(accepted(checked).select(*TRANSFER_COLUMNS), "transfers")
        features = features_after(
            new, K.totals(state), K.first_payments(state), K.points_before(state, start), params, skew
        )
        scored = stage(
            score(features, params, scoring).select(
                "offset", "txn_id", "account_id", "timestamp", "fired"
            ),
            "scored",
        )
        alerts.insert(alerts_of(scored), batch=name)
        holds.insert(holds_of(scored, skew, flags.before(name)), batch=name)
        fired = scored.where(F.size("fired") > 0)
        flags.insert(fired.select("account_id", "offset"), batch=name)

    records = log.stream_records(commits_per_batch)
    valid = accepted(validate_transfers(records, rules))
    return (
        K.digests(valid, params)
        .writeStream.foreachBatch(each)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
