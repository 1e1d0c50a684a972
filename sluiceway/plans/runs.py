"""Whole runs over named paths. Every target is an argument; nothing is implied."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from sluiceway.config import DetectorParams, EventRules, SkewParams, TransferRules
from sluiceway.operators.analytics import analytics_report
from sluiceway.operators.detect import Summary, detect
from sluiceway.operators.load import Loaded, load_records
from sluiceway.operators.validate import accepted, is_valid, rejected, validate_events
from sluiceway.sources.lines import read_lines
from sluiceway.sources.log import RecordLog
from sluiceway.sources.tables import alerts_table, events_table, holds_table


class BatchRun(NamedTuple):
    accepted: int
    rejected: int
    loaded: Loaded
    report: DataFrame


def event_report(spark: SparkSession, table_path: str) -> DataFrame:
    """The report over whatever is stored."""
    return analytics_report(events_table(spark, table_path).read())


def run_events(
    spark: SparkSession,
    source: str | list[str],
    log_path: str,
    table_path: str,
    rules: EventRules = EventRules(),
    reset: bool = True,
    rejects_path: str | None = None,
) -> BatchRun:
    """File -> validate -> log -> events table -> report. `reset` starts both afresh.

    Rejects are counted in the pass that appends; with `rejects_path` they are written
    there with their faults, from the same files.
    """
    log, table = RecordLog(spark, log_path), events_table(spark, table_path)
    if reset:
        log.clear()
        table.clear()
    checked = validate_events(read_lines(spark, source), rules)
    seen = Observation()
    counted = checked.observe(seen, F.count_if(~is_valid()).alias("rejected"))
    appended = log.append(accepted(counted))
    if rejects_path is not None:
        rejected(checked).write.mode("overwrite").parquet(rejects_path)
    loaded = load_records(log.read(appended.first_offset), table, rules)
    return BatchRun(
        appended.rows, seen.get["rejected"], loaded, event_report(spark, table_path)
    )


def run_transfers(
    spark: SparkSession,
    source: str | list[str],
    log_path: str,
    alerts_path: str,
    holds_path: str,
    params: DetectorParams = DetectorParams(),
    rules: TransferRules = TransferRules(),
    skew: SkewParams = SkewParams(),
    reset: bool = True,
) -> Summary:
    """File -> log -> detector -> alert and hold tables."""
    log = RecordLog(spark, log_path)
    alerts, holds = alerts_table(spark, alerts_path), holds_table(spark, holds_path)
    if reset:
        log.clear()
        alerts.clear()
        holds.clear()
    log.append(read_lines(spark, source))
    return detect(log.read(), alerts, holds, params, rules, skew)
