"""Streaming queries against their batch twins, over several splits of one input."""

import json
import os

import pytest
from pyspark.sql import functions as F
from test_detect import STORY_ALERTS, drain_story, random_transfers, transfer
from test_events import GOOD, sample

from sluiceway.operators.detect import detect as batch_detect
from sluiceway.operators.load import load_records
from sluiceway.plans.runs import event_report, run_events, run_transfers
from sluiceway.sources.lines import read_lines
from sluiceway.sources.log import RecordLog
from sluiceway.sources.tables import alerts_table, events_table, flags_table, holds_table
from sluiceway.streaming import runs as S


def land(folder, rows, files, first=0):
    """Write rows over files whose names and times follow the row order."""
    folder.mkdir(exist_ok=True)
    size = -(-len(rows) // files)
    for f in range(files):
        path = folder / f"{first + f:04d}.jsonl"
        path.write_text("".join(
            (r if isinstance(r, str) else json.dumps(r)) + "\n"
            for r in rows[f * size:(f + 1) * size]))
        os.utime(path, (1_700_000_000 + first + f,) * 2)
    return str(folder)


def test_ingest_and_load(spark, tmp_path):
    rows = [*sample(), "{broken", "", dict(GOOD, event_id="e1", user_id="late")]
    landing = land(tmp_path / "in", rows, 4)
    log = RecordLog(spark, str(tmp_path / "log"))
    paths = [str(tmp_path / n) for n in ("rejects", "counts", "ck")]

    def ingest():
        S.ingest(spark, landing, log, *paths, files_per_batch=2).awaitTermination()

    ingest()
    got = [json.loads(r.raw)["event_id"] for r in log.read().orderBy("offset").collect()]
    assert got == [f"e{i}" for i in range(1, 9)] + ["e1"]
    rejects = spark.read.parquet(paths[0]).collect()
    assert sorted((r.error, len(r.details or [])) for r in rejects) == [
        ("invalid JSON", 0), ("validation failed", 1), ("validation failed", 1)]
    counts = spark.read.parquet(paths[1]).agg(F.sum("accepted"), F.sum("rejected")).first()
    assert tuple(counts) == (9, 3)

    table = events_table(spark, str(tmp_path / "events"))
    counts_path, checkpoint = str(tmp_path / "loads"), str(tmp_path / "ck2")

    def load():
        S.load(spark, log, table, counts_path, checkpoint, batches_per_load=1).awaitTermination()
        loads = spark.read.parquet(counts_path)
        return tuple(loads.agg(F.sum("written"), F.sum("skipped"), F.sum("duplicates")).first())

    assert load() == (8, 0, 1)
    assert {r.user_id for r in table.read().where("event_id = 'e1'").collect()} == {"dora"}
    # Nothing new: both queries stop without changing a thing.
    ingest()
    assert load() == (8, 0, 1) and log.size() == 9
    # More lands: the same queries carry on.
    land(tmp_path / "in", [dict(GOOD, event_id="e99"), dict(GOOD, event_id="e2")], 1, first=10)
    ingest()
    assert load() == (9, 0, 2) and log.size() == 11
    # Another consumer starts from the beginning with a checkpoint of its own.
    copy = events_table(spark, str(tmp_path / "copy"))
    S.load(spark, log, copy, str(tmp_path / "l2"), str(tmp_path / "ck3")).awaitTermination()
    assert sorted(copy.read().collect()) == sorted(table.read().collect())
    batch = events_table(spark, str(tmp_path / "batch"))
    load_records(log.read(), batch)
    assert sorted(batch.read().collect()) == sorted(table.read().collect())


def test_batch_that_runs_again_replaces_itself(spark, tmp_path):
    table = events_table(spark, str(tmp_path / "events"))
    df = spark.createDataFrame([(0, json.dumps(GOOD)), (1, json.dumps(GOOD))], "offset long, raw string")
    assert load_records(df, table, batch="b-0") == (1, 0, 1)
    assert load_records(df, table, batch="b-0") == (1, 0, 1)
    assert load_records(df, table, batch="b-1") == (0, 0, 2)
    assert table.read().count() == 1


def stream_detect(spark, base, landing, files_per_batch):
    tables = [make(spark, str(base / name)) for make, name in
              ((alerts_table, "a"), (holds_table, "h"), (flags_table, "f"))]
    log = RecordLog(spark, str(base / "transfers"))
    S.append_lines(spark, landing, log, str(base / "ck-in"),
                   files_per_batch=files_per_batch).awaitTermination()
    S.detect(spark, log, *tables, str(base / "ck"),
             commits_per_batch=files_per_batch).awaitTermination()
    return tables


def found(table):
    return sorted(tuple(r) for r in table.read().collect())


def as_records(rows):
    from datetime import datetime, timezone

    return [
        {"txn_id": r["txn_id"], "account_id": r["account_id"], "payee_id": r["payee_id"],
         "amount": r["amount"], "currency": "EUR",
         "timestamp": datetime.fromtimestamp(r["ts"] / 1e6, timezone.utc).isoformat()}
        for r in rows
    ]


@pytest.mark.parametrize("files, per_batch", [(1, None), (6, 2), (5, 1)])
def test_stream_equals_batch(spark, tmp_path, files, per_batch):
    rows = [*drain_story(), "junk", {"txn_id": "bad"}, *as_records(random_transfers(11, 120)),
            *[transfer("same", "copies")] * 4]
    landing = land(tmp_path / "in", rows, files)
    alerts, holds = (make(spark, str(tmp_path / n)) for make, n in
                     ((alerts_table, "ba"), (holds_table, "bh")))
    records = spark.createDataFrame(
        [(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(rows)],
        "offset long, raw string")
    batch_detect(records, alerts, holds)
    stream_alerts, stream_holds, _ = stream_detect(spark, tmp_path, landing, per_batch)
    assert set(STORY_ALERTS) <= {(a[0], a[2], a[3]) for a in found(alerts)}
    assert found(stream_alerts) == found(alerts)
    assert found(stream_holds) == found(holds)


def test_state_outlives_the_query(spark, tmp_path):
    story = drain_story()
    land(tmp_path / "in", story[:5], 1)
    first, _, _ = stream_detect(spark, tmp_path, str(tmp_path / "in"), None)
    assert first.read().count() == 3
    land(tmp_path / "in", story[5:], 1, first=5)
    alerts, holds, flags = stream_detect(spark, tmp_path, str(tmp_path / "in"), None)
    assert {(r.txn_id, r.rule, r.reason) for r in alerts.read().collect()} == set(STORY_ALERTS)
    assert sorted(r.txn_id for r in holds.read().collect()) == ["s1", "s2"]
    assert [r.account_id for r in flags.read().collect()] == ["acc-7"]


def test_whole_runs(spark, tmp_path):
    events = land(tmp_path / "events", sample(), 1)
    paths = str(tmp_path / "log"), str(tmp_path / "table")
    for _ in range(2):
        run = run_events(spark, events, *paths)
        assert (run.accepted, run.rejected, run.loaded) == (8, 2, (8, 0, 0))
    values = {(r.metric, r.key): r.value for r in event_report(spark, paths[1]).collect()}
    assert values["total_purchase_value", "all"] == 49.75 and values["top_users", "emil"] == 4
    kept_on = run_events(spark, events, *paths, reset=False)
    assert kept_on.loaded == (0, 0, 8) and RecordLog(spark, paths[0]).size() == 16
    story = land(tmp_path / "story", drain_story(), 1)
    targets = [str(tmp_path / n) for n in ("tlog", "alerts", "holds")]
    for _ in range(2):
        assert run_transfers(spark, story, *targets) == (10, 0, 7, 2, 7, 2)


def forget_last_commit(checkpoint):
    """As if the process had died after writing its tables, before its commit."""
    commits = checkpoint / "commits"
    last = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        (commits / name).unlink(missing_ok=True)


def test_micro_batch_that_died_before_its_commit(spark, tmp_path):
    landing = land(tmp_path / "in", drain_story(), 3)
    tables = stream_detect(spark, tmp_path, landing, 1)
    before = [found(t) for t in tables]
    forget_last_commit(tmp_path / "ck")
    assert [found(t) for t in stream_detect(spark, tmp_path, landing, 1)] == before
    assert len(before[0]) == 7 and len(before[1]) == 2

    events = land(tmp_path / "events", [*sample(), dict(GOOD, event_id="e2")], 2)
    log = RecordLog(spark, str(tmp_path / "log"))
    table = events_table(spark, str(tmp_path / "table"))
    paths = [str(tmp_path / n) for n in ("rejects", "counts", "ck1")]

    def run():
        S.ingest(spark, events, log, *paths, files_per_batch=1).awaitTermination()
        S.load(spark, log, table, str(tmp_path / "loads"), str(tmp_path / "ck2"),
               batches_per_load=1).awaitTermination()
        loads = spark.read.parquet(str(tmp_path / "loads"))
        return (sorted(log.read().collect()), found(table), sorted(loads.collect()),
                spark.read.parquet(paths[0]).count())

    first = run()
    for checkpoint in ("ck1", "ck2"):
        forget_last_commit(tmp_path / checkpoint)
    assert run() == first and len(first[1]) == 8


def test_a_file_much_older_than_the_rest_is_read(spark, tmp_path):
    log = RecordLog(spark, str(tmp_path / "log"))
    paths = [str(tmp_path / n) for n in ("rejects", "counts", "ck")]
    for first in (0, -30 * 86_400):
        landing = land(tmp_path / "in", [dict(GOOD, event_id=f"at{first}")], 1, first=first)
        S.ingest(spark, landing, log, *paths).awaitTermination()
    assert log.size() == 2


def test_a_checkpoint_is_known_by_its_id_not_its_path(spark, tmp_path):
    log = RecordLog(spark, str(tmp_path / "log"))
    landing = land(tmp_path / "in", [dict(GOOD, event_id="a")], 1)
    paths = [str(tmp_path / n) for n in ("rejects", "counts", "ck")]
    S.ingest(spark, landing, log, *paths).awaitTermination()
    forget_last_commit(tmp_path / "ck")
    paths[-1] += "/"
    S.ingest(spark, landing, log, *paths).awaitTermination()
    assert log.size() == 1
    (name,) = [r.source for r in log.commits().collect()]
    assert name == json.loads((tmp_path / "ck" / "metadata").read_text())["id"] + "-0"


@pytest.mark.parametrize("per_batch", [1, None])
def test_order_is_by_time_whatever_the_names(spark, tmp_path, per_batch):
    folder = tmp_path / "in"
    folder.mkdir()
    for n, name in enumerate(("z", "m", "a")):
        path = folder / name
        path.write_text(json.dumps(dict(GOOD, event_id=name)))
        os.utime(path, (1_700_000_000 + n,) * 2)
    log = RecordLog(spark, str(tmp_path / "log"))
    paths = [str(tmp_path / n) for n in ("rejects", "counts", "ck")]
    S.ingest(spark, str(folder), log, *paths, files_per_batch=per_batch).awaitTermination()
    assert [json.loads(r.raw)["event_id"] for r in log.read().orderBy("offset").collect()] == ["z", "m", "a"]
