"""Validation, log, load and analytics on small inputs of our own."""

import json

import pytest
from pyspark.sql import functions as F

from sluiceway.operators import analytics as A
from sluiceway.operators.load import load_records
from sluiceway.operators.validate import accepted, intake_counts, rejected, validate_events
from sluiceway.sources.lines import read_lines
from sluiceway.sources.log import RecordLog, in_order
from sluiceway.sources.tables import events_table

GOOD = {
    "event_id": "x1",
    "user_id": "ann",
    "event_type": "click",
    "timestamp": "2026-03-01T08:00:00Z",
    "value": 3,
}
TYPES = "['click', 'page_view', 'purchase', 'signup']"


def faults(spark, *records):
    raws = [r if isinstance(r, str) else json.dumps(r) for r in records]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "n int, raw string")
    return [r.errors for r in validate_events(df).orderBy("n").collect()]


def without(name):
    return {k: v for k, v in GOOD.items() if k != name}


CASES = [
    (GOOD, []),
    (dict(GOOD, extra={"a": [1]}), []),
    (without("value"), []),
    (dict(GOOD, value=None), []),
    (dict(GOOD, value=0), []),
    (dict(GOOD, value=0.5), []),
    (dict(GOOD, event_id=0), []),
    (dict(GOOD, user_id=False), []),
    (dict(GOOD, user_id="  "), []),
    (without("user_id"), ["missing required field: user_id"]),
    (dict(GOOD, event_id=None), ["missing required field: event_id"]),
    (dict(GOOD, event_type="boom"), [f"invalid event_type 'boom'; allowed: {TYPES}"]),
    (dict(GOOD, event_type=7), [f"invalid event_type 7; allowed: {TYPES}"]),
    (dict(GOOD, event_type="it's"), [f"invalid event_type \"it's\"; allowed: {TYPES}"]),
    (
        dict(GOOD, event_type=""),
        ["missing required field: event_type", f"invalid event_type ''; allowed: {TYPES}"],
    ),
    (dict(GOOD, timestamp="next week"), ["timestamp is not ISO-8601: 'next week'"]),
    (dict(GOOD, timestamp=5), ["timestamp is not ISO-8601: 5"]),
    (dict(GOOD, timestamp=True), ["timestamp is not ISO-8601: True"]),
    (
        dict(GOOD, timestamp=""),
        ["missing required field: timestamp", "timestamp is not ISO-8601: ''"],
    ),
    (dict(GOOD, value=-1), ["value must be >= 0"]),
    (dict(GOOD, value=True), ["value must be a number"]),
    (dict(GOOD, value="3"), ["value must be a number"]),
    (dict(GOOD, value=[3]), ["value must be a number"]),
    (dict(GOOD, event_id={"a": 1}), ["event_id must not be an array or object"]),
    (
        dict(GOOD, event_type="boom", value=-2),
        [f"invalid event_type 'boom'; allowed: {TYPES}", "value must be >= 0"],
    ),
    (
        {},
        [f"missing required field: {n}" for n in ("event_id", "user_id", "event_type", "timestamp")],
    ),
    ('"text"', ["event must be a JSON object"]),
    ("[1]", ["event must be a JSON object"]),
    ("null", ["event must be a JSON object"]),
    ("3", ["event must be a JSON object"]),
    ("{bad", ["invalid JSON"]),
    ("", ["invalid JSON"]),
    ('{"a":1} x', ["invalid JSON"]),
    ('{"a":1}] x', ["invalid JSON"]),
    ('{"a":1}} x', ["invalid JSON"]),
    ("1, 2", ["invalid JSON"]),
    ('{"a":1}, {"a":1}]', ["invalid JSON"]),
    ('{"a": NaN}', ["invalid JSON"]),
    ('{"a":1},', ["invalid JSON"]),
]


def test_every_fault_is_listed_in_order(spark):
    assert faults(spark, *(c for c, _ in CASES)) == [e for _, e in CASES]


@pytest.mark.parametrize(
    "stamp, ok",
    [
        ("2026-03-01T08:00:00\n", False),
        ("2026-03-01T08:00:00Z\n", False),
        ("2026-03-01\n", False),
        ("2026-03-01|08:00", True),
        ("2026-03-01|08:00:00+01:00", True),
        ("|".join("1" * 17), False),
        ("2026-W09-7T08:00", True),
    ],
)
def test_ends_and_separators_of_times(spark, stamp, ok):
    assert (faults(spark, dict(GOOD, timestamp=stamp)) == [[]]) is ok


def test_last_of_duplicate_keys_counts(spark):
    raw = json.dumps(GOOD)[:-1] + ', "event_type": "signup"}'
    df = spark.createDataFrame([(raw,)], "raw string")
    assert validate_events(df).first().event_type == "signup"


def events_file(tmp_path, rows, name="in.jsonl"):
    path = tmp_path / name
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return str(path)


def sample():
    """Eight good events, then one of an unknown type and one without a time."""
    rows = []

    def add(user, kind, **more):
        n = len(rows) + 1
        rows.append({"event_id": f"e{n}", "user_id": user, "event_type": kind,
                     "timestamp": f"2024-11-05T23:{3 * n:02d}:30+01:00"} | more)

    add("dora", "signup")
    add("emil", "click")
    add("emil", "purchase", value=12.25)
    add("finn", "page_view")
    add("emil", "click")
    add("dora", "purchase", value=7.0)
    add("emil", "purchase", value=30.5)
    add("finn", "signup")
    add("finn", "hover")
    add("dora", "click", timestamp="soon")
    return rows


def test_sample_end_to_end(spark, tmp_path):
    source = read_lines(spark, events_file(tmp_path, [*sample()[:4], "", "   ", *sample()[4:]]))
    checked = validate_events(source)
    assert tuple(intake_counts(checked).first()) == (8, 2)
    assert [r.error for r in rejected(checked).collect()] == ["validation failed"] * 2
    log = RecordLog(spark, str(tmp_path / "log"))
    assert log.append(accepted(checked)) == (0, 8)
    ids = [json.loads(r.raw)["event_id"] for r in log.read().orderBy("offset").collect()]
    assert ids == [f"e{i}" for i in range(1, 9)]
    table = events_table(spark, str(tmp_path / "events"))
    assert load_records(log.read(), table) == (8, 0, 0)
    events = table.read()
    assert [tuple(r) for r in A.count_by_event_type(events).collect()] == [
        ("purchase", 3), ("click", 2), ("signup", 2), ("page_view", 1)]
    assert [tuple(r) for r in A.top_users(events).collect()] == [
        ("emil", 4), ("dora", 2), ("finn", 2)]
    assert A.event_count(events).first()[0] == 8
    assert A.total_purchase_value(events).first().total == 49.75
    assert A.analytics_report(events).count() == 1 + 4 + 3 + 1


def test_log_offsets_reads_and_size(spark, tmp_path):
    log = RecordLog(spark, str(tmp_path / "log"))
    assert log.size() == 0 and log.read().count() == 0
    first = read_lines(spark, events_file(tmp_path, ['{"a": 1}', '{"a": 2}', '{"a": 3}'], "a"))
    second = read_lines(spark, events_file(tmp_path, ['{"a": 4}', '{"a": 5}'], "b"))
    assert log.append(first) == (0, 3)
    assert log.append(second) == (3, 2)

    def read(start):
        rows = log.read(start).orderBy("offset").collect()
        return [(r.offset, json.loads(r.raw)["a"]) for r in rows]

    assert read(0) == [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)]
    assert read(0) == read(0)
    assert read(2) == [(2, 3), (3, 4), (4, 5)]
    assert read(4) == [(4, 5)] and read(5) == []
    assert log.size() == 5


def test_replayed_append_keeps_its_offsets(spark, tmp_path):
    log = RecordLog(spark, str(tmp_path / "log"))
    rows = read_lines(spark, events_file(tmp_path, ['{"a": 1}', '{"a": 2}']))
    assert log.append(rows, "job-7") == (0, 2)
    assert log.append(rows, "job-7") == (0, 2)
    assert log.size() == 2
    # A batch that died between its records and its commit leaves no trace.
    log.read().select("offset", "raw").write.parquet(f"{log.records_path}/batch_id=1")
    assert log.read().count() == 2
    assert log.append(rows, "job-8") == (2, 2)
    assert sorted(r.offset for r in log.read().collect()) == [0, 1, 2, 3]


def test_offsets_follow_file_order_over_many_blocks(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        path = events_file(tmp_path, [f'{{"n": {i}}}' for i in range(3000)])
        checked = read_lines(spark, path).where(F.get_json_object("raw", "$.n") % 3 != 1)
        log = RecordLog(spark, str(tmp_path / "log"))
        log.append(checked)
        rows = log.read().orderBy("offset").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.offset for r in rows] == list(range(2000))
    assert [json.loads(r.raw)["n"] for r in rows] == [i for i in range(3000) if i % 3 != 1]


def load(spark, table, rows, start=0):
    df = spark.createDataFrame(
        [(start + i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(rows)],
        "offset long, raw string",
    )
    return load_records(df, table)


def test_first_record_of_an_id_wins(spark, tmp_path):
    table = events_table(spark, str(tmp_path / "events"))
    rows = [dict(GOOD, value=1), dict(GOOD, value=2), dict(GOOD, event_id="x2")]
    assert load(spark, table, rows) == (2, 0, 1)
    assert load(spark, table, [dict(GOOD, value=9), dict(GOOD, event_id="x3")], 3) == (1, 0, 1)
    assert {r.event_id: r.value for r in table.read().collect()} == {"x1": 1.0, "x2": 3.0, "x3": 3.0}


def test_replayed_load_changes_nothing(spark, tmp_path):
    table = events_table(spark, str(tmp_path / "events"))
    rows = [GOOD, {"event_id": "bad"}, "{oops"]
    assert load(spark, table, rows) == (1, 2, 0)
    assert load(spark, table, rows) == (0, 2, 1)
    assert table.read().count() == 1


def test_numeric_and_text_ids_share_a_key(spark, tmp_path):
    table = events_table(spark, str(tmp_path / "events"))
    assert load(spark, table, [dict(GOOD, event_id=1), dict(GOOD, event_id="1")]) == (1, 0, 1)


def test_empty_table_reports(spark, tmp_path):
    events = events_table(spark, str(tmp_path / "none")).read()
    assert A.event_count(events).first()[0] == 0
    assert A.total_purchase_value(events).first().total == 0.0
    assert A.top_users(events).count() == 0
    with pytest.raises(ValueError):
        A.top_users(events, -1)


def test_sum_keeps_fine_and_huge_values(spark):
    values = [0.1] * 10 + [1e-9] * 10 + [1e15]
    df = spark.createDataFrame([(v,) for v in values], "value double")
    assert df.agg(A.money_sum(F.col("value"))).first()[0] == pytest.approx(1e15 + 1.00000001, rel=1e-16)
    small = df.where("value < 1").agg(A.money_sum(F.col("value"))).first()[0]
    assert small == pytest.approx(1.00000001, abs=1e-15)


def test_ties_in_top_users_are_textual(spark):
    df = spark.createDataFrame([("10",), ("9",), ("2",)], "user_id string")
    assert [r.user_id for r in A.top_users(df, 2).collect()] == ["10", "2"]


def test_copies_of_one_key_are_cut_before_the_shuffle(spark):
    from sluiceway.sources.tables import first_per_key

    df = spark.range(1000).select(F.expr("id div 1000").alias("event_id"), F.col("id").alias("offset"))
    plan = first_per_key(df, ("event_id",))._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_in_order_numbers_any_frame(spark, tmp_path):
    df = spark.range(500).select((499 - F.col("id")).alias("n"), F.to_json(F.struct("id")).alias("raw"))
    log = RecordLog(spark, str(tmp_path / "log"))
    assert log.append(in_order(df, "n")) == (0, 500)
    got = [json.loads(r.raw)["id"] for r in log.read().orderBy("offset").collect()]
    assert got == list(range(499, -1, -1))
