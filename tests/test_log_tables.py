"""Writers that meet, tables that do not read their past, and the plans that say so."""

import json
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from sluiceway.sources import blooms, files, tables
from sluiceway.sources.log import RecordLog, block_shifts, in_order, numbered
from sluiceway.sources.staging import stage
from sluiceway.sources.tables import events_table
from sluiceway.streaming import runs as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def records(spark, name, n):
    return in_order(spark.range(n).select(
        F.col("id").alias("n"), F.to_json(F.struct(F.lit(name).alias("w"), F.col("id"))).alias("raw")), "n")


def test_writers_that_append_at_once(spark, tmp_path):
    path = str(tmp_path / "log")

    def write(k):
        return [RecordLog(spark, path).append(records(spark, f"{k}-{i}", 20 + k)) for i in range(3)]

    with ThreadPoolExecutor(3) as pool:
        appends = sorted(a for some in pool.map(write, range(3)) for a in some)
    log = RecordLog(spark, path)
    end = 0
    for first, rows in appends:
        assert first == end
        end += rows
    rows = log.read().orderBy("offset").collect()
    assert [r.offset for r in rows] == list(range(end)) and log.size() == end == 3 * (20 + 21 + 22)
    # each append is one stretch, in its own order
    for first, n in appends:
        mine = [json.loads(r.raw) for r in rows[first:first + n]]
        assert len({m["w"] for m in mine}) == 1 and [m["id"] for m in mine] == list(range(n))
    assert [r.batch_id for r in log.commits().orderBy("batch_id").collect()] == list(range(9))


def test_a_name_is_given_once(spark, tmp_path):
    path = str(tmp_path / "one" / "name")
    with ThreadPoolExecutor(4) as pool:
        won = list(pool.map(lambda i: files.write_once(spark, path, str(i)), range(8)))
    assert sum(won) == 1 and files.read_small(spark, path) == str(won.index(True))
    assert files.names(spark, str(tmp_path / "one")) == ["name"]


def test_records_are_numbered_where_they_are(spark):
    staged = stage(records(spark, "a", 50).select(
        "raw", "src_file", "src_block", F.monotonically_increasing_id().alias("_seq")), "t")
    shifts = stage(block_shifts(staged), "t")
    near = plan(numbered(staged, shifts, 4))
    assert "BroadcastHashJoin" in near and "Exchange hashpartitioning" not in near
    far = numbered(staged, shifts, 1 << 30)
    assert [r.offset for r in far.orderBy("offset").collect()] == list(range(50))


def test_a_missing_log_has_no_rows(spark, tmp_path):
    log = RecordLog(spark, str(tmp_path / "none"))
    table = events_table(spark, str(tmp_path / "t"))
    S.load(spark, log, table, str(tmp_path / "counts"), str(tmp_path / "ck")).awaitTermination()
    assert log.read(3).count() == 0 and table.read().count() == 0 and log.size() == 0


def events(spark, first, end):
    return spark.range(first, end).select(
        F.concat(F.lit("e"), F.col("id")).alias("event_id"), F.lit("u").alias("user_id"),
        F.lit("click").alias("event_type"), F.lit("now").alias("timestamp"),
        F.col("id").cast("double").alias("value"), F.col("id").alias("offset"))


def test_inserts_read_the_past_only_for_repeats(spark, tmp_path, monkeypatch):
    table = events_table(spark, str(tmp_path / "t"))
    looked_up = []
    known = tables.KeyedTable._known

    def spy(self, maybe, batch):
        looked_up.append((batch, sorted(r.b for r in maybe.select(F.explode("batches").alias("b")).distinct().collect())))
        return known(self, maybe, batch)

    monkeypatch.setattr(tables.KeyedTable, "_known", spy)
    assert [table.insert(events(spark, 50 * i, 50 * i + 50), batch=f"b{i}") for i in range(4)] == [50] * 4
    assert looked_up == []  # nothing stored was read
    assert table.insert(events(spark, 190, 260), batch="b4") == 60
    assert [b for b, _ in looked_up] == ["b4"]
    assert table.insert(events(spark, 0, 50), batch="b0") == 50  # runs again
    assert table.read().count() == 260 == table.read().select("event_id").distinct().count()
    versions = files.names(spark, f"{table.index_path}/versions")
    assert len(versions) == 6
    table.clear()
    assert table.read().count() == 0 and table.insert(events(spark, 0, 5)) == 5


def test_filters_never_miss_a_key(spark, monkeypatch):
    monkeypatch.setattr(blooms, "CAPACITY", 40)
    monkeypatch.setattr(blooms, "BITS", 1 << 10)

    def keys(a, b):
        h = F.xxhash64(F.col("id"))
        return spark.range(a, b).select(F.pmod(h, F.lit(4)).cast("int").alias("bucket"), h.alias("hash"))

    index = spark.createDataFrame([], blooms.INDEX)
    for i in range(3):
        index = stage(blooms.judge(keys(300 * i, 300 * i + 300), index, f"b{i}"), "index")
    again = blooms.judge(keys(0, 900), index, "b3").where("kind = 'maybe'")
    assert again.select("hash").distinct().count() == 900
    assert index.where("kind = 'filter'").agg(F.max("n")).first()[0] <= 40
    fresh = blooms.judge(keys(10_000, 11_000), index, "b3").where("kind = 'maybe'")
    assert fresh.select("hash").distinct().count() < 300


def test_log_keeps_the_canonical_form(spark, tmp_path):
    """Keys sorted, no space, the last of a repeated key, numbers as written; no JSON stays as it is."""
    kept = [
        ('{"b": 2.50, "a" : [1.0, -1E3, 12345678901234567890.10 ]}', '{"a":[1.0,-1E3,12345678901234567890.10],"b":2.50}'),
        ('{"s": "n1 \\"n2\\" x", "n": "n3", "": "s4", "t": "1.0"}', '{"":"s4","n":"n3","s":"n1 \\"n2\\" x","t":"1.0"}'),
        ('{"q": "back\\\\", "z": 1.0, "e": "", "u": "\\u00e9"}', '{"e":"","q":"back\\\\","u":"\u00e9","z":1.0}'),
        ('{"k": 1, "x9": {"y-1": null, "x": true}, "k": 1.00}', '{"k":1.00,"x9":{"x":true,"y-1":null}}'),
        ('{"long": "' + "\\\\n" * 20000 + '", "n": 0.10}', '{"long":"' + "\\\\n" * 20000 + '","n":0.10}'),
        ('[" -7 ", -7.0]', '[" -7 ",-7.0]'),
        (" 5.0 ", "5.0"),
        ("01", "01"),
        ('{"a": 1} {"b": 2}', '{"a": 1} {"b": 2}'),
        ("{broken 1.0", "{broken 1.0"),
        ("", ""),
    ]
    rows = spark.createDataFrame([(n, raw) for n, (raw, _) in enumerate(kept)], "n bigint, raw string")
    log = RecordLog(spark, str(tmp_path / "log"))
    log.append(in_order(rows, "n"))
    got = [r.raw for r in log.read().orderBy("offset").collect()]
    assert got == [want for _, want in kept]
    for raw, want in kept[:7]:
        assert json.loads(raw) == json.loads(want)
