"""Quantiles from stored sketches, hot keys, record versions and the layout by day."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluiceway.operators import monitor as MO
from sluiceway.operators.versions import upcast
from sluiceway.sources.tables import read_days, write_days


def test_sketches_merge_over_any_span(spark):
    rows = spark.range(40_000).select(
        F.pmod("id", F.lit(7)).alias("day"), F.when(F.col("id") % 11 > 0, F.pmod(F.xxhash64("id"), F.lit(10_000))).alias("v"))
    parts = MO.quantile_sketches(rows, F.col("v").cast("double"), "day").cache()
    for days in (range(7), (2, 5)):
        (n, *_), = [r for r in parts.where(F.col("day").isin(*days)).agg(F.sum("n")).collect()]
        values = np.sort([r.v for r in rows.where(F.col("day").isin(*days) & F.col("v").isNotNull()).collect()])
        assert n == len(values)
        for r in MO.quantiles(parts.where(F.col("day").isin(*days)), (0.0, 0.5, 0.95, 0.99, 1.0)).collect():
            low, high = (np.searchsorted(values, r.value, side) / n for side in ("left", "right"))
            assert low - MO.RANK_ERROR <= r.share <= high + MO.RANK_ERROR


def test_no_hot_key_is_missed(spark):
    # one key with a third of the rows, some just at the share, very many with one row each
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 100 == 1, F.lit("edge"))
        .when(F.col("id") % 50 != 2, F.concat(F.lit("k"), F.col("id"))).alias("k"))
    true = {r.k: r.n for r in rows.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n")).collect()}
    for share in (0.001, 0.0066, 0.2, 0.9):
        got = {r.key: (r["count"], r.total) for r in MO.hot_keys(rows, "k", share).collect()}
        assert got == {k: (n, 30_000) for k, n in true.items() if n >= share * 30_000}
    assert MO.hot_keys(rows.limit(0), "k", 0.1).count() == 0
    with pytest.raises(ValueError):
        MO.hot_keys(rows, "k", 0)


def test_versions_are_lifted_in_order(spark):
    raws = [
        '{"event_id": "a", "value": 1.5}', '{"event_id": "b", "schema_version": 2, "amount": 2, "value": 9}',
        '{"event_id": "c", "schema_version": 3, "amount": 3, "channel": "app"}',
        '{"event_id": "d", "schema_version": 4, "amount": 4}', "no json", '{"event_id": "e", "schema_version": 1, "amount": 5}',
    ]
    got = upcast(spark.createDataFrame(list(enumerate(raws)), "offset bigint, raw string")).orderBy("offset").collect()
    assert [(r.event_id, r.version, r.amount, r.channel) for r in got] == [
        ("a", 1, 1.5, "web"), ("b", 2, 2.0, "web"), ("c", 3, 3.0, "app"), ("d", None, 4.0, None),
        (None, None, None, None), ("e", 1, 5.0, "web")]


def test_days_are_replaced_one_by_one_and_pruned(spark, tmp_path):
    path = str(tmp_path / "days")

    def events(day, n):
        return spark.range(n).select(
            F.concat(F.lit(f"{day}-"), F.col("id")).alias("event_id"), F.lit("u").alias("user_id"),
            F.lit("click").alias("event_type"), F.lit(f"2024-05-0{day}T10:00:00Z").alias("timestamp"),
            F.lit(1.0).alias("value"))

    write_days(events(1, 5).unionByName(events(2, 6)), path)
    for _ in range(2):
        write_days(events(2, 4), path)  # again, with other rows
    stored = read_days(spark, path)
    assert {str(r.event_date): r.n for r in stored.groupBy("event_date").agg(F.count("*").alias("n")).collect()} == {
        "2024-05-01": 5, "2024-05-02": 4}
    one = stored.where("event_date = date'2024-05-01'").select("event_id")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and one.count() == 5
    read = stored.where("event_date = date'2024-05-01'").select(F.input_file_name().alias("f")).collect()
    assert {r.f.rsplit("/", 2)[1] for r in read} == {"event_date=2024-05-01"}
    assert read_days(spark, str(tmp_path / "none")).count() == 0
