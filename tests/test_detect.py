"""Transfer validation, rules, detector; small inputs of our own."""

import json
import random

import model
import pytest
from pyspark.sql import functions as F

from sluiceway.config import DetectorParams, SkewParams
from sluiceway.operators import detect as DT
from sluiceway.operators.history import features, small_account_features
from sluiceway.operators.rules import RULES, Rule, fired_rules, score
from sluiceway.operators.validate import validate_transfers
from sluiceway.sources.tables import alerts_table, holds_table

DAY = "2026-05-04T"
SMALL = SkewParams(hot_rows=40, hot_keys=3, block_rows=7, slices=1 << 16)


def transfer(txn_id="t", account="acc", payee="shop", amount=10.0, at="12:00:00Z", **more):
    stamp = at if "-" in at[:8] else DAY + at
    return {"txn_id": txn_id, "account_id": account, "payee_id": payee, "amount": amount,
            "currency": "SGD", "timestamp": stamp, **more}


def records(spark, rows, first=0):
    raws = [(first + i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(rows)]
    return spark.createDataFrame(raws, "offset long, raw string")


CASES = [
    (transfer(), []),
    (transfer(channel="app"), []),
    (transfer(amount=0), ["amount must be > 0"]),
    (transfer(amount=-2.5), ["amount must be > 0"]),
    (transfer(amount=True), ["amount must be a number"]),
    (transfer(amount="5"), ["amount must be a number"]),
    (transfer(amount=""), ["missing required field: amount", "amount must be a number"]),
    (transfer(currency="XYZ"), ["unsupported currency 'XYZ'"]),
    (transfer(currency=""), ["missing required field: currency", "unsupported currency ''"]),
    (transfer(at="2026-13-01"), ["timestamp is not ISO-8601: '2026-13-01'"]),
    (transfer(account=["a"]), ["account_id must not be an array or object"]),
    (
        {"txn_id": "b", "amount": -1, "currency": 4, "timestamp": 9},
        ["missing required field: account_id", "missing required field: payee_id",
         "amount must be > 0", "unsupported currency 4", "timestamp is not ISO-8601: 9"],
    ),
    ("[]", ["transaction must be a JSON object"]),
    ("{", ["invalid JSON"]),
]


def test_transfer_faults(spark):
    df = validate_transfers(records(spark, [c for c, _ in CASES]))
    assert [r.errors for r in df.orderBy("offset").collect()] == [e for _, e in CASES]


def test_wall_clock_is_the_one_written(spark):
    rows = [transfer(at="03:01:00+08:00"), transfer(at="2026-05-04"), transfer(at="23:59:59-1130")]
    got = validate_transfers(records(spark, rows)).orderBy("offset").collect()
    assert [(r.hour, r.minute) for r in got] == [(3, 1), (0, 0), (23, 59)]
    assert got[1].ts - got[0].ts == (4 * 60 + 59) * 60 * 1_000_000


def fired(spark, rows, params=DetectorParams()):
    typed = DT.typed_transfers(records(spark, rows)).where("ok").drop("ok")
    scored = fired_rules(DT.score_transfers(typed, params))
    return [
        (r.txn_id, r.rule, r.reason) for r in scored.orderBy("offset", "rule_order").collect()
    ]


def near(*times, amount=100):
    return [transfer(f"t{i}", at=t, amount=amount) for i, t in enumerate(times)]


RAPID = [
    (near("13:01:00Z", "13:02:00Z", "13:03:00Z"), ("t2", "3 transfers in 10 min")),
    (near("13:00:00Z", "13:05:00Z", "13:10:00Z"), ("t2", "3 transfers in 10 min")),
    (near("13:00:00Z", "13:05:00Z", "13:10:00.000001Z"), None),
    (near("13:00:00Z", "13:00:00Z", "13:00:00Z"), ("t2", "3 transfers in 10 min")),
    (near("13:05:00Z", "13:06:00Z", "13:04:00Z"), None),
    (near("13:05:00Z", "13:04:00Z", "13:06:00Z"), ("t2", "3 transfers in 10 min")),
    (near("13:00:00Z", "13:01:00Z", amount=2500), None),
    (near("13:00:00Z", "13:01:00Z", amount=2500.01), ("t1", "5000.02 moved in 10 min")),
    (near("13:00:00Z", amount=6000), ("t0", "6000.00 moved in 10 min")),
    (near("2026-05-01T13:00:00Z", "2026-05-02T13:00:00Z", "13:00:00Z"), None),
    (near("21:00:00+08:00", "13:01:00Z", "13:02:00Z"), ("t2", "3 transfers in 10 min")),
    (near("1969-12-31T23:58:00Z", "1970-01-01T00:01:00Z", "1970-01-01T00:08:00Z"),
     ("t2", "3 transfers in 10 min")),
]


@pytest.mark.parametrize("skew", [SkewParams(), SkewParams(0, 99, 2, 1 << 16)])
def test_rapid_drain(spark, skew):
    rows = [dict(r, account_id=f"a{i}", txn_id=f"{i}/{r['txn_id']}", payee_id="known")
            for i, (case, _) in enumerate(RAPID) for r in case]
    typed = DT.typed_transfers(records(spark, rows)).where("ok").drop("ok")
    scored = fired_rules(DT.score_transfers(typed, DetectorParams(), skew))
    hits = scored.where("rule = 'rapid_drain'").orderBy("offset").collect()
    want = [(f"{i}/{e[0]}", e[1]) for i, (_, e) in enumerate(RAPID) if e]
    assert [(r.txn_id, r.reason) for r in hits] == want


def test_other_rules(spark):
    rows = [
        transfer("first", "a", "new", 1000.0),
        transfer("again", "a", "new", 1800.0, "15:00:00Z"),
        transfer("low", "b", "new", 999.99),
        transfer("h1", "c", "p", 20), transfer("h2", "c", "p", 20, "13:00:00Z"),
        transfer("two", "c", "p", 1000, "14:00:00Z"),
        transfer("k1", "d", "p", 20), transfer("k2", "d", "p", 20, "13:00:00Z"),
        transfer("k3", "d", "p", 20, "14:00:00Z"), transfer("five", "d", "p", 100, "15:00:00Z"),
        transfer("e1", "e", "p", 20), transfer("e2", "e", "p", 20, "13:00:00Z"),
        transfer("e3", "e", "p", 20, "14:00:00Z"), transfer("over", "e", "p", 100.01, "15:00:00Z"),
        transfer("o1", "f", at="01:59:59Z"), transfer("o2", "g", at="02:00:00Z"),
        transfer("o3", "h", at="04:59:00+08:00"), transfer("o4", "i", at="05:00:00Z"),
    ]
    assert fired(spark, rows) == [
        ("first", "new_payee_high_value", "1000.00 to never-seen payee new"),
        ("over", "amount_spike", "100.01 vs typical 20.00"),
        ("o2", "odd_hour", "transfer at 02:00"),
        ("o3", "odd_hour", "transfer at 04:59"),
    ]


def drain_story():
    """Four quiet payments, three at night to a stranger, and two accounts beside."""
    quiet = (("rent", 40.0, "02T08:15"), ("bakery", 20.0, "04T10:00"), ("rent", 40.0, "06T08:15"), ("bakery", 30.0, "08T17:45"))
    night = ((1500.0, "11"), (2100.0, "14"), (2750.0, "20"))
    rows = [transfer(f"q{i}", "acc-7", payee, amount, f"2025-03-{at}:00Z") for i, (payee, amount, at) in enumerate(quiet)]
    rows += [transfer(f"s{i}", "acc-7", "drop-5", amount, f"2025-03-09T02:{at}:00Z") for i, (amount, at) in enumerate(night)]
    return rows + [
        transfer("p0", "plain", "water", 90.0, "2025-03-09T10:00:00Z"),
        transfer("p1", "plain", "water", 45.0, "2025-03-09T10:04:00Z"),
        transfer("l0", "late", "water", 310.0, "2025-03-09T23:30:00Z"),
    ]


# means before the payments: 130 / 4, 1630 / 5, 3730 / 6
STORY_ALERTS = [
    ("s0", "new_payee_high_value", "1500.00 to never-seen payee drop-5"),
    ("s0", "amount_spike", "1500.00 vs typical 32.50"),
    ("s0", "odd_hour", "transfer at 02:11"),
    ("s1", "amount_spike", "2100.00 vs typical 326.00"),
    ("s1", "odd_hour", "transfer at 02:14"),
    ("s2", "rapid_drain", "3 transfers in 10 min"),
    ("s2", "odd_hour", "transfer at 02:20"),
]


def test_scenario_and_replay(spark, tmp_path):
    alerts = alerts_table(spark, str(tmp_path / "alerts"))
    holds = holds_table(spark, str(tmp_path / "holds"))
    log = records(spark, drain_story())
    assert fired(spark, drain_story()) == STORY_ALERTS
    assert DT.detect(log, alerts, holds) == (10, 0, 7, 2, 7, 2)
    assert {(r.txn_id, r.rule, r.reason) for r in alerts.read().collect()} == set(STORY_ALERTS)
    held = {(r.txn_id, r.account_id, r.reason) for r in holds.read().collect()}
    assert held == {(t, "acc-7", "account under active drain alert") for t in ("s1", "s2")}
    assert DT.detect(log, alerts, holds) == (10, 0, 7, 2, 0, 0)
    assert alerts.read().count() == 7 and holds.read().count() == 2


def test_malformed_transfers_are_skipped(spark, tmp_path):
    alerts = alerts_table(spark, str(tmp_path / "alerts"))
    holds = holds_table(spark, str(tmp_path / "holds"))
    rows = [transfer("ok"), {"txn_id": "bad"}, "nonsense"]
    assert DT.detect(records(spark, rows), alerts, holds) == (1, 2, 0, 0, 0, 0)


def test_copies_of_a_transfer_count_but_record_once(spark, tmp_path):
    alerts = alerts_table(spark, str(tmp_path / "alerts"))
    holds = holds_table(spark, str(tmp_path / "holds"))
    rows = [transfer("same")] * 5
    assert DT.detect(records(spark, rows), alerts, holds) == (5, 0, 3, 2, 1, 1)
    assert alerts.read().first().reason == "3 transfers in 10 min"


def random_transfers(seed, n=300, accounts=5):
    rng = random.Random(seed)
    rows, base = [], 1_780_000_000
    for i in range(n):
        heavy = rng.random() < 0.35
        when = base + rng.choice([0, 0, 60, 600, 601, 3600]) * rng.randrange(6) + rng.randrange(3)
        rows.append({
            "offset": i * rng.choice([1, 1, 1]) , "txn_id": f"x{rng.randrange(n)}",
            "account_id": "whale" if heavy else f"a{rng.randrange(accounts)}",
            "payee_id": f"p{rng.randrange(8)}",
            "amount": rng.choice([1.0, 20.0, 99.99, 1000.0, 2400.0, 0.1, 0.2, 1234567.891]),
            "ts": when * 1_000_000, "timestamp": str(when),
            "hour": (when // 3600) % 24, "minute": (when // 60) % 60,
        })
    return rows


COLUMNS = ("offset long, txn_id string, account_id string, payee_id string, amount double, "
           "timestamp string, ts long, hour int, minute int")


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("skew", [SkewParams(), SMALL, SkewParams(0, 100, 3, 1 << 16)])
def test_against_the_model(spark, seed, skew):
    rows = random_transfers(seed)
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], COLUMNS)
    scored = DT.score_transfers(df, DetectorParams(), skew).cache()
    got = {r.offset: r for r in scored.collect()}
    assert len(got) == len(rows)
    for t, f in model.features(rows):
        row = got[t["offset"]].asDict()
        assert {k: row[k] for k in f} == f | {
            "win_total": pytest.approx(f["win_total"], abs=1e-9),
            "hist_mean": f["hist_mean"] and pytest.approx(f["hist_mean"], abs=1e-9),
        }
    alerts, holds = model.run(rows)
    found = fired_rules(scored).orderBy("offset", "rule_order").collect()
    assert [(r.offset, r.txn_id, r.rule, r.reason) for r in found] == alerts
    held = DT.holds_of(scored, skew).orderBy("offset").collect()
    assert [(r.offset, r.txn_id, r.reason) for r in held] == holds
    first = {}
    for _, txn, rule, reason in alerts:
        first.setdefault((txn, rule), reason)
    kept = DT.recorded_alerts(scored).collect()
    assert {(r.txn_id, r.rule): r.reason for r in kept} == first and len(kept) == len(first)
    assert DT.recorded_holds(scored, skew).count() == len({txn for _, txn, _ in holds})


def test_one_shuffle_for_small_accounts(spark):
    df = spark.createDataFrame([], COLUMNS)
    plan = small_account_features(df, DetectorParams())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "BroadcastNestedLoopJoin" not in plan


def test_rules_of_your_own(spark):
    big = Rule("round_sum", lambda p: (F.col("amount") % 500 == 0, F.lit("round")))
    rows = [transfer("r1", amount=1500), transfer("r2", amount=1501, at="13:00:00Z")]
    typed = DT.typed_transfers(records(spark, rows)).where("ok").drop("ok")
    found = fired_rules(score(features(typed), rules=(*RULES, big))).collect()
    assert [(r.txn_id, r.rule) for r in found if r.rule == "round_sum"] == [("r1", "round_sum")]


def test_huge_amounts_do_not_disturb_others(spark):
    rows = [transfer("a", "x", amount=1e15), transfer("b", "y", amount=4999.99),
            transfer("c", "y", amount=0.01, at="12:01:00Z"), transfer("d", "z", amount=1e300)]
    hits = [(t, r) for t, rule, r in fired(spark, rows) if rule == "rapid_drain"]
    assert hits[0] == ("a", "1000000000000000.00 moved in 10 min")
    assert [t for t, _ in hits] == ["a", "d"]


def test_totals_above_the_exact_range_are_each_accounts_own(spark):
    for neighbour in (1e30, float("inf")):
        rows = [transfer("n1", "a", amount=neighbour), transfer("b1", "b", amount=2e12),
                transfer("b2", "b", amount=2e12, at="12:01:00Z"),
                transfer("b3", "b", amount=1e30, at="11:00:00Z"),
                transfer("b4", "b", amount=2e12, at="12:02:00Z")]
        df = spark.createDataFrame(
            [(i, r["txn_id"], r["account_id"], r["payee_id"], r["amount"], r["timestamp"])
             for i, r in enumerate(rows)],
            "offset bigint, txn_id string, account_id string, payee_id string, amount double, "
            "timestamp string",
        )
        stamp = F.col("timestamp").cast("timestamp")
        df = df.withColumn("ts", F.unix_micros(stamp)).withColumn("hour", F.lit(12))
        df = df.withColumn("minute", F.lit(0))
        for skew in (SkewParams(), SkewParams(hot_rows=0, block_rows=2, slices=2)):
            got = {r.txn_id: r.win_total for r in features(df, skew=skew).collect()}
            assert got["b1"] == 2e12 and got["b2"] == 4e12 and got["b4"] == 6e12
            assert got["b3"] == 1e30 and got["n1"] == neighbour


def test_money_text_rounds_like_the_exact_value(spark):
    from sluiceway.operators.rules import _money

    rng = random.Random(5)
    values = [0.125, 0.375, 2.675, 1.005, 0.005, 5000.015, 1e12 + 0.125, 20.1, 316.75, 1.115]
    values += [rng.randrange(10**6) / 1000 for _ in range(3000)]
    values += [rng.random() * 10 ** rng.randrange(8) for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", _money(F.col("v")).alias("s"))
    assert [(r.v, r.s) for r in df.collect() if r.s != f"{r.v:.2f}"] == []
