"""A plain reading of the detector's rules, one transfer at a time, to test against."""

from collections import defaultdict
from decimal import Decimal

from sluiceway.config import HOLD_REASON, DetectorParams


def features(transfers, params=DetectorParams()):
    """transfers: dicts with offset, account_id, payee_id, amount, ts. Yields feature dicts."""
    past = defaultdict(list)
    for t in sorted(transfers, key=lambda t: t["offset"]):
        h = past[t["account_id"]]
        near = [p for p in h if t["ts"] - params.window_micros <= p["ts"] <= t["ts"]]
        total = sum((Decimal(repr(p["amount"])) for p in [*near, t]), Decimal(0))
        mean = float(sum(Decimal(repr(p["amount"])) for p in h)) / len(h) if h else None
        yield t, {
            "win_count": len(near) + 1,
            "win_total": float(total),
            "hist_count": len(h),
            "hist_mean": mean,
            "payee_first": all(p["payee_id"] != t["payee_id"] for p in h),
        }
        h.append(t)


def run(transfers, params=DetectorParams()):
    """-> (alerts [(offset, txn, rule, reason)], holds [(offset, txn, reason)])."""
    alerts, holds, flagged = [], [], set()
    for t, f in features(transfers, params):
        was = t["account_id"] in flagged
        hits = []
        if f["win_count"] >= params.max_count:
            hits.append(
                ("rapid_drain", f"{f['win_count']} transfers in {params.window_minutes} min"))
        elif f["win_total"] > params.max_amount:
            hits.append(
                ("rapid_drain", f"{f['win_total']:.2f} moved in {params.window_minutes} min"))
        if f["payee_first"] and t["amount"] >= params.payee_threshold:
            hits.append(
                ("new_payee_high_value",
                 f"{t['amount']:.2f} to never-seen payee {t['payee_id']}"))
        if (f["hist_count"] >= params.min_history and f["hist_mean"] > 0
                and t["amount"] > params.spike_factor * f["hist_mean"]):
            hits.append(("amount_spike", f"{t['amount']:.2f} vs typical {f['hist_mean']:.2f}"))
        if params.start_hour <= t["hour"] < params.end_hour:
            hits.append(("odd_hour", f"transfer at {t['hour']:02d}:{t['minute']:02d}"))
        alerts += [(t["offset"], t["txn_id"], rule, reason) for rule, reason in hits]
        if hits:
            flagged.add(t["account_id"])
        if was:
            holds.append((t["offset"], t["txn_id"], HOLD_REASON))
    return alerts, holds
