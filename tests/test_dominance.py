"""The in-task sums against a plain double loop."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from sluiceway.operators import dominance as D


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 30), st.integers(0, 8)), max_size=60))
def test_earlier_sums(rows):
    key = np.array([k for k, _, _ in rows], np.int64)
    start = np.array([min(s, i) for i, (_, s, _) in enumerate(rows)], np.int64)
    weight = np.array([w for _, _, w in rows], np.int64)
    got = D.earlier_sums(key, start, [weight, weight / 8.0])
    want = [
        sum(int(weight[j]) for j in range(start[i], i) if key[j] < key[i]) for i in range(len(rows))
    ]
    assert got[0].tolist() == want
    assert np.allclose(got[1], np.array(want) / 8.0)


@settings(max_examples=200, deadline=None)
@given(
    st.lists(
        st.tuples(
            st.integers(0, 9), st.integers(0, 30), st.sampled_from([0.0, 2e12, 1e30, np.inf])
        ),
        max_size=60,
    )
)
def test_doubles_outside_a_range_leave_no_trace(rows):
    key = np.array([k for k, _, _ in rows], np.int64)
    start = np.array([min(s, i) for i, (_, s, _) in enumerate(rows)], np.int64)
    weight = np.array([w for _, _, w in rows], float)
    (got,) = D.earlier_sums(key, start, [weight])
    for i in range(len(rows)):
        want = sum(weight[j] for j in range(start[i], i) if key[j] < key[i])
        assert got[i] == want or abs(got[i] - want) <= 1e-14 * want


@given(
    st.lists(st.tuples(st.integers(0, 3), st.integers(-50, 50)), min_size=1, max_size=60),
    st.sampled_from([0, 1, 7, 10**6, 10**18]),
)
def test_window_starts(rows, width):
    rows = sorted(rows)
    group = np.array([g for g, _ in rows])
    ts = np.array([t for _, t in rows], np.int64)
    first = np.append(True, group[1:] != group[:-1])
    want = [
        min(j for j in range(len(rows)) if group[j] == group[i] and ts[j] >= ts[i] - width)
        for i in range(len(rows))
    ]
    assert D.window_starts(first, ts, width).tolist() == want


@given(st.lists(st.integers(0, 4), max_size=50), st.integers(1, 9), st.integers(1, 12))
def test_groups_are_never_cut(keys, batch, rows):
    keys = sorted(keys)
    batches = pa.table({"k": pa.array(keys, pa.int64())}).to_batches(max_chunksize=batch)
    out = list(D.whole_groups(iter(batches), ("k",), rows))
    values = [t.column("k").to_pylist() for t, _ in out]
    assert [k for v in values for k in v] == keys
    seen = [set(v) for v in values]
    assert sum(len(s) for s in seen) == len(set(keys))
    for (_, first), v in zip(out, values):
        assert first.tolist() == [i == 0 or v[i] != v[i - 1] for i in range(len(v))]


@given(st.integers(0, 40), st.integers(1, 9), st.integers(1, 12))
def test_slices_are_full(n, batch, rows):
    batches = pa.table({"k": pa.array(range(n), pa.int64())}).to_batches(max_chunksize=batch)
    out = [t.column("k").to_pylist() for t in D.fixed_slices(iter(batches), rows)]
    assert [k for v in out for k in v] == list(range(n))
    assert all(len(v) == rows for v in out[:-1])


def test_ordinary_money_has_no_remainder():
    amounts = np.round(np.random.default_rng(1).uniform(0.01, 1e7, 20000), 2)
    _, hi, lo, fine, huge = D.split_amounts(amounts)
    assert not fine.any() and not huge.any()
    assert ((hi * D.LIMB + lo) / 1e6 == amounts).all()
    _, hi, lo, fine, huge = D.split_amounts(np.array([1e300, 1e-9, np.inf]))
    assert huge[0] == 1e300 and fine[1] == 1e-9 and huge[2] == np.inf
