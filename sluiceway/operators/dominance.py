"""Counting and adding up earlier arrivals inside a range, for rows already in order.

These run inside tasks on Arrow batches Spark has partitioned and sorted. Nothing
here lists pairs of rows: cost is n for rows that arrived in event-time order and
n log n for the stretches that did not.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Amounts are added as whole millionths split in two limbs, so sums of any length
# are exact. What a double holds beyond millionths goes to `fine`, the part above
# LARGEST to `huge`; both are zero for ordinary money.
LARGEST = 1e12
LIMB = 1 << 32
SUMS = ("cnt", "hi", "lo", "fine", "huge")


def split_amounts(amount: np.ndarray) -> list[np.ndarray]:
    """The five additive parts of each amount, in the order of SUMS."""
    kept = np.minimum(amount, LARGEST)
    micros = np.rint(kept * 1e6).astype(np.int64)
    return [
        np.ones(len(amount), np.int64),
        micros // LIMB,
        micros % LIMB,
        kept - micros / 1e6,
        amount - kept,
    ]


def _before(weight: np.ndarray) -> np.ndarray:
    """sums[i] = weight[0] + ... + weight[i-1], one longer than weight."""
    sums = np.zeros(len(weight) + 1, weight.dtype)
    np.cumsum(weight, out=sums[1:])
    return sums


def _spans(weight: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each query: the sum over start <= j < end, from rows of that range alone.

    Whole numbers are differences of running sums. With doubles a huge row before the
    range would swallow the digits of those in it, so they are added up as a tree of
    pairs and each query takes the nodes that make up its range.
    """
    if weight.dtype.kind != "f":
        sums = _before(weight)
        return sums[end] - sums[start]
    total = np.zeros(len(start))
    if not weight.any():
        return total
    low, high = start.copy(), np.maximum(start, end)
    with np.errstate(over="ignore"):
        while (low < high).any():
            left = (low & 1 == 1) & (low < high)
            total[left] += weight[low[left]]
            low += left
            right = (high & 1 == 1) & (low < high)
            high -= right
            total[right] += weight[high[right]]
            low >>= 1
            high >>= 1
            if len(weight) & 1:
                weight = np.append(weight, 0.0)
            weight = weight[::2] + weight[1::2]
    return total


def _descend(
    key: np.ndarray, weights: list[np.ndarray], start: np.ndarray, end: np.ndarray
) -> list[np.ndarray]:
    """For each query (start, end): sums over start <= j < end with key[j] < key[end].

    Halves the range of keys once per bit: at each step the rows whose key has a 0 in
    the bit are moved to the front, keeping their order, and a query whose own key has
    a 1 there collects the 0 rows of its range.
    """
    n = len(key)
    rank = np.empty(n, np.int64)
    # Among equal keys the later row ranks lower, so equal keys never count.
    rank[np.lexsort((-np.arange(n), key))] = np.arange(n)
    own = rank[end]
    found = [np.zeros(len(end), w.dtype) for w in weights]
    for bit in reversed(range(max(n - 1, 1).bit_length())):
        low = (rank >> bit) & 1 == 0
        lows = _before(low.astype(np.int64))
        at_start, at_end = lows[start], lows[end]
        takes = (own >> bit) & 1 == 1
        for total, weight in zip(found, weights):
            total[takes] += _spans(np.where(low, weight, 0), start[takes], end[takes])
        start = np.where(takes, lows[-1] + start - at_start, at_start)
        end = np.where(takes, lows[-1] + end - at_end, at_end)
        moved = np.concatenate([np.flatnonzero(low), np.flatnonzero(~low)])
        rank = rank[moved]
        weights = [w[moved] for w in weights]
    return found


def range_sums(
    weights: list[np.ndarray], start: np.ndarray, end: np.ndarray
) -> list[np.ndarray]:
    """For each query: sums over start <= j < end."""
    return [_spans(w, start, end) for w in weights]


def earlier_sums(
    key: np.ndarray, start: np.ndarray, weights: list[np.ndarray]
) -> list[np.ndarray]:
    """For each row i: sums of weights over rows start[i] <= j < i with key[j] < key[i]."""
    n = len(key)
    here = np.arange(n)
    found = range_sums(weights, start, here)
    drops = np.zeros(n, np.int64)
    drops[1:] = np.cumsum(key[1:] <= key[:-1])
    mixed = np.flatnonzero(drops != drops[start])
    if len(mixed):
        # Only the rows some out-of-order range covers take part.
        edges = np.zeros(n + 1, np.int64)
        np.add.at(edges, start[mixed], 1)
        np.add.at(edges, mixed + 1, -1)
        covered = np.cumsum(edges[:-1]) > 0
        place = _before(covered.astype(np.int64))
        live = [i for i, w in enumerate(weights) if w[covered].any()]
        sums = _descend(
            key[covered],
            [weights[i][covered] for i in live],
            place[start[mixed]],
            place[here[mixed]],
        )
        for i, s in zip(live, sums):
            found[i][mixed] = s
    return found


def window_starts(first: np.ndarray, ts: np.ndarray, width: int) -> np.ndarray:
    """For each row, the first row of its group no more than `width` before it.

    `first` marks where groups begin, `ts` ascends inside a group. Gaps wider than the
    window are shortened to just over it, which changes no answer and lets one
    ascending sequence hold all groups.
    """
    n = len(ts)
    if n * (width + 1) < 1 << 62:
        gap = np.minimum(np.diff(ts, prepend=ts[:1]), width + 1)
        gap[first] = width + 1
        line = np.cumsum(gap)
        return np.searchsorted(line, line - width, "left")
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], n)
    return np.concatenate(
        [s + np.searchsorted(ts[s:e], ts[s:e] - width, "left") for s, e in zip(starts, ends)]
    )


def group_firsts(table: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    """True where any key differs from the row above."""
    first = np.zeros(table.num_rows, bool)
    first[:1] = True
    for name in keys:
        column = table.column(name).combine_chunks()
        if len(column) > 1:
            first[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return first


def whole_groups(
    batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rows: int
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about `rows` rows that never cut a group, with their group starts."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        first = group_firsts(table, keys)
        cut = int(np.flatnonzero(first)[-1])
        if cut:
            yield table.slice(0, cut), first[:cut]
            table = table.slice(cut)
        held, size = table.to_batches(), table.num_rows
        # A group larger than this is gathered in doubling steps.
        rows = max(rows, 2 * size)
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, group_firsts(table, keys)


def fixed_slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of exactly `rows` rows, the last one shorter."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - size)
            batch = batch.slice(part.num_rows)
            held.append(part)
            size += part.num_rows
            if size == rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def append_columns(table: pa.Table, columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for name, values in columns.items():
        table = table.append_column(name, pa.array(values))
    yield from table.to_batches(max_chunksize=1 << 16)


def _group_start(first: np.ndarray) -> np.ndarray:
    return np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))


def account_windows(width: int, rows: int):
    """Task function: rows by (account, ts, offset) -> the same rows and their SUMS.

    The sums are over the account's earlier arrivals no more than `width` back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in whole_groups(batches, ("account_id",), rows):
            ts = numbers(table, "ts")
            found = earlier_sums(
                numbers(table, "offset"),
                window_starts(first, ts, width),
                split_amounts(numbers(table, "amount")),
            )
            yield from append_columns(table, dict(zip(SUMS, found)))

    return run


def _point_weights(table: pa.Table) -> list[np.ndarray]:
    point = numbers(table, "point")
    return [np.where(point, w, 0) for w in split_amounts(numbers(table, "amount"))]


def slice_sums(group: tuple[str, ...], rows: int):
    """Task function: items in (group, x, offset) order, cut into slices of `rows`.

    Adds each item's SUMS over earlier points of its group and slice with a smaller
    offset, the slice number, and whether the group may go on in another slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in enumerate(fixed_slices(batches, rows)):
            first = group_firsts(table, group)
            start = _group_start(first)
            found = earlier_sums(numbers(table, "offset"), start, _point_weights(table))
            edge = (start == 0) | (start == start[-1])
            slice_id = numbers(table, "part") * (1 << 32) + number
            added = dict(zip(SUMS, found))
            yield from append_columns(
                table.drop_columns(["part"]), {**added, "slice": slice_id, "edge": edge}
            )

    return run


def group_sums(group: tuple[str, ...], rows: int):
    """Task function: as `slice_sums` for items of which no group is cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in whole_groups(batches, group, rows):
            found = earlier_sums(
                numbers(table, "offset"), _group_start(first), _point_weights(table)
            )
            none = np.zeros(len(first), np.int64)
            added = {**dict(zip(SUMS, found)), "slice": none, "edge": none > 0}
            yield from append_columns(table.drop_columns(["part"]), added)

    return run


def block_sums(group: tuple[str, ...], rows: int):
    """Task function: items in (group, offset) order -> SUMS over points of the group
    that have a smaller offset and lie in an earlier slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in whole_groups(batches, group, rows):
            found = earlier_sums(
                numbers(table, "slice"), _group_start(first), _point_weights(table)
            )
            asked = numbers(table, "query")
            out = pa.table({"offset": table.column("offset")})
            for name, values in zip(SUMS, found):
                out = out.append_column(name, pa.array(values))
            yield from out.filter(pa.array(asked)).to_batches()

    return run


# Workers get these functions by value, wherever the package is installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
