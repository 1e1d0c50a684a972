"""What each transfer's account had done before it arrived.

Input is a frame of valid transfers: offset, txn_id, account_id, payee_id, amount,
timestamp, ts (microseconds), hour, minute. "Before" means a smaller log offset; the
trailing window is event time, both ends included.

Most accounts are small: their rows meet in one task, once, and Spark windows and one
ordered pass give the features. An account too large for that (`SkewParams`) goes
another way with the same answers: its history is cut into blocks of consecutive
offsets, each block is summed, and only block totals are carried forward.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from sluiceway.config import DetectorParams, SkewParams
from sluiceway.operators.analytics import MONEY
from sluiceway.operators import dominance as D
from sluiceway.operators.rules import ALL_FEATURES
from sluiceway.sources.staging import stage

# Rows a task works on at a time.
TASK_ROWS = 1 << 18
# Tasks a large account is dealt to where its name is not broadcast.
SALTS = 64

_SUM_TYPES = {"cnt": "bigint", "hi": "bigint", "lo": "bigint", "fine": "double", "huge": "double"}


def hot_accounts(transfers: DataFrame, skew: SkewParams) -> DataFrame:
    """(account_id): the accounts to split, written out; by counting, few beside the rows."""
    sizes = transfers.groupBy("account_id").count().where(F.col("count") > skew.hot_rows)
    return stage(sizes.select("account_id"), "large-names")


def _plus_sums(schema: T.StructType) -> T.StructType:
    extra = [T.StructField(n, T.LongType() if k == "bigint" else T.DoubleType())
             for n, k in _SUM_TYPES.items()]
    return T.StructType([*schema.fields, *extra])


def _with_window(df: DataFrame) -> DataFrame:
    """Turn the five partial sums of earlier transfers into win_count and win_total."""
    millionths = F.col("hi").cast("double") * float(D.LIMB) + F.col("lo").cast("double")
    return (
        df.withColumn("_earlier", millionths)
        .withColumn("win_count", (F.col("cnt") + 1).cast("bigint"))
        .withColumn("win_total", _total("_earlier"))
        .drop("_earlier", *D.SUMS)
    )


def _total(earlier: str) -> Column:
    own = F.least(F.col("amount"), F.lit(D.LARGEST))
    own_millionths = F.rint(own * 1e6)
    return (
        (F.col(earlier) + own_millionths) / 1e6
        + (F.col("fine") + (own - own_millionths / 1e6))
        + (F.col("huge") + (F.col("amount") - own))
    )


def exact_part(amount: Column) -> Column:
    return amount.try_cast(MONEY)


def rest_part(amount: Column) -> Column:
    return amount - F.coalesce(exact_part(amount).cast("double"), F.lit(0.0))


def _mean(exact: Column, rest: Column, count: Column) -> Column:
    total = F.coalesce(exact.cast("double"), F.lit(0.0)) + F.coalesce(rest, F.lit(0.0))
    return F.when(count > 0, total / count)


def small_account_features(
    transfers: DataFrame, params: DetectorParams, needed: frozenset[str] = ALL_FEATURES
) -> DataFrame:
    """One shuffle by account; every step after it keeps that partitioning."""
    df = transfers.repartition("account_id")
    arrival = W.partitionBy("account_id").orderBy("offset")
    if "payee" in needed:
        to_payee = W.partitionBy("account_id", "payee_id").orderBy("offset")
        df = df.withColumn("payee_first", F.row_number().over(to_payee) == 1)
    if "history" in needed:
        earlier = arrival.rowsBetween(W.unboundedPreceding, -1)
        df = (
            df.withColumn("_exact", F.sum(exact_part(F.col("amount"))).over(earlier))
            .withColumn("_rest", F.sum(rest_part(F.col("amount"))).over(earlier))
            .withColumn("hist_count", F.count("amount").over(earlier))
            .withColumn(
                "hist_mean", _mean(F.col("_exact"), F.col("_rest"), F.col("hist_count"))
            )
            .drop("_exact", "_rest")
        )
    if "window" in needed:
        df = df.sortWithinPartitions("account_id", "ts", "offset").mapInArrow(
            D.account_windows(params.window_micros, TASK_ROWS), _plus_sums(df.schema)
        )
        df = _with_window(df)
    return df


def _block(skew: SkewParams) -> Column:
    return F.expr(f"offset div {skew.block_rows}L")


def _large_history(
    rows: DataFrame, skew: SkewParams, totals_after: DataFrame | None = None
) -> DataFrame:
    """Running count and mean by blocks: within a block, plus the blocks before it.

    `totals_after` (account_id, cnt, exact, rest) are an account's totals with these rows
    and all that arrived before them; the latter count as a block before the first.
    """
    keys = ["account_id", "_blk"]
    blocked = (
        rows.withColumn("_blk", _block(skew))
        .withColumn("_e", exact_part(F.col("amount")))
        .withColumn("_r", rest_part(F.col("amount")))
    )
    totals = blocked.groupBy(*keys).agg(
        F.count("*").alias("_n0"), F.sum("_e").alias("_e0"), F.sum("_r").alias("_r0")
    )
    blocks_before = W.partitionBy("account_id").orderBy("_blk").rowsBetween(
        W.unboundedPreceding, -1
    )
    if totals_after is not None:
        here = totals.groupBy("account_id").agg(*(F.sum(c).alias(c) for c in ("_n0", "_e0", "_r0")))
        earlier = here.join(totals_after, "account_id").select(
            "account_id",
            F.lit(-1).cast("bigint").alias("_blk"),
            (F.col("cnt") - F.col("_n0")).alias("_n0"),
            (F.col("exact") - F.col("_e0")).alias("_e0"),
            (F.col("rest") - F.col("_r0")).alias("_r0"),
        )
        totals = totals.unionByName(earlier)
    carried = totals.select(
        *keys,
        *(
            F.coalesce(F.sum(c).over(blocks_before), F.lit(0)).alias(c)
            for c in ("_n0", "_e0", "_r0")
        ),
    )
    inside = W.partitionBy(*keys).orderBy("offset").rowsBetween(W.unboundedPreceding, -1)
    count = F.col("_n") + F.col("_n0")
    return (
        blocked.withColumn("_n", F.count("*").over(inside))
        .withColumn("_e", F.coalesce(F.sum("_e").over(inside), F.lit(0)))
        .withColumn("_r", F.coalesce(F.sum("_r").over(inside), F.lit(0.0)))
        .join(carried, keys)
        .withColumn("hist_count", count)
        .withColumn(
            "hist_mean",
            _mean(F.col("_e") + F.col("_e0"), F.col("_r") + F.col("_r0"), F.col("hist_count")),
        )
        .select(*rows.columns, "hist_count", "hist_mean")
    )


def _first_payments(rows: DataFrame) -> DataFrame:
    """(offset, payee_first): the offsets at which an account pays a payee first."""
    return (
        rows.groupBy("account_id", "payee_id")
        .agg(F.min("offset").alias("offset"))
        .select("offset", F.lit(True).alias("payee_first"))
    )


def _large_window(rows: DataFrame, params: DetectorParams, skew: SkewParams) -> DataFrame:
    """(offset, five sums) over the trailing window, for accounts of any size.

    Time is cut into buckets as wide as the window, so a transfer looks at its own
    bucket up to its own time and at the bucket before it from its time less the
    window. Both are the same question when the second is read backwards in time:
    which points of the group come no later on the time axis and have a smaller
    offset. Items are range-sorted by (group, time, offset) and cut into slices of
    bounded size; a point counts for a query

      - in the same slice: found inside the slice;
      - in an earlier slice, same block of offsets: found inside the block;
      - in an earlier slice and an earlier block: counts per (slice, block) cell,
        added up over both directions.

    Only groups that may run over a slice boundary need the last two.
    """
    width = params.window_micros
    group = ("account_id", "bucket", "backwards")
    items = _window_items(rows, width)
    # At most `slices` slices besides one part-filled slice per task.
    slice_rows = max(skew.block_rows, -(-3 * rows.count() // skew.slices))
    order = (*group, "x", "offset")
    placed = (
        items.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id().cast("bigint"))
    )
    schema = _plus_sums(items.schema)
    schema = schema.add("slice", T.LongType()).add("edge", T.BooleanType())
    sliced = stage(placed.mapInArrow(D.slice_sums(group, slice_rows), schema), "slices")
    sliced = sliced.withColumn("blk", _block(skew))

    edge = sliced.where("edge").drop(*D.SUMS)
    by_block = (*group, "blk")
    same_block = (
        edge.repartition(*by_block)
        .sortWithinPartitions(*by_block, "offset")
        .mapInArrow(
            D.block_sums(by_block, TASK_ROWS),
            ", ".join(["offset bigint", *(f"{n} {k}" for n, k in _SUM_TYPES.items())]),
        )
    )

    # One row per (slice, block) cell. The slices of edge groups are few by
    # construction, two groups per slice at most, so they can be broadcast.
    weights = dict(zip(D.SUMS, _amount_parts()))
    cells = edge.where("point").groupBy(*group, "slice", "blk").agg(
        *(F.sum(w).alias(n) for n, w in weights.items())
    )
    slices = edge.select(*group, "slice").distinct()
    blocks = edge.select(*group, "blk").distinct()
    grid = blocks.join(F.broadcast(slices), list(group)).join(
        cells, [*group, "slice", "blk"], "left"
    )
    for fixed, along in (("slice", "blk"), ("blk", "slice")):
        before = W.partitionBy(*group, fixed).orderBy(along).rowsBetween(W.unboundedPreceding, -1)
        grid = grid.select(
            *group, "slice", "blk",
            *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in D.SUMS),
        )
    elsewhere = edge.where("query").join(
        grid.where(F.col("cnt") > 0), [*group, "slice", "blk"]
    )

    def parts(df: DataFrame) -> DataFrame:
        return df.select(
            "offset",
            "cnt",
            *(F.col(n).cast("decimal(38,0)").alias(n) for n in ("hi", "lo")),
            "fine",
            "huge",
        )

    found = parts(sliced.where("query")).unionByName(parts(same_block)).unionByName(
        parts(elsewhere)
    )
    return found.groupBy("offset").agg(*(F.sum(n).alias(n) for n in D.SUMS))


def time_bucket(width: int) -> Column:
    return F.expr(f"(ts - pmod(ts, {width}L)) div {width}L")


def _window_items(rows: DataFrame, width: int) -> DataFrame:
    """What `_large_window` asks: each row as a point both ways and as both its queries."""

    def item(bucket: Column, backwards: bool, x: Column, point: bool, query: bool) -> Column:
        return F.struct(
            bucket.alias("bucket"), F.lit(backwards).alias("backwards"), x.alias("x"),
            F.lit(point).alias("point"), F.lit(query).alias("query"),
        )

    return rows.withColumn("_b", time_bucket(width)).select(
        "account_id", "offset", "amount",
        F.inline(F.array(
            item(F.col("_b"), False, F.col("ts"), True, True),
            item(F.col("_b"), True, -F.col("ts"), True, False),
            item(F.col("_b") - 1, True, width - F.col("ts"), False, True),
        )),
    )


def _bucket_window(rows: DataFrame, earlier: DataFrame, params: DetectorParams) -> DataFrame:
    """(offset, five sums) over the trailing window, by (account, time bucket).

    `earlier` (account_id, offset, amount, ts) are points that arrived before `rows`, of
    all buckets the rows look at. One bucket's rows meet in one task.
    """
    width = params.window_micros
    group = ("account_id", "bucket", "backwards")
    past = _window_items(earlier, width).where("point").withColumn("query", F.lit(False))
    items = _window_items(rows, width).unionByName(past)
    schema = _plus_sums(items.schema).add("slice", T.LongType()).add("edge", T.BooleanType())
    found = (
        items.repartition(*group)
        .sortWithinPartitions(*group, "x", "offset")
        .withColumn("part", F.lit(0).cast("bigint"))
        .mapInArrow(D.group_sums(group, TASK_ROWS), schema)
    )
    return found.where("query").groupBy("offset").agg(*(F.sum(n).alias(n) for n in D.SUMS))


def features_after(
    rows: DataFrame,
    totals_after: DataFrame,
    first_payments: DataFrame,
    earlier: DataFrame,
    params: DetectorParams = DetectorParams(),
    skew: SkewParams = SkewParams(),
) -> DataFrame:
    """The features of rows that arrive after others of which only a digest is kept.

    `totals_after`: see `_large_history`; `first_payments` (offset): the rows that pay a
    payee first; `earlier`: see `_bucket_window`. No task holds all rows of an account.
    """
    first = first_payments.select("offset", F.lit(True).alias("payee_first"))
    df = _large_history(rows, skew, totals_after)
    df = df.join(first, "offset", "left").withColumn(
        "payee_first", F.coalesce("payee_first", F.lit(False))
    )
    return _with_window(df.join(_bucket_window(rows, earlier, params), "offset"))


def _amount_parts() -> list[Column]:
    """The same five parts as `dominance.split_amounts`, as columns."""
    kept = F.least(F.col("amount"), F.lit(D.LARGEST))
    micros = F.rint(kept * 1e6).cast("bigint")
    return [
        F.lit(1).cast("bigint"),
        F.shiftright(micros, 32).cast("decimal(20,0)"),
        F.pmod(micros, F.lit(D.LIMB)).cast("decimal(20,0)"),
        kept - micros / F.lit(1e6),
        F.col("amount") - kept,
    ]


def large_account_features(
    transfers: DataFrame,
    params: DetectorParams,
    skew: SkewParams,
    needed: frozenset[str] = ALL_FEATURES,
) -> DataFrame:
    rows = stage(transfers, "large-accounts")
    df = rows
    if "history" in needed:
        df = _large_history(df, skew)
    if "payee" in needed:
        df = df.join(_first_payments(rows), "offset", "left").withColumn(
            "payee_first", F.coalesce("payee_first", F.lit(False))
        )
    if "window" in needed:
        df = _with_window(df.join(_large_window(rows, params, skew), "offset"))
    return df


class Split(NamedTuple):
    """Rows of ordinary accounts, rows of those too large for a task, and their names."""

    small: DataFrame
    large: DataFrame | None
    names: DataFrame | None


def _salted(rows: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with a salt: a row has one, a name has every one."""
    salts = F.explode(F.sequence(*(F.lit(n).cast("bigint") for n in (0, SALTS - 1))))
    return (
        rows.withColumn("_salt", F.pmod(F.xxhash64("offset"), F.lit(SALTS))),
        names.select("*", salts.alias("_salt")),
        ["account_id", "_salt"],
    )


def split_by_size(rows: DataFrame, skew: SkewParams) -> Split:
    """Up to `hot_keys` names are broadcast. More are joined by shuffle, each name once for
    every salt, so that no task meets all rows of an account either way."""
    names = hot_accounts(rows, skew)
    n = names.count()
    if not n:
        return Split(rows, None, None)
    if n <= skew.hot_keys:
        here, keys = F.broadcast(names), ["account_id"]
    else:
        rows, here, keys = _salted(rows, names)
    return Split(
        rows.join(here, keys, "left_anti").drop("_salt"),
        rows.join(here, keys, "left_semi").drop("_salt"),
        names,
    )


def meet_large(large: DataFrame, facts: DataFrame, skew: SkewParams) -> DataFrame:
    """Rows of large accounts joined with one row of facts for each account that has some."""
    facts = stage(facts, "large-facts")
    if facts.count() <= skew.hot_keys:
        return large.join(F.broadcast(facts), "account_id")
    large, facts, keys = _salted(large, facts)
    return large.join(facts, keys).drop("_salt")


def features(
    transfers: DataFrame,
    params: DetectorParams = DetectorParams(),
    skew: SkewParams = SkewParams(),
    needed: frozenset[str] = ALL_FEATURES,
) -> DataFrame:
    """The frame rules are written against, one row per transfer."""
    small, large, _ = split_by_size(transfers, skew)
    out = small_account_features(small, params, needed)
    if large is None:
        return out
    return out.unionByName(large_account_features(large, params, skew, needed))
