"""What detection keeps of all transfers so far, as a streaming aggregation.

A transfer takes part in four kinds of digest, each with a key of its own, so that the
rows of one account are spread over many keys:

    total   (account)               count and sums
    payee   (account, payee)        the first offset
    window  (account, time bucket)  the points of a stretch as wide as the trailing window
    commit  (commit of the log)     that the micro-batch took it

Totals, payees and commits are combined before the shuffle, so a task meets an account once
from each task before it, however many rows it has. Nothing expires: a transfer may arrive
arbitrarily late and still count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sluiceway.config import DetectorParams
from sluiceway.operators.history import exact_part, rest_part, time_bucket

KEY = ("role", "account_id", "payee_id", "bucket")


def _role(name: str, account: Column, payee: Column, bucket: Column, point: bool) -> Column:
    return F.struct(
        F.lit(name).alias("role"), account.alias("account_id"), payee.alias("payee_id"),
        bucket.cast("bigint").alias("bucket"), F.lit(point).alias("point"),
    )


def digests(transfers: DataFrame, params: DetectorParams) -> DataFrame:
    """A stream of valid transfers with `batch_id` -> its digests, for update mode.

    A transfer looks at its own time bucket and at the one before, so both are touched and
    come out with all their points.
    """
    account, nobody, no_bucket = F.col("account_id"), F.lit(""), F.lit(0)
    bucket = F.col("_bucket")
    roles = transfers.withColumn("_bucket", time_bucket(params.window_micros)).select(
        "offset", "ts", "amount",
        F.inline(F.array(
            _role("total", account, nobody, no_bucket, False),
            _role("payee", account, F.col("payee_id"), no_bucket, False),
            _role("window", account, nobody, bucket, True),
            _role("window", account, nobody, bucket - 1, False),
            _role("commit", nobody, nobody, F.col("batch_id"), False),
        )),
    )
    total = F.col("role") == "total"
    return roles.groupBy(*KEY).agg(
        F.count_if(total).alias("cnt"),
        F.sum(F.when(total, exact_part(F.col("amount")))).alias("exact"),
        F.sum(F.when(total, rest_part(F.col("amount")))).alias("rest"),
        F.min("offset").alias("first_offset"),
        F.collect_list(F.when(F.col("point"), F.struct("offset", "ts", "amount"))).alias("points"),
    )


def totals(state: DataFrame) -> DataFrame:
    return state.where("role = 'total'").select(
        "account_id", "cnt", F.coalesce("exact", F.lit(0)).alias("exact"), "rest"
    )


def first_payments(state: DataFrame) -> DataFrame:
    """The offsets at which an account paid a payee first, of the payees touched."""
    return state.where("role = 'payee'").select(F.col("first_offset").alias("offset"))


def points_before(state: DataFrame, offset: int) -> DataFrame:
    """(account_id, offset, ts, amount) of the buckets touched."""
    points = state.where("role = 'window'").select("account_id", F.inline("points"))
    return points.where(F.col("offset") < offset)


def commits(state: DataFrame) -> DataFrame:
    return state.where("role = 'commit'").select(F.col("bucket").alias("batch_id"))
