"""Keyed tables: the first record of a key wins, however often batches are replayed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window as W, functions as F
from pyspark.sql.types import StructType

from sluiceway import schemas
from sluiceway.sources import blooms, files
from sluiceway.sources.staging import read_or_empty, stage

BUCKET = "_bucket"
#: Batches that a lookup names to the scan; of more, it reads the buckets of all.
NAMED = 1000
#: Tasks that a day's events are dealt to, so that one large day is not one task.
DAY_FILES = 8


def first_per_key(df: DataFrame, keys: tuple[str, ...], order: str = "offset") -> DataFrame:
    """The earliest row of each key.

    Spark cuts each key to its first row before the shuffle (window group limit), so
    a key with very many copies sends one row per task.
    """
    place = W.partitionBy(*keys).orderBy(order)
    return df.withColumn("_place", F.row_number().over(place)).where("_place = 1").drop("_place")


class KeyedTable:
    """Rows with unique keys, added batch by batch under `batch=<name>`.

    Running a named batch again replaces what it wrote, so its outcome does not depend
    on how often or how far it ran before. One writer inserts at a time. Beside the rows
    lies an index of Bloom filters (`sources.blooms`), one version for each insert, written
    before the rows are: it may know keys that were never stored, never the reverse.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: tuple[str, ...]):
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = schema
        self.keys = keys

    @property
    def rows_path(self) -> str:
        return f"{self.path}/rows"

    @property
    def index_path(self) -> str:
        return f"{self.path}/index"

    def read(self) -> DataFrame:
        return self._stored().select(*self.schema.names)

    def _stored(self) -> DataFrame:
        return read_or_empty(self.spark, self.rows_path, schemas.with_batch_name(self.schema, BUCKET))

    def before(self, batch: str) -> DataFrame:
        """The rows other batches wrote."""
        return self._stored().where(F.col("batch") != batch).select(*self.schema.names)

    def insert(self, df: DataFrame, order: str = "offset", batch: str | None = None) -> int:
        """Add the rows whose key is new; return how many there were.

        Stored keys are read only where a filter may have seen a new one: the batches and
        buckets of that filter. Where none has, nothing stored is read.
        """
        batch = batch or uuid.uuid4().hex
        hashed = blooms.key_hash(self.keys)
        new = stage(
            first_per_key(df, self.keys, order).select(
                *self.schema.names, hashed.alias("_hash"), blooms.bucket_of(hashed).alias(BUCKET)
            ),
            "insert",
        )
        maybe = self._judged(new, batch).where("kind = 'maybe'")
        rows = new
        if not maybe.isEmpty():
            known = self._known(maybe, batch)
            rows = new.join(known, list(self.keys), "left_anti")
        counted = Observation()
        rows = rows.observe(counted, F.count("*").alias("rows"))
        rows.sortWithinPartitions(BUCKET).select(*self.schema.names, BUCKET).write.mode(
            "overwrite"
        ).parquet(f"{self.rows_path}/batch={batch}")
        return counted.get["rows"]

    def _judged(self, new: DataFrame, batch: str) -> DataFrame:
        """What the index says of the new keys; its next version, written and published."""
        versions = files.names(self.spark, f"{self.index_path}/versions")
        last = int(versions[-1].split(".")[0]) if versions else -1
        index = (
            self.spark.read.schema(blooms.INDEX).parquet(f"{self.index_path}/filters-{last}")
            if versions
            else self.spark.createDataFrame([], blooms.INDEX)
        )
        keys = new.select(F.col(BUCKET).alias("bucket"), F.col("_hash").alias("hash"))
        target = f"{self.index_path}/filters-{last + 1}"
        blooms.judge(keys, index, batch).write.mode("overwrite").parquet(target)
        if not files.write_once(self.spark, f"{self.index_path}/versions/{last + 1:012d}.txt", batch):
            raise RuntimeError(f"two writers insert into {self.path} at once")
        files.remove(self.spark, f"{self.index_path}/filters-{last - 1}")
        return self.spark.read.schema(blooms.INDEX).parquet(target)

    def _known(self, maybe: DataFrame, batch: str) -> DataFrame:
        """Keys that other batches stored, out of those that may repeat."""
        keys = list(self.keys)
        places = maybe.select("bucket", F.explode("batches").alias("batch")).distinct()
        places = places.where(F.col("batch") != batch)
        some = [r.batch for r in places.select("batch").distinct().limit(NAMED + 1).collect()]
        buckets = [r.bucket for r in places.select("bucket").distinct().collect()]  # BUCKETS at most
        stored = self._stored().where(F.col(BUCKET).isin(buckets))
        if len(some) <= NAMED:
            stored = stored.where(F.col("batch").isin(some))
        return (
            stored.select(*keys, F.col(BUCKET).alias("bucket"), "batch")
            .join(places, ["bucket", "batch"], "left_semi")
            .withColumn("hash", blooms.key_hash(self.keys))
            .join(maybe.select("hash").distinct(), "hash", "left_semi")
            .select(*keys)
            .distinct()
        )

    def clear(self) -> None:
        files.remove(self.spark, self.index_path)
        files.remove(self.spark, self.rows_path)


def write_days(events: DataFrame, path: str) -> None:
    """Events into a warehouse laid out by `event_date`; the days they touch are replaced.

    Other days stay as they are, and writing the same days again leaves the table equal.
    The date is that of the event time as sent; events without one go to the null day.
    """
    dated = events.withColumn("event_date", F.substring("timestamp", 1, 10).try_cast("date"))
    dated.repartition("event_date", F.pmod(F.xxhash64("event_id"), F.lit(DAY_FILES))).write.mode(
        "overwrite"
    ).option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(path)


def read_days(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, path, schemas.WAREHOUSE)


def events_table(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, schemas.EVENTS, schemas.EVENT_KEY)


def alerts_table(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, schemas.ALERTS, schemas.ALERT_KEY)


def holds_table(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, schemas.HOLDS, schemas.HOLD_KEY)


def flags_table(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, schemas.FLAGS, schemas.FLAG_KEY)
