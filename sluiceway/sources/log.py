"""The append-only log: records in canonical form under contiguous offsets, replayable from any of them.

A batch's records lie in `records/batch_id=<its own name>`, numbered from 0. The batch counts
once `commits/<N>.json` names it with its first offset, row count and files. That file is
published whole and only if nobody has taken N, so any number of writers may append at once:
who comes second reads what the first one published and takes the next number. Readers see
committed batches only; what an unfinished append left behind is never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from sluiceway import schemas
from sluiceway.functions.jsontext import with_canonical
from sluiceway.sources import files
from sluiceway.sources.lines import MAX_FILE_AGE
from sluiceway.sources.staging import read_or_empty, stage

#: Input blocks whose shifts are broadcast, about 100 bytes each; more are joined by shuffle.
BROADCAST_BLOCKS = 1 << 18


class Append(NamedTuple):
    first_offset: int
    rows: int


def in_order(df: DataFrame, *order: str) -> DataFrame:
    """Give rows of any frame an origin that follows `order`."""
    return (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("src_file", F.lit(""))
        .withColumn("src_block", F.spark_partition_id().cast("bigint"))
    )


def block_shifts(staged: DataFrame) -> DataFrame:
    """(src_file, src_block, _rows, _shift) of each input block: what to add to `_seq`.

    One row per input block: small however long the log is.
    """
    blocks = staged.groupBy("src_file", "src_block").agg(
        F.min("_seq").alias("_first"), F.count("*").alias("_rows")
    )
    before = W.orderBy("src_file", "src_block").rowsBetween(W.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("_rows").over(before), F.lit(0))
    return blocks.select("src_file", "src_block", "_rows", (ahead - F.col("_first")).alias("_shift"))


def numbered(staged: DataFrame, shifts: DataFrame, blocks: int) -> DataFrame:
    """(offset, raw): rows in origin order from 0 on. Rows stay where they are."""
    shifts = shifts.select("src_file", "src_block", "_shift")
    if blocks <= BROADCAST_BLOCKS:
        shifts = F.broadcast(shifts)
    return staged.join(shifts, ["src_file", "src_block"]).select(
        (F.col("_seq") + F.col("_shift")).alias("offset"), "raw"
    )


class RecordLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    @property
    def records_path(self) -> str:
        return f"{self.path}/records"

    @property
    def commits_path(self) -> str:
        return f"{self.path}/commits"

    def commits(self) -> DataFrame:
        return read_or_empty(self.spark, self.commits_path, schemas.COMMIT, "json")

    def append(self, df: DataFrame, source: str | None = None) -> Append:
        """Append `raw` of a frame with origin columns, in origin order and canonical form.

        Offsets are numbered per block of the input and shifted by the rows before
        it, so nothing is sorted globally. The accepted rows are staged first: their
        numbering is then fixed, and the input is parsed once. A `source` that is
        already in the log is not appended again.
        """
        if source is not None and (known := self._appended(source)):
            return known
        staged = stage(
            with_canonical(df.select("raw", "src_file", "src_block")).withColumn(
                "_seq", F.monotonically_increasing_id()
            ),
            "append",
        )
        shifts = stage(block_shifts(staged), "shifts")
        blocks, rows = shifts.agg(F.count("*"), F.coalesce(F.sum("_rows"), F.lit(0))).first()
        batch = uuid.uuid4().hex
        target = f"{self.records_path}/batch_id={batch}"
        numbered(staged, shifts, blocks).write.parquet(target)
        return self._publish(batch, rows, source, files.names(self.spark, target))

    def _appended(self, source: str) -> Append | None:
        known = self.commits().where(F.col("source") == source).first()
        return known and Append(known.first_offset, known.rows)

    def _publish(self, batch: str, rows: int, source: str | None, parts: list[str]) -> Append:
        met_others = False
        while True:
            number, first = self._next()
            # Another writer may have brought the same source meanwhile.
            if met_others and source is not None and (known := self._appended(source)):
                return known
            entry = {
                "batch_id": number, "batch": batch, "first_offset": first, "rows": rows,
                "source": source, "files": [p for p in parts if p.endswith(".parquet")],
            }
            if files.write_once(self.spark, f"{self.commits_path}/{number:020d}.json", json.dumps(entry)):
                return Append(first, rows)
            met_others = True

    def _next(self) -> tuple[int, int]:
        """The number of the next batch and its first offset."""
        taken = files.names(self.spark, self.commits_path)
        if not taken:
            return 0, 0
        last = json.loads(files.read_small(self.spark, f"{self.commits_path}/{taken[-1]}"))
        return last["batch_id"] + 1, last["first_offset"] + last["rows"]

    def read(self, from_offset: int = 0) -> DataFrame:
        """(offset, raw, batch_id) at and after an offset; only the batches that hold them."""
        commits = self.commits()
        if from_offset <= 0:
            return self.read_batches(commits)
        later = commits.where(F.col("first_offset") + F.col("rows") > from_offset)
        return self.read_batches(later).where(F.col("offset") >= from_offset)

    def read_batches(self, commits: DataFrame) -> DataFrame:
        """(offset, raw, batch_id) of some rows of `commits()`.

        `commits` was listed before the records are, so every record it names is found;
        the batches it does not name are pruned as partitions.
        """
        stored = read_or_empty(self.spark, self.records_path, schemas.LOG_STORED)
        named = commits.select(F.col("batch").alias("_batch"), "batch_id", "first_offset")
        return (
            stored.withColumnRenamed("batch_id", "_batch")
            .join(named, "_batch")
            .select((F.col("first_offset") + F.col("offset")).alias("offset"), "raw", "batch_id")
        )

    def stream_commits(self, commits_per_batch: int | None = None) -> DataFrame:
        """The log's commits as a stream, lower offsets first; a missing log has none yet.

        A commit names a finished stretch of offsets, so a consumer takes whole stretches
        and its checkpoint says how far it has read. A new checkpoint starts from offset 0.
        """
        files.make_folder(self.spark, self.commits_path)
        reader = self.spark.readStream.schema(schemas.COMMIT).option("maxFileAge", MAX_FILE_AGE)
        if commits_per_batch is not None:
            reader = reader.option("maxFilesPerTrigger", commits_per_batch)
        return reader.json(self.commits_path)

    def stream_records(self, commits_per_batch: int | None = None) -> DataFrame:
        """(offset, raw, batch_id) as a stream, following the commits.

        The files a commit names are dealt out and read by the tasks, each row group by row
        group; the records' store has to be one that Arrow opens (local, HDFS, S3, GCS).
        """
        base = files.qualified(self.spark, self.records_path)
        parts = self.stream_commits(commits_per_batch).select(
            "batch_id", "first_offset", "batch", F.explode("files").alias("file")
        )
        return parts.repartition("batch", "file").mapInArrow(_rows_of_files(base), schemas.LOG_READ)

    def size_frame(self) -> DataFrame:
        return self.commits().agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("size"))

    def size(self) -> int:
        return self._next()[1]

    def clear(self) -> None:
        """Forget every record; the next one gets offset 0."""
        files.remove(self.spark, self.commits_path)
        files.remove(self.spark, self.records_path)


def _rows_of_files(base: str):
    """Task function: names of record files -> their rows under the log's offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        from pyarrow import fs

        if base.startswith("file:"):
            store, folder = fs.LocalFileSystem(), "/" + base[5:].lstrip("/")
        else:
            store, folder = fs.FileSystem.from_uri(base)
        schema = pa.schema([("offset", pa.int64()), ("raw", pa.string()), ("batch_id", pa.int64())])
        for batch in batches:
            for part in batch.to_pylist():
                path = f"{folder}/batch_id={part['batch']}/{part['file']}"
                with store.open_input_file(path) as data:
                    for rows in pq.ParquetFile(data).iter_batches(1 << 14, columns=["offset", "raw"]):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pc.add(rows.column("offset"), part["first_offset"]),
                                rows.column("raw").cast(pa.string()),
                                pa.repeat(pa.scalar(part["batch_id"], pa.int64()), len(rows)),
                            ],
                            schema=schema,
                        )

    return run
