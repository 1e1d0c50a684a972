"""Newline-delimited JSON files, batch and streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sluiceway.functions.jsontext import strip

# Beyond any real age: by default a file a week older than the newest is never read.
MAX_FILE_AGE = "36500d"


def _records(lines: DataFrame, source: Column | None = None) -> DataFrame:
    return lines.select(
        strip(F.col("value")).alias("raw"),
        (F.col("_metadata.file_path") if source is None else source).alias("src_file"),
        F.col("_metadata.file_block_start").alias("src_block"),
    ).where(F.col("raw") != "")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per non-blank line: `raw` and where it stood (file, block of the file).

    Rows of a block are in line order, in one task.
    """
    return _records(spark.read.text(path))


def stream_lines(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """The same rows from files landing in a folder, however old a file is.

    A file stands by its modification time, then its name: the order in which micro-batches
    take files, so that it does not depend on how many they take at once.
    """
    reader = spark.readStream.format("text").option("maxFileAge", MAX_FILE_AGE)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    landed = F.lpad(F.unix_millis("_metadata.file_modification_time").cast("string"), 15, "0")
    return _records(reader.load(folder), F.concat_ws(" ", landed, "_metadata.file_path"))
