"""Frames written out once and read back, to cut lineage and not compute twice.

They go to the shared folder the session names in `spark.checkpoint.dir`, so a lost
executor costs a re-read, not a recomputation, and later reads take only the columns
they need. Only a local session without that setting uses a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="sluiceway-")
    spark.conf.set(CHECKPOINT_CONF, folder)
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_or_empty(
    spark: SparkSession, path: str, schema: StructType, form: str = "parquet"
) -> DataFrame:
    """A stored table, or no rows where nothing was written yet."""
    try:
        return spark.read.schema(schema).format(form).load(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)

