"""Small files of the shared store, written and read by the driver through Spark's file systems."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none where it does not exist. Hidden ones are left out."""
    where, fs = _place(spark, folder)
    if not fs.exists(where):
        return []
    found = (status.getPath().getName() for status in fs.listStatus(where))
    return sorted(n for n in found if n[0] not in "._")


def make_folder(spark: SparkSession, folder: str) -> None:
    where, fs = _place(spark, folder)
    fs.mkdirs(where)


def remove(spark: SparkSession, path: str) -> None:
    where, fs = _place(spark, path)
    fs.delete(where, True)


def read_small(spark: SparkSession, path: str) -> str:
    where, fs = _place(spark, path)
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_once(spark: SparkSession, path: str, text: str) -> bool:
    """Publish a file under a name nobody has taken; False if it is taken.

    The file is written whole under a hidden name and then given its own in one step that
    fails where the name exists: a hard link on a local disk, a rename without overwriting
    elsewhere. Stores without such a rename need one writer at a time.
    """
    jvm = spark._jvm
    where, fs = _place(spark, path)
    fs.mkdirs(where.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    stream.write(text.encode())
    stream.close()
    if fs.getUri().getScheme() == "file":
        local = [jvm.java.nio.file.Paths.get(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.String, 0))
                 for p in (where, draft)]
        try:
            jvm.java.nio.file.Files.createLink(*local)
            return True
        except Exception as taken:
            if "FileAlreadyExistsException" not in str(taken):
                raise
            return False
        finally:
            fs.delete(draft, False)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration())
    never = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    never[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(draft, where, never)
        return True
    except Exception as taken:
        fs.delete(draft, False)
        if "FileAlreadyExistsException" not in str(taken):
            raise
        return False


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its store, as tasks need it."""
    where, fs = _place(spark, path)
    return fs.makeQualified(where).toString()
