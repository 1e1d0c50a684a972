"""What the operators of this subpackage share."""

from __future__ import annotations

import os
import struct
import tempfile
import zipfile
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from sluiceway.sources.staging import new_folder, stage

__all__ = ["apart", "components", "discard", "new_folder", "pack_docs", "partitions", "shared_keys", "ship", "stage", "staged_bytes", "table"]

CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ship(df: DataFrame) -> DataFrame:
    """`df` itself, after its session's workers can import this package."""
    context = df.sparkSession.sparkContext
    if not getattr(context, "_sluiceway_shipped", False):
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="sluiceway-code-")), "sluiceway.zip")
        with zipfile.ZipFile(path, "w") as out:
            for folder, _, names in os.walk(top):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        out.write(full, os.path.relpath(full, os.path.dirname(top)))
        context.addPyFile(path)
        context._sluiceway_shipped = True
    return df


def apart(df: DataFrame) -> str:
    """A beginning for names of helper columns that no column of `df` shares."""
    return "_" * (1 + max([len(c) - len(c.lstrip("_")) for c in df.columns], default=0))


def discard(staged: DataFrame) -> None:
    """Delete what `stage` wrote, once nothing will read it again."""
    files = staged.inputFiles()
    if files:
        spark = staged.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def staged_bytes(staged: DataFrame) -> int:
    """Bytes of the files that `stage` wrote."""
    files = staged.inputFiles()
    if not files:
        return 0
    spark = staged.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()


# --- connected components --------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.

    `edges` has two bigint columns. Alternates large and small stars until the set of
    edges stays the same; each round is written out, so a lost executor costs one round.
    Nodes with many edges are pre-aggregated, and their joins can be split.
    """
    a, b = (F.col(c) for c in edges.columns)
    # every edge points from the larger node to the smaller
    now = stage(
        edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "edges",
    )
    before = _fingerprint(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = (
            now.select(F.col("v").alias("u"), F.col("u").alias("w"))
            .join(low, "u")
            .select(F.col("w").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        large = stage(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stage(
            small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(),
            "edges",
        )
        after = _fingerprint(now)
        if after == before:
            break
        before = after
    ends = now.groupBy("v").agg(F.lit(1).alias("one")).select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(ends)


def _fingerprint(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("u", "v").cast("decimal(20,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(mixed)).first())


# --- chunks of whole texts --------------------------------------------------------


def pack_docs(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(chunk, n, blob): documents in compressed chunks of about `chunk_bytes`, written out.

    A chunk is numbered by the task that made it and its place there, and kept in the
    shared folder, so that later passes meet the same chunks whoever computes them.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, nth = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        texts: list[bytes] = []
        held = 0
        press = zstandard.ZstdCompressor(level=5)

        def full() -> pd.DataFrame:
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            raw = struct.pack("<q", len(ids)) + np.array(ids, np.int64).tobytes() + sizes.tobytes()
            blob = press.compress(raw + b"".join(texts))
            return pd.DataFrame({"chunk": [task << 32 | nth], "n": [len(ids)], "blob": [blob]})

        for batch in batches:
            for i, t in zip(batch["i"], batch["t"]):
                ids.append(i)
                texts.append(t.encode())
                held += len(texts[-1]) + 16
                if held >= chunk_bytes:
                    yield full()
                    ids, texts, held, nth = [], [], 0, nth + 1
        if ids:
            yield full()

    rows = ship(docs).select(
        F.col(id_col).cast("bigint").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")
    ).where("i IS NOT NULL")
    return stage(rows.mapInPandas(pack, "chunk bigint, n bigint, blob binary"), "chunks")


def unpack_docs(blob: bytes) -> tuple[np.ndarray, list[bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<q", raw)
    ids = np.frombuffer(raw, np.int64, n, 8)
    ends = np.cumsum(np.frombuffer(raw, np.int64, n, 8 + 8 * n)) + 8 + 16 * n
    starts = np.concatenate(([8 + 16 * n], ends[:-1])) if n else ends
    return ids, [raw[a:b] for a, b in zip(starts, ends)]


# --- which keys occur in more than one place -----------------------------------------


def split_keys(keys: np.ndarray, buckets: int) -> Iterable[tuple[int, np.ndarray, np.ndarray]]:
    """For each bucket the sorted 32-bit rests of its keys, and where these keys stand."""
    bucket = (keys >> np.uint64(40)) % np.uint64(buckets)
    order = np.lexsort((keys & np.uint64(0xFFFFFFFF), bucket))
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
    low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)[order]
    for b in range(buckets):
        yield b, low[bounds[b] : bounds[b + 1]], order[bounds[b] : bounds[b + 1]]


def press_sorted(x: np.ndarray) -> bytes:
    """Sorted uint32 as differences, byte plane by byte plane."""
    gaps = np.diff(x, prepend=np.uint32(0)).astype("<u4")
    planes = gaps.view(np.uint8).reshape(-1, 4).T
    return struct.pack("<I", len(x)) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def open_sorted(blob: bytes) -> np.ndarray:
    (n,) = struct.unpack_from("<I", blob)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[4:]), np.uint8)
    return np.cumsum(planes.reshape(4, n).T.copy().view("<u4").ravel(), dtype=np.uint32)


def shared_keys(chunks: DataFrame, keys_of, buckets: int, counted: bool = False) -> DataFrame:
    """(chunk, bucket, flags): of each chunk's distinct keys, which lie in another chunk too.

    If `counted`, the flags are classes: 0 for a key of one chunk only, else 8 times the
    binary logarithm of the number of its chunks.

    `keys_of(blob)` gives a chunk's sorted distinct 64-bit keys. Every chunk sends one row
    to every bucket, so buckets are even whatever the keys; a key that half of all
    documents hold comes once from each chunk. Keys are compared by 32 bits and their
    bucket; two keys that fall together are flagged without need, never the reverse.
    Memory: one bucket, the number of keys over `buckets`.
    """

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk, blob in zip(batch["chunk"], batch["blob"]):
                parts = [(b, press_sorted(low)) for b, low, _ in split_keys(keys_of(blob), buckets)]
                yield pd.DataFrame(
                    {"chunk": chunk, "bucket": [b for b, _ in parts], "keys": [k for _, k in parts]}
                )

    def flag(rows: pd.DataFrame) -> pd.DataFrame:
        each = [open_sorted(k) for k in rows["keys"]]
        every = np.sort(np.concatenate(each))
        if counted:
            starts = np.flatnonzero(np.diff(every, prepend=~every[:1])) if len(every) else np.zeros(0, np.int64)
            often = np.diff(starts, append=len(every))
            names = every[starts[often > 1]]
            classes = np.minimum(255, 8 * np.log2(often[often > 1])).astype(np.uint8)
            flags = [zstandard.compress(_classes(k, names, classes).tobytes(), 1) for k in each]
            return pd.DataFrame({"chunk": rows["chunk"], "bucket": rows["bucket"], "flags": flags})
        again = every[1:][every[1:] == every[:-1]]  # sorted; repeats do no harm
        return pd.DataFrame(
            {
                "chunk": rows["chunk"],
                "bucket": rows["bucket"],
                "flags": [np.packbits(_within(k, again)).tobytes() for k in each],
            }
        )

    sent = chunks.mapInPandas(send, "chunk bigint, bucket int, keys binary")
    return sent.groupBy("bucket").applyInPandas(flag, "chunk bigint, bucket int, flags binary")


def _within(x: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_set, x), len(sorted_set) - 1)
    return sorted_set[at] == x


def _classes(x: np.ndarray, names: np.ndarray, classes: np.ndarray) -> np.ndarray:
    if not len(names):
        return np.zeros(len(x), np.uint8)
    at = np.minimum(np.searchsorted(names, x), len(names) - 1)
    return np.where(names[at] == x, classes[at], np.uint8(0))


def read_classes(keys: np.ndarray, buckets: int, replies: pd.DataFrame) -> np.ndarray:
    """For each of a chunk's sorted distinct keys its class (`shared_keys`, counted)."""
    found = np.zeros(len(keys), np.uint8)
    by_bucket = dict(zip(replies["bucket"], replies["flags"]))
    for b, low, where in split_keys(keys, buckets):
        if len(low):
            found[where] = np.frombuffer(zstandard.decompress(by_bucket[b]), np.uint8)
    return found


def read_flags(keys: np.ndarray, buckets: int, replies: pd.DataFrame) -> np.ndarray:
    """For each of a chunk's sorted distinct keys, whether another chunk has it."""
    found = np.zeros(len(keys), bool)
    by_bucket = dict(zip(replies["bucket"], replies["flags"]))
    for b, low, where in split_keys(keys, buckets):
        if len(low):
            bits = np.unpackbits(np.frombuffer(by_bucket[b], np.uint8), count=len(low))
            found[where] = bits.astype(bool)
    return found
