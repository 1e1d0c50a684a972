"""Which keys a table may hold already, from Bloom filters kept beside it.

Keys fall into hash buckets. Each bucket has filters of one size, filled one after the
other, and each filter knows the batches its keys came from: a key that no filter of its
bucket has seen is new, and one that a filter may have seen can only lie in that filter's
batches. So stored keys are read for likely repeats alone, in those batches and buckets.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

#: Hash buckets of a table.
BUCKETS = 64
#: Bits of a filter, keys it takes (16 bits a key) and probes a key: one key in 1,700 is
#: taken for a repeat without need.
BITS = 1 << 17
CAPACITY = BITS // 16
PROBES = 8

INDEX = "kind string, bucket int, hash bigint, n bigint, bits binary, batches array<string>"
_COLUMNS = ["kind", "bucket", "hash", "n", "bits", "batches"]


def key_hash(keys: tuple[str, ...]) -> Column:
    return F.xxhash64(*keys)


def bucket_of(hash_: Column) -> Column:
    return F.pmod(hash_, F.lit(BUCKETS)).cast("int")


def judge(new: DataFrame, index: DataFrame, batch: str) -> DataFrame:
    """(kind, ...): `maybe` rows, keys some filter may have seen, and the `filter` rows of the
    index with the new keys in it.

    `new` has (bucket, hash). A bucket's new keys and filters meet in one task: 16 kB for
    each 8,192 keys of the bucket.
    """

    def meet(key: tuple, rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        (bucket,) = key
        hashes = np.unique(rows["hash"].to_numpy(np.int64))
        at = _places(hashes)
        out, held = [], []
        for f in filters.sort_values("n", ascending=False).to_dict("records"):
            bits = np.frombuffer(f["bits"], np.uint8).copy()
            held.append((int(f["n"]), bits, list(f["batches"])))
            seen = hashes[(bits[at >> 3] >> (at & 7) & 1).all(axis=1)] if len(hashes) else hashes
            out += [("maybe", bucket, h, 0, b"", list(f["batches"])) for h in seen.tolist()]
        done = 0
        while done < len(hashes):
            if not held or held[-1][0] >= CAPACITY:
                held.append((0, np.zeros(BITS // 8, np.uint8), []))
            n, bits, batches = held[-1]
            some = at[done : done + CAPACITY - n].ravel()
            np.bitwise_or.at(bits, some >> 3, (1 << (some & 7)).astype(np.uint8))
            size = min(len(hashes) - done, CAPACITY - n)
            held[-1] = (n + size, bits, batches if batch in batches else [*batches, batch])
            done += size
        out += [("filter", bucket, 0, n, bits.tobytes(), batches) for n, bits, batches in held]
        return pd.DataFrame(out, columns=_COLUMNS)

    return (
        new.groupBy("bucket")
        .cogroup(index.where("kind = 'filter'").groupBy("bucket"))
        .applyInPandas(meet, INDEX)
    )


def _places(hashes: np.ndarray) -> np.ndarray:
    """The bits of each key: steps of its high half from its low half on."""
    h = hashes.view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    steps = np.arange(PROBES, dtype=np.uint64)
    return ((low[:, None] + steps * high[:, None]) % np.uint64(BITS)).astype(np.int64)


# Workers get these functions by value, wherever the package is installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
