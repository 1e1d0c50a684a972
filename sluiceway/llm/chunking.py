"""Substring dedup by content-defined chunks: a gear rolling hash cuts, digests are compared."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import pack_docs, partitions, read_flags, shared_keys, ship, unpack_docs

_REACH = 16  # bytes that a gear hash of 16 bits depends on
_GEAR = np.random.default_rng(17).integers(0, 1 << 16, 256).astype(np.uint16)


@dataclass(frozen=True)
class ChunkParams:
    #: A place is a cut where so many high bits of its hash are zero: one of 2^bits.
    bits: int = 4
    #: Bytes of a chunk at least, but for a text shorter than that, and at most; a rest
    #: under the least is part of the last chunk.
    least: int = 32
    most: int = 512
    #: Bytes of repeated chunks in a row, at least, that are removed: shorter ones are phrases.
    run: int = 96


def cut_places(text: bytes, params: ChunkParams) -> list[int]:
    """The ends of a text's chunks.

    The hash at a place depends on the bytes just before it only, so after an insertion
    the same cuts return.
    """
    n = len(text)
    if not n:
        return []
    h = _GEAR[np.frombuffer(text, np.uint8)]
    step = 1
    while step < _REACH:
        h[step:] += h[:-step] << np.uint16(step)
        step *= 2
    places = np.flatnonzero(h >> np.uint16(16 - params.bits) == 0) + 1
    ends, last = [], 0
    for p in places.tolist():
        while p - last > params.most:
            last += params.most
            ends.append(last)
        if p - last >= params.least:
            last = p
            ends.append(p)
    while n - last > params.most:
        last += params.most
        ends.append(last)
    if ends and n - last < params.least:
        ends[-1] = n
    else:
        ends.append(n)
    return ends


def long_runs(repeats: set[int], ends: list[int], run: int) -> set[int]:
    """Of a text's repeated chunks those in a row of `run` bytes, or all if no other is there."""
    if len(repeats) == len(ends):
        return repeats
    away: set[int] = set()
    row: list[int] = []
    for n in [*sorted(repeats), None]:
        if row and n != row[-1] + 1:
            if ends[row[-1]] - (ends[row[0] - 1] if row[0] else 0) >= run:
                away.update(row)
            row = []
        if n is not None:
            row.append(n)
    return away


class _Cut:
    """The chunks of packed documents with their digests."""

    def __init__(self, blob: bytes, params: ChunkParams):
        self.ids, self.texts = unpack_docs(blob)
        self.ends = [cut_places(t, params) for t in self.texts]
        digests, docs, nth = [], [], []
        for d, (text, ends) in enumerate(zip(self.texts, self.ends)):
            a = 0
            for i, z in enumerate(ends):
                digests.append(xxhash.xxh3_128_digest(text[a:z]))
                docs.append(d)
                nth.append(i)
                a = z
        pairs = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).reshape(-1, 2)
        self.high, self.low = pairs[:, 0], pairs[:, 1]
        self.doc, self.nth = np.array(docs, np.int64), np.array(nth, np.int64)


def chunk_dedup(
    docs: DataFrame,
    params: ChunkParams = ChunkParams(),
    id_col: str = "doc_id",
    text_col: str = "text",
    with_text: bool = False,
) -> DataFrame:
    """(doc_id, n_chunks, n_removed, n_bytes, n_removed_bytes, kept_sha256), and `kept` if asked.

    Of the chunks with one digest all but the first by (doc_id, place) are repeats, also
    within a document. Repeats in a row go if they have `run` bytes together or are all
    of a text; the first copy of a chunk always stays. A null text is empty. Rows of one
    id and place are the same place: none counts against another. Rows without an id are
    left out. Each packed chunk sends a digest once, whatever its copies.
    """
    buckets = partitions(docs.sparkSession)
    packed = pack_docs(ship(docs), id_col, text_col)

    def keys_of(blob: bytes) -> np.ndarray:
        return np.unique(_Cut(blob, params).high)

    flags = shared_keys(packed, keys_of, buckets)

    def name(key, mine: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        out = []
        for number, blob in zip(mine["chunk"], mine["blob"]):
            cut = _Cut(blob, params)
            keys, where = np.unique(cut.high, return_inverse=True)
            use = np.flatnonzero(read_flags(keys, buckets, replies)[where])
            order = use[np.lexsort((cut.nth[use], cut.ids[cut.doc[use]], cut.low[use], cut.high[use]))]
            high, low = cut.high[order], cut.low[order]
            new = np.concatenate((high[:1] >= 0, (high[1:] != high[:-1]) | (low[1:] != low[:-1])))
            first = order[new]
            out.append(
                pd.DataFrame(
                    {
                        "chunk": number,
                        "high": cut.high[first].view(np.int64),
                        "low": cut.low[first].view(np.int64),
                        "doc": cut.ids[cut.doc[first]],
                        "nth": cut.nth[first],
                    }
                )
            )
        return pd.concat(out) if out else pd.DataFrame(columns=["chunk", "high", "low", "doc", "nth"])

    named = (
        packed.groupBy("chunk")
        .cogroup(flags.groupBy("chunk"))
        .applyInPandas(name, "chunk bigint, high bigint, low bigint, doc bigint, nth bigint")
    )
    first = named.groupBy("high", "low").agg(
        F.min(F.struct("doc", "nth")).alias("first"), F.collect_list("chunk").alias("chunks")
    )
    told = first.where(F.size("chunks") > 1).select(
        F.explode("chunks").alias("chunk"), "high", "low", F.col("first.doc").alias("doc"), F.col("first.nth").alias("nth")
    )

    schema = "doc_id bigint, n_chunks bigint, n_removed bigint, n_bytes bigint, n_removed_bytes bigint, kept_sha256 string"
    if with_text:
        schema += ", kept binary"
    names = [c.split()[0] for c in schema.split(", ")]

    def drop(key, mine: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        out = []
        for blob in mine["blob"]:
            cut = _Cut(blob, params)
            known = {
                (h, w): (d, n)
                for h, w, d, n in zip(
                    replies["high"].to_numpy(np.int64).view(np.uint64).tolist(),
                    replies["low"].to_numpy(np.int64).view(np.uint64).tolist(),
                    replies["doc"].tolist(),
                    replies["nth"].tolist(),
                )
            }
            own = cut.ids[cut.doc]
            keys = list(zip(cut.high.tolist(), cut.low.tolist()))
            places = list(zip(own.tolist(), cut.nth.tolist()))
            for k, p in zip(keys, places):
                if p < known.get(k, (np.inf, 0)):
                    known[k] = p
            gone: dict[int, set[int]] = {}
            for k, p, d in zip(keys, places, cut.doc.tolist()):
                if p > known[k]:
                    gone.setdefault(d, set()).add(p[1])
            for d, (doc_id, text, ends) in enumerate(zip(cut.ids.tolist(), cut.texts, cut.ends)):
                away = long_runs(gone.get(d, set()), ends, params.run)
                starts = [0, *ends[:-1]]
                kept = b"".join(text[a:z] for i, (a, z) in enumerate(zip(starts, ends)) if i not in away)
                row = (doc_id, len(ends), len(away), len(text), len(text) - len(kept), hashlib.sha256(kept).hexdigest())
                out.append((*row, kept) if with_text else row)
        return pd.DataFrame(out, columns=names)

    return packed.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(drop, schema)
