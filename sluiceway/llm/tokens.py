"""Token ids in files: static range asymmetric numeral system, interleaved blocks."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import partitions, ship

#: Fixed values of the file format.
MAGIC = b"IDS1"
PRECISION = 20  # bits of an id's share
LOW = np.uint64(1 << 31)  # states lie between this and 2^63
LANES = 256  # interleaved states of a block
BLOCK = 1 << 16  # ids of a block; a file's last may have fewer

END_ID = 2
#: Ids from which a task ends a file and begins the next.
FILE_IDS = 1 << 22
#: Words a worker remembers with their ids; when full it starts again, the ids are the same.
MEMORY = 1_200_000
NO_ID = np.iinfo(np.int64).min  # stands for a null document id

_U32 = np.uint64(0xFFFFFFFF)

# --- the coder ------------------------------------------------------------------------


def shares(counts: np.ndarray) -> np.ndarray:
    """Whole shares of 2^PRECISION, at least 1 for every id that occurs."""
    there = counts > 0
    room = (1 << PRECISION) - int(there.sum())
    out = np.where(there, 1 + (counts / max(1, counts.sum()) * room).astype(np.int64), 0)
    if there.any():
        out[np.argmax(counts)] += (1 << PRECISION) - out.sum()
    return out.astype(np.uint64)


def _begins(freq: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)


def _encode(blocks: np.ndarray, freq: np.ndarray, cum: np.ndarray) -> list[bytes]:
    """Blocks of equal length, side by side: each has its LANES states, taken from last to first."""
    n, size = blocks.shape
    lanes = blocks.reshape(n, size // LANES, LANES)
    x = np.full((n, LANES), LOW, np.uint64)
    words, owners = [], []
    for i in range(lanes.shape[1] - 1, -1, -1):
        f = freq[lanes[:, i]]
        full = x >= f << np.uint64(63 - PRECISION)
        if full.any():
            words.append((x[full] & _U32).astype("<u4"))
            owners.append(np.nonzero(full)[0])
            x = np.where(full, x >> np.uint64(32), x)
        q, r = np.divmod(x, f)
        x = (q << np.uint64(PRECISION)) + r + cum[lanes[:, i]]
    words = np.concatenate(words[::-1] or [np.zeros(0, "<u4")])
    owners = np.concatenate(owners[::-1] or [np.zeros(0, np.int64)])
    order = np.argsort(owners, kind="stable")
    bounds = np.searchsorted(owners[order], np.arange(n + 1))
    words = words[order]
    return [x[b].astype("<u8").tobytes() + words[bounds[b] : bounds[b + 1]].tobytes() for b in range(n)]


def _decode(data: list[bytes], size: int, tables: tuple) -> np.ndarray:
    """The ids of blocks of `size` ids each, decoded side by side."""
    freq, cum, slot = tables
    n = len(data)
    x = np.stack([np.frombuffer(d, "<u8", LANES) for d in data]).copy()
    words = [np.frombuffer(d, "<u4", offset=8 * LANES) for d in data]
    at = np.concatenate(([0], np.cumsum([len(w) for w in words])[:-1])).astype(np.int64)
    words = np.concatenate(words).astype(np.uint64)
    out = np.empty((n, size // LANES, LANES), np.int64)
    for i in range(size // LANES):
        low = x & np.uint64((1 << PRECISION) - 1)
        s = slot[low]
        out[:, i] = s
        x = freq[s] * (x >> np.uint64(PRECISION)) + low - cum[s]
        need = x < LOW
        if need.any():
            place = at[:, None] + np.cumsum(need, axis=1) - 1
            x[need] = (x[need] << np.uint64(32)) | words[place[need]]
            at = at + need.sum(axis=1)
    return out.reshape(n, size)


def encode_file(docs: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One file: header, documents, frequency table, index of blocks, blocks.

    The blocks share the file's frequency table, and each can be decoded alone: the index
    holds its checkpoint (first id, place and size in the file) and the CRC-32 of its
    ids and of its bytes. The header holds the CRC-32 of all that stands before the blocks.
    """
    freq = shares(np.bincount(ids, minlength=1))
    cum = _begins(freq)
    used = np.flatnonzero(freq)
    tail = len(ids) % BLOCK
    whole = ids[: len(ids) - tail].reshape(-1, BLOCK)
    parts = _encode(whole, freq, cum) if len(whole) else []
    if tail:
        last = np.full(-(-tail // LANES) * LANES, ids[-1], np.int64)
        last[:tail] = ids[-tail:]
        parts += _encode(last[None], freq, cum)
    sums = [zlib.crc32(ids[a : a + BLOCK].astype("<u4").tobytes()) for a in range(0, len(ids), BLOCK)]
    index = b"".join(struct.pack("<QIII", i * BLOCK, len(p), c, zlib.crc32(p)) for i, (p, c) in enumerate(zip(parts, sums)))
    table = np.diff(used, prepend=0).astype("<u4").tobytes() + freq[used].astype("<u4").tobytes()
    meta = zstandard.compress(docs.astype("<i8").tobytes() + lengths.astype("<u4").tobytes() + table + index)
    head = struct.pack("<BHIQQII", PRECISION, LANES, BLOCK, len(docs), len(ids), len(used), len(meta))
    return MAGIC + struct.pack("<I", zlib.crc32(head + meta)) + head + meta + b"".join(parts)


def decode_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents, lengths, ids) of one file; raises ValueError where a checksum fails."""
    shape = "<BHIQQII"
    start = 8 + struct.calcsize(shape)
    if len(data) < start or data[:4] != MAGIC:
        raise ValueError("not an id file")
    _, _, _, docs, n, used, size = struct.unpack_from(shape, data, 8)
    if zlib.crc32(data[8 : start + size]) != struct.unpack_from("<I", data, 4)[0]:
        raise ValueError("a damaged header")
    meta = zstandard.decompress(data[start : start + size])
    doc_ids = np.frombuffer(meta, "<i8", docs)
    lengths = np.frombuffer(meta, "<u4", docs, 8 * docs).astype(np.int64)
    raw = np.frombuffer(meta, "<u4", 2 * used, 12 * docs)
    if not n:
        return doc_ids, lengths, np.zeros(0, np.int64)
    at = np.cumsum(raw[:used].astype(np.int64))
    freq = np.zeros(int(at[-1]) + 1, np.uint64)
    freq[at] = raw[used:]
    tables = freq, _begins(freq), np.repeat(np.arange(len(freq)), freq.astype(np.int64))
    index = list(struct.iter_unpack("<QIII", meta[12 * docs + 8 * used :]))
    ends = start + size + np.cumsum([length for _, length, _, _ in index])
    parts = [data[e - length : e] for e, (_, length, _, _) in zip(ends, index)]
    if any(zlib.crc32(p) != check for p, (*_, check) in zip(parts, index)):
        raise ValueError("a damaged block")
    whole = n // BLOCK
    ids = [_decode(parts[:whole], BLOCK, tables).ravel()] if whole else []
    if n % BLOCK:
        ids.append(_decode(parts[whole:], -(-(n % BLOCK) // LANES) * LANES, tables).ravel()[: n % BLOCK])
    out = np.concatenate(ids)
    for first, _, check, _ in index:
        if zlib.crc32(out[first : first + BLOCK].astype("<u4").tobytes()) != check:
            raise ValueError("a block's ids do not match their checksum")
    return doc_ids, lengths, out


# --- text to ids ------------------------------------------------------------------------

#: Fixed value: the vocabulary's rule for splitting a text.
_PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
_BREAK = re.compile(r"(?<=\S) (?=\S)")
_SPECIAL = "<|"
_STOPS = frozenset(".,;:!?")


class Encoder:
    """Whole texts to ids, each word and each piece of a word encoded once and remembered.

    The splitting rule never joins what stands before a single space to what follows,
    and the pieces of a word are encoded apart by the vocabulary itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        first = np.zeros(1 << 16, bool)  # ids that begin with a space
        for token, i in self.tokenizer.get_vocab().items():
            first[i] = token.startswith("\u0120")
        self.first = first

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [
            np.array(e.ids, np.uint16)
            for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ]

    def _spaced_ids(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each word with the ids of a space and it; many are encoded at a time."""
        for a in range(0, len(words), 400):
            part = words[a : a + 400]
            (ids,) = self._ids([" " + " ".join(part)])
            bounds = np.flatnonzero(self.first[ids])
            if len(bounds) != len(part):
                raise ValueError("the vocabulary splits words otherwise than by space")
            raw = ids.tobytes()
            ends = [*(2 * bounds[1:]).tolist(), len(raw)]
            yield from zip(part, (raw[a:z] for a, z in zip([0, *ends], ends)))

    def _learn_pieces(self, new: list[str]) -> None:
        spaced = [p[1:] for p in new if p[0] == " " and len(p) > 1 and not p[1].isspace()]
        self.pieces.update((" " + w, ids) for w, ids in self._spaced_ids(spaced))
        rest = [p for p in new if p not in self.pieces]
        self.pieces.update(zip(rest, (x.tobytes() for x in self._ids(rest))))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 16-bit integers."""
        if len(self.words) > MEMORY:
            self.words = {}
        if len(self.pieces) > MEMORY:
            self.pieces = {}
        split = [t.split(" ") for t in texts]
        # a text's first word has no space before it
        starts = [words.pop(0) for words in split]
        self._learn(set().union(*split).difference(self.words))
        known = self.words.__getitem__
        out = []
        for text, start, words in zip(texts, starts, split):
            try:
                if start and not start[-1].isspace() or not words:
                    out.append(self._apart([start] if start else []) + b"".join(map(known, words)))
                    continue
            except TypeError:  # a word that other white space touches
                pass
            parts = _BREAK.split(text)
            out.append(self._apart([parts[0], *(" " + w for w in parts[1:])]))
        return out

    def _learn(self, new: set[str]) -> None:
        """Remember words, by their form without the space before them; odd ones as None.

        Letters alone are one piece, and a stop behind them another; the rule is asked for others.
        """
        plain, stopped, rest = [], [], []
        for w in new:
            if w.isalpha():
                plain.append(w)
            elif w[-1:] in _STOPS and w[:-1].isalpha():
                stopped.append(w)
            elif w and not w[0].isspace() and not w[-1].isspace():
                rest.append(w)
        bare = {w[:-1] for w in stopped}.difference(self.words, plain)
        self.words.update(dict.fromkeys(new))
        self.words.update(self._spaced_ids(plain + list(bare)))
        self._need([[*_STOPS]])
        words, known = self.words, self.pieces.__getitem__
        self.words.update([(w, words[w[:-1]] + known(w[-1])) for w in stopped])
        parts = [_PIECES.findall(" " + w) if _SPECIAL not in w else [" " + w] for w in rest]
        self._need(parts)
        self.words.update((w, b"".join(map(known, ps))) for w, ps in zip(rest, parts))

    def _need(self, parts: list[list[str]]) -> None:
        pieces = set().union(*parts).difference(self.pieces)
        if pieces:
            self._learn_pieces(list(pieces))

    def _apart(self, words: list[str]) -> bytes:
        parts = [_PIECES.findall(w) if _SPECIAL not in w else [w] for w in words]
        self._need(parts)
        return b"".join(self.pieces[p] for ps in parts for p in ps)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


# --- files ------------------------------------------------------------------------------


def write_ids(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
) -> None:
    """Encode each row's whole text, with `end_id` behind it, into id files under `path`.

    Files are rows (part, file, n_ids, data) of a Parquet table; ordered by (part, file)
    they hold the rows in ascending id order. Rows are dealt by range of the id, and a
    task ends a file at FILE_IDS ids, so memory is bounded by one file and one text. A
    null text is an empty one; rows without an id come first; rows of one id follow
    each other by text. Other columns are not read.
    """
    spark = docs.sparkSession

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(vocabulary)
        end = np.array([end_id], "<u2").tobytes()
        names, held, n, nth = [], [], 0, 0

        def full() -> pd.DataFrame:
            lengths = np.fromiter(map(len, held), np.int64, len(held)) // 2
            ids = np.frombuffer(b"".join(held), "<u2").astype(np.int64)
            data = encode_file(np.array(names, np.int64), lengths, ids)
            part = TaskContext.get().partitionId()
            return pd.DataFrame({"part": [part], "file": [nth], "n_ids": [len(ids)], "data": [data]})

        for b in batches:
            for a in range(0, len(b), 512):
                rows = b.iloc[a : a + 512]
                for i, ids in zip(rows["i"], coder.encode(list(rows["t"]))):
                    names.append(i)
                    held.append(ids + end)
                    n += len(held[-1]) // 2
                    if n >= FILE_IDS:
                        yield full()
                        names, held, n, nth = [], [], 0, nth + 1
        if names:
            yield full()

    (
        ship(docs).select(
            F.coalesce(F.col(id_col).cast("bigint"), F.lit(int(NO_ID))).alias("i"),
            F.coalesce(F.col(text_col), F.lit("")).alias("t"),
        )
        .repartitionByRange(2 * partitions(spark), "i")
        .sortWithinPartitions("i", "t")
        .mapInPandas(write, "part bigint, file bigint, n_ids bigint, data binary")
        .write.option("compression", "none")
        .parquet(path)
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) for each document of the files under `path`.

    `start` counts the ids of all files and documents before it; the CRC-32 is that of
    the ids as little-endian unsigned 32-bit integers.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, file, data in zip(b["part"], b["file"], b["data"]):
                docs, lengths, ids = decode_file(data)
                ends = np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for n, e in zip(lengths, ends)]
                yield pd.DataFrame(
                    {"part": part, "file": file, "i": docs, "at": ends - lengths, "n": lengths, "crc": sums}
                )

    files = ship(spark.read.schema("part bigint, file bigint, n_ids bigint, data binary").parquet(path))
    docs = files.select("part", "file", "data").mapInPandas(
        read, "part bigint, file bigint, i bigint, at bigint, n bigint, crc bigint"
    )
    # one row for each file
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select(
        "part", "file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base")
    )
    return docs.join(bases, ["part", "file"]).select(
        F.when(F.col("i") != F.lit(int(NO_ID)), F.col("i")).alias("doc_id"),
        (F.col("base") + F.col("at")).alias("start"),
        F.col("n").alias("n_tokens"),
        F.col("crc").alias("ids_crc32"),
    )
