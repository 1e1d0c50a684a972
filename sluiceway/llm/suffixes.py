"""Exact substring dedup: sorted suffix runs, exchanged front-coded, merged by loser trees.

A suffix stands at every anchor: of each stretch of LENGTH bytes the place whose GRAM bytes
hash lowest. Two equal stretches have the same anchor at the same distance, so no
repeat is missed, and suffixes whose gram lies in one document only need not travel.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame

from .common import pack_docs, partitions, read_flags, shared_keys, ship, staged_bytes, unpack_docs

LENGTH = 50
GRAM = 20
BACK = LENGTH - GRAM  # bytes before an anchor that a stretch may reach
REST = LENGTH - GRAM  # bytes behind an anchor's gram
KEY = 8 + REST  # a suffix: its gram's hash, then what follows the gram
#: Bytes of text whose anchors are found at once, a longer text apart.
CHUNK = 1 << 20
#: Bytes of text of which one run goes to each bucket.
BLOB = 8 << 20
#: Compressed bytes of text for each bucket of grams: some 1,300,000 anchors at most.
BUCKET = 8 << 20
#: Suffixes that a merge holds as Python objects at once, one gram's together.
AT_ONCE = 1 << 15
_SLICE = 1 << 18
_BITS = np.uint64(20)
_FACTOR = 0x9E3779B97F4A7C15


def _powers(n: int, factor: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_TABLES: dict[str, np.ndarray] = {}


def _gram_hashes(text: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at each place."""
    if not _TABLES:
        n = _SLICE + LENGTH
        _TABLES["up"] = _powers(n, _FACTOR)
        _TABLES["down"] = _powers(n, pow(_FACTOR, -1, 1 << 64))
    n = len(text)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(text * _TABLES["up"][:n])))
    h = (total[GRAM:] - total[:-GRAM]) * _TABLES["down"][: n - GRAM + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def anchors(text: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, gram hashes) of the anchors of all stretches inside a document.

    `room[i]`: bytes from i to its document's end. Slices overlap, so that texts of any
    length have the same anchors.
    """
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for a in range(0, len(text) - LENGTH + 1, _SLICE - LENGTH + 1):
        part = text[a : a + _SLICE]
        h = _gram_hashes(part)
        low = (h >> _BITS << _BITS) | np.arange(len(h), dtype=np.uint64)
        width, wanted = 1, LENGTH - GRAM + 1
        while 2 * width <= wanted:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if wanted > width:
            low = np.minimum(low[: width - wanted], low[wanted - width :])
        inside = room[a : a + len(low)] >= LENGTH
        at = (low[inside] & np.uint64((1 << 20) - 1)).astype(np.int64)
        at = at[np.concatenate((at[:1] >= 0, at[1:] != at[:-1]))]
        places.append(at + a)
        hashes.append(h[at])
    at, h = np.concatenate(places), np.concatenate(hashes)
    at, first = np.unique(at, return_index=True)
    return at, h[first]


class _Chunk:
    """Documents behind one another, of a blob or given as ids and texts, and their anchors."""

    def __init__(self, docs: bytes | tuple[np.ndarray, list[bytes]]):
        self.ids, texts = unpack_docs(docs) if isinstance(docs, bytes) else docs
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.text = np.frombuffer(b"".join(texts), np.uint8)
        room = np.repeat(self.ends, self.sizes)
        room -= np.arange(len(self.text))
        self.at, self.hash = anchors(self.text, room)
        self.doc = np.searchsorted(self.ends, self.at, side="right")
        self.before = np.minimum(BACK, self.at - (self.ends - self.sizes)[self.doc])
        self.behind = np.minimum(LENGTH, self.ends[self.doc] - self.at) - GRAM

    def bytes_at(self, places: np.ndarray, lengths: np.ndarray, step: int, width: int) -> np.ndarray:
        """A row for each place: `width` bytes on from it in steps of `step`, zeros beyond its length."""
        reach = np.arange(width)
        where = places[:, None] + step * reach
        inside = reach < lengths[:, None]
        out = np.zeros((len(places), width), np.uint8)
        out[inside] = self.text[where[inside]]
        return out


def _pieces(blob: bytes) -> Iterator[_Chunk]:
    """A blob's documents, about CHUNK bytes at once."""
    ids, texts = unpack_docs(blob)
    first, held = 0, 0
    for n, text in enumerate(texts, 1):
        held += len(text) + 16
        if held >= CHUNK or n == len(texts):
            yield _Chunk((ids[first:n], texts[first:n]))
            first, held = n, 0


def _keys_of(blob: bytes) -> np.ndarray:
    return np.unique(np.concatenate([np.unique(p.hash) for p in _pieces(blob)]))


def _in_two(pieces: list[_Chunk], keys: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Which of the distinct grams lie in documents of two ids of the pieces."""
    ids = np.concatenate([p.ids[p.doc] for p in pieces])
    low, high = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), np.iinfo(np.int64).min)
    np.minimum.at(low, where, ids)
    np.maximum.at(high, where, ids)
    return low < high


def _columns(rows: np.ndarray) -> list[np.ndarray]:
    """Rows of bytes as big-endian 64-bit numbers, the first column last, for lexsort."""
    wide = -(-rows.shape[1] // 8) * 8
    padded = np.zeros((len(rows), wide), np.uint8)
    padded[:, : rows.shape[1]] = rows
    return list(padded.view(">u8").astype(np.uint64).T[::-1])


def _common(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Length of the prefix each row shares with the row before; 0 for the first."""
    if not len(rows):
        return np.zeros(0, np.int64)
    differ = rows[1:] != rows[:-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.concatenate(([0], np.minimum(first, np.minimum(lengths[1:], lengths[:-1]))))


def _even(hashes: np.ndarray) -> np.ndarray:
    """The hashes mixed once more, one to one.

    Anchors are the lowest of 31, so a bucket that takes the lowest of n ranges of their
    hashes as they are would get up to 31/n of all suffixes.
    """
    h = hashes * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _suffix_rows(chunk: _Chunk, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each suffix's key (even hash of its gram and what follows) and its length."""
    rest = chunk.bytes_at(chunk.at[use] + GRAM, chunk.behind[use], 1, REST)
    head = _even(chunk.hash[use]).astype(">u8").view(np.uint8).reshape(-1, 8)
    return np.concatenate((head, rest), axis=1), 8 + chunk.behind[use]


def _heads(rows: np.ndarray) -> np.ndarray:
    """The even hashes that rows begin with."""
    return rows[:, :8].copy().view(">u8").ravel().astype(np.uint64)


def front_code(rows: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Sorted rows: of each the length it shares with the row before, its length, and the bytes after what it shares."""
    shared = _common(rows, lengths)
    reach = np.arange(rows.shape[1])
    own = (reach >= shared[:, None]) & (reach < lengths[:, None])
    return shared.astype(np.uint8).tobytes(), lengths.astype(np.uint8).tobytes(), rows[own].tobytes()


def front_decode(shared: np.ndarray, lengths: np.ndarray, data: bytes, width: int) -> np.ndarray:
    """The rows. Runs may stand behind one another: a run's first row shares nothing."""
    reach = np.arange(width, dtype=np.uint8)
    own = (reach >= shared[:, None]) & (reach < lengths[:, None])
    rows = np.zeros(own.shape, np.uint8)
    rows[own] = np.frombuffer(data, np.uint8)
    # what a row does not bring itself stands in the last row above that did
    places = np.arange(len(rows))
    for c in range(width):
        last = np.maximum.accumulate(np.where(own[:, c], places, 0))
        rows[:, c] = np.where(c < lengths, rows[last, c], 0)
    return rows


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Sorted runs with their shared lengths -> (run, place) in order, and shared lengths.

    A loser tree: every loser knows the prefix it shares with the winner that beat it. Of
    two that share different lengths with the last winner the longer comes first; only
    equal lengths are compared, and only from there on.
    """
    k = max(1, len(runs))
    leaves = 1 << (k - 1).bit_length()
    strings = [r[0] for r in runs] + [[]] * (leaves - len(runs))
    commons = [r[1] for r in runs] + [[]] * (leaves - len(runs))
    at = [0] * leaves
    now = [s[0] if s else None for s in strings]
    shared = [0] * leaves
    losers = [0] * leaves

    def play(a: int, b: int) -> int:
        """The winner; the loser's shared length becomes that with the winner."""
        x, y = now[a], now[b]
        if x is None or y is None:
            return b if x is None else a
        i = shared[a]
        if i != shared[b]:
            return a if i > shared[b] else b
        if x == y:
            win, lose = (a, b) if a < b else (b, a)
            shared[lose] = len(x)
            return win
        end = min(len(x), len(y))
        while i < end and x[i] == y[i]:
            i += 1
        if i == len(x) or i < len(y) and x[i] < y[i]:
            shared[b] = i
            return a
        shared[a] = i
        return b

    level = list(range(leaves))
    node = leaves
    while len(level) > 1:
        node //= 2
        winners = []
        for i in range(0, len(level), 2):
            w = play(level[i], level[i + 1])
            losers[node + i // 2] = level[i] if w == level[i + 1] else level[i + 1]
            winners.append(w)
        level = winners
    w = level[0]
    order: list[tuple[int, int]] = []
    lcps: list[int] = []
    while now[w] is not None:
        order.append((w, at[w]))
        lcps.append(shared[w])
        i = at[w] = at[w] + 1
        if i < len(strings[w]):
            now[w] = strings[w][i]
            shared[w] = commons[w][i]
        else:
            now[w] = None
        node = (leaves + w) >> 1
        while node:
            other = losers[node]
            new = play(w, other)
            if new != w:
                losers[node] = w
                w = new
            node >>= 1
    return order, lcps


def _later(chunk: _Chunk, use: np.ndarray) -> tuple[np.ndarray, ...]:
    """Suffixes in order, and whether an equal context stands in a document with a smaller id.

    (anchors, rows, lengths, bytes before, ids, later): of later ones all stretches repeat.
    """
    rows, lengths = _suffix_rows(chunk, use)
    left = chunk.bytes_at(chunk.at[use] - 1, chunk.before[use], -1, BACK)
    doc = chunk.ids[chunk.doc[use]]
    order = np.lexsort((doc, *_columns(left), chunk.before[use], lengths, *_columns(rows)))
    use, rows, lengths, left, doc = use[order], rows[order], lengths[order], left[order], doc[order]
    back = chunk.before[use]
    alike = np.zeros(len(use), bool)
    alike[1:] = (
        (rows[1:] == rows[:-1]).all(axis=1)
        & (left[1:] == left[:-1]).all(axis=1)
        & (lengths[1:] == lengths[:-1])
        & (back[1:] == back[:-1])
    )
    lead = np.maximum.accumulate(np.where(alike, 0, np.arange(len(use))))
    return use, rows, lengths, left, doc, doc > doc[lead]


def _runs_of(pieces: _Chunk | list[_Chunk], number: int, shared: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    """The suffix runs of a blob's pieces, one for each bucket, without what a piece can tell by itself.

    Places are counted on from piece to piece.
    """
    parts, first = [], 0
    for piece in [pieces] if isinstance(pieces, _Chunk) else pieces:
        use, rows, lengths, left, doc, later = _later(piece, np.flatnonzero(shared[first : first + len(piece.at)]))
        each = (rows, lengths.astype(np.uint8), left, piece.before[use].astype(np.uint8), doc, (use + first).astype("<u4"))
        parts.append([x[~later] for x in each])
        first += len(piece.at)
    rows, lengths, left, back, doc, use = (np.concatenate(x) for x in zip(*parts))
    if len(parts) > 1:
        order = np.lexsort((lengths, *_columns(rows)))
        rows, lengths, left, back, doc, use = (x[order] for x in (rows, lengths, left, back, doc, use))
    bucket = (_heads(rows) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    bounds = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    press = zstandard.ZstdCompressor(level=3)
    runs = []
    for b in range(buckets):
        s = slice(bounds[b], bounds[b + 1])
        n = s.stop - s.start
        if n:
            coded = front_code(rows[s], lengths[s])
            before = left[s][np.arange(BACK) < back[s][:, None]]
            head = struct.pack("<qIII", number, n, len(coded[2]), len(before))
            body = (head, *coded, back[s].tobytes(), before.tobytes(), doc[s].astype("<i8").tobytes(), use[s].tobytes())
            runs.append((b, press.compress(b"".join(body))))
    return runs


class _Runs:
    """Runs behind one another, opened."""

    def __init__(self, blobs):
        unpress = zstandard.ZstdDecompressor()
        numbers, sizes, parts = [], [], [bytearray() for _ in range(7)]
        for blob in blobs:
            data = memoryview(unpress.decompress(blob))
            number, n, own, before = struct.unpack_from("<qIII", data)
            numbers.append(number)
            sizes.append(n)
            at = struct.calcsize("<qIII")
            for part, size in zip(parts, (n, n, own, n, before, 8 * n, 4 * n)):
                part += data[at : at + size]
                at += size
        self.numbers, self.sizes = numbers, np.array(sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.shared, self.lengths, self.back = (np.frombuffer(parts[i], np.uint8) for i in (0, 1, 3))
        self.doc, self.use = np.frombuffer(parts[5], "<i8"), np.frombuffer(parts[6], "<u4")
        self.rows = front_decode(self.shared, self.lengths, parts[2], KEY)
        self.left = np.zeros((len(self.back), BACK), np.uint8)
        self.left[np.arange(BACK, dtype=np.uint8) < self.back[:, None]] = np.frombuffer(parts[4], np.uint8)


def _repeats(lcp, lengths, left, back, doc) -> tuple[np.ndarray, np.ndarray]:
    """For merged suffixes: the most and the least bytes before the anchor of a repeated stretch.

    A stretch that begins `b` bytes before the anchor is the same as another's if their
    suffixes share LENGTH - b bytes and the bytes before them b. Most is -1 where none is.
    """
    n = len(doc)
    order = np.lexsort(_columns(left))
    common = _common(left[order], back[order])
    most, least = np.full(n, -1, np.int64), np.full(n, LENGTH, np.int64)
    ahead = lengths - 8 + GRAM
    for b in range(BACK + 1):
        here = np.flatnonzero((back >= b) & (ahead >= LENGTH - b))
        if not len(here):
            continue
        right_class = np.cumsum(lcp < LENGTH - b - GRAM + 8)
        left_class = np.empty(n, np.int64)
        left_class[order] = np.cumsum(common < b) if b else 0
        key = right_class[here] * (n + 1) + left_class[here]
        by = np.lexsort((doc[here], key))
        key, at = key[by], here[by]
        new = np.concatenate((key[:1] >= 0, key[1:] != key[:-1]))
        first = doc[at[np.flatnonzero(new)]][np.cumsum(new) - 1]
        hit = at[doc[at] > first]
        most[hit] = np.maximum(most[hit], b)
        least[hit] = np.minimum(least[hit], b)
    return most, least


def _ranges(heads: list[np.ndarray]) -> list[np.ndarray]:
    """For each run's sorted gram hashes the bounds of ranges of about AT_ONCE suffixes in all.

    A gram's suffixes are never parted.
    """
    every = np.sort(np.concatenate(heads))
    cuts = np.unique(every[AT_ONCE::AT_ONCE])
    return [np.concatenate(([0], np.searchsorted(h, cuts), [len(h)])) for h in heads]


def _reduce(blobs) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """One bucket's runs -> for each chunk (chunk, anchors, most, least) of the repeats.

    Suffixes of different grams share no stretch, so the runs are merged range by range
    of the gram's hash.
    """
    runs = _Runs(blobs)
    bounds = np.array(_ranges(np.split(_heads(runs.rows), runs.starts[1:])))
    found = []
    for step in range(bounds.shape[1] - 1):
        sizes = bounds[:, step + 1] - bounds[:, step]
        owner = np.flatnonzero(sizes)
        if not len(owner):
            continue
        sizes = sizes[owner]
        base = np.cumsum(sizes) - sizes
        at = np.repeat(runs.starts[owner] + bounds[owner, step] - base, sizes) + np.arange(sizes.sum())
        raw, ends = runs.rows[at].tobytes(), (np.arange(len(at)) * KEY + runs.lengths[at]).tolist()
        strings, shared = [raw[i * KEY : e] for i, e in enumerate(ends)], runs.shared[at]
        shared[base] = 0  # the row before is in no run of this range
        shared = shared.tolist()
        cuts = [*base.tolist(), len(at)]
        order, lcps = merge_runs([(strings[a:z], shared[a:z]) for a, z in zip(cuts, cuts[1:])])
        pairs = np.array(order, np.int64).reshape(-1, 2)
        at = at[base[pairs[:, 0]] + pairs[:, 1]]
        lengths, back = runs.lengths[at].astype(np.int64), runs.back[at].astype(np.int64)
        most, least = _repeats(np.array(lcps, np.int64), lengths, runs.left[at], back, runs.doc[at])
        hit = np.flatnonzero(most >= 0)
        found.append((owner[pairs[hit, 0]], runs.use[at[hit]], most[hit].astype(np.uint8), least[hit].astype(np.uint8)))
    if not found:
        return []
    run, *rest = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(run, kind="stable")
    names, first = np.unique(run[order], return_index=True)
    parts = [np.split(x[order], first[1:]) for x in rest]
    return [(runs.numbers[r], *each) for r, *each in zip(names.tolist(), *parts)]


def _union(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans of what [start, end) cover together; touching ones are one."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate((start[:1] >= 0, start[1:] > reach[:-1]))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:] - 1, [len(start) - 1])) if len(first) else first
    return start[first], reach[last]


def _buckets(chunks: DataFrame) -> int:
    """Parts in which runs are merged: as the text grows, whatever the shuffle partitions."""
    return max(partitions(chunks.sparkSession), -(-staged_bytes(chunks) // BUCKET))


def repeated_bytes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), and `spans` and `kept` if asked.

    Removed is every byte of a text's UTF-8 form that a string of LENGTH bytes covers
    which also starts in a document with a smaller id; all are judged on the input. A
    null text is empty; texts under LENGTH bytes lose nothing. Rows of one id never
    count against each other, and each has its result; rows without an id are left out.
    `spans` are the removed (start, end); `kept` is the rest, bytes.
    """
    chunks = pack_docs(ship(docs), id_col, text_col, BLOB)
    buckets = _buckets(chunks)
    flags = shared_keys(chunks, _keys_of, buckets)

    def sort_runs(key, mine: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        out = []
        for number, blob in zip(mine["chunk"], mine["blob"]):
            pieces = list(_pieces(blob))
            keys, where = np.unique(np.concatenate([p.hash for p in pieces]), return_inverse=True)
            shared = read_flags(keys, buckets, replies)
            shared = (shared | _in_two(pieces, keys, where))[where]
            out += [(number, b, data) for b, data in _runs_of(pieces, number, shared, buckets)]
        return pd.DataFrame(out, columns=["chunk", "bucket", "data"])

    sorted_runs = (
        chunks.groupBy("chunk")
        .cogroup(flags.groupBy("chunk"))
        .applyInPandas(sort_runs, "chunk bigint, bucket int, data binary")
    )
    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for number, place, most, least in _reduce(rows["data"]):
            body = place.tobytes() + most.tobytes() + least.tobytes()
            out.append((number, zstandard.compress(body)))
        return pd.DataFrame(out, columns=["chunk", "data"])

    found = sorted_runs.groupBy("bucket").applyInPandas(merge, "chunk bigint, data binary")

    def cut(key, mine: pd.DataFrame, repeats: pd.DataFrame) -> pd.DataFrame:
        out = []
        for blob in mine["blob"]:
            out += _cut(blob, repeats, with_text)
        return pd.DataFrame(out, columns=names)

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    if with_text:
        schema += ", spans array<array<bigint>>, kept binary"
    names = [c.split()[0] for c in schema.split(", ")]
    return chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInPandas(cut, schema)


def _cut(blob: bytes, repeats: pd.DataFrame, with_text: bool) -> list[tuple]:
    places, most, least = [np.zeros(0, "<u4")], [np.zeros(0, np.uint8)], [np.zeros(0, np.uint8)]
    for data in repeats["data"]:
        raw = zstandard.decompress(data)
        n = len(raw) // 6
        places.append(np.frombuffer(raw, "<u4", n))
        most.append(np.frombuffer(raw, np.uint8, n, 4 * n))
        least.append(np.frombuffer(raw, np.uint8, n, 5 * n))
    use, most, least = (np.concatenate(x) for x in (places, most, least))
    order = np.argsort(use, kind="stable")
    use, most, least = use[order].astype(np.int64), most[order], least[order]
    out, first = [], 0
    for piece in _pieces(blob):
        s = slice(*np.searchsorted(use, (first, first + len(piece.at))))
        out += _cut_piece(piece, use[s] - first, most[s], least[s], with_text)
        first += len(piece.at)
    return out


def _cut_piece(chunk: _Chunk, use: np.ndarray, most: np.ndarray, least: np.ndarray, with_text: bool) -> list[tuple]:
    """`use`: anchors of stretches that repeat, as far as _repeats tells."""
    keys, where = np.unique(chunk.hash, return_inverse=True)
    own, _, _, _, _, later = _later(chunk, np.flatnonzero(_in_two([chunk], keys, where)[where]))
    own = own[later]
    own = own[chunk.before[own] + GRAM + chunk.behind[own] >= LENGTH]
    owner = np.concatenate((chunk.doc[own], chunk.doc[use]))
    start = np.concatenate((chunk.at[own] - chunk.before[own], chunk.at[use] - most))
    end = np.concatenate((chunk.at[own] + GRAM + chunk.behind[own], chunk.at[use] - least + LENGTH))
    order = np.argsort(owner, kind="stable")
    owner, start, end = owner[order], start[order], end[order]
    bounds = np.searchsorted(owner, np.arange(len(chunk.ids) + 1))
    text = chunk.text.tobytes()
    out = []
    for d, doc_id in enumerate(chunk.ids.tolist()):
        first = int(chunk.ends[d] - chunk.sizes[d])
        last = int(chunk.ends[d])
        a, z = _union(start[bounds[d] : bounds[d + 1]], end[bounds[d] : bounds[d + 1]])
        edges = [first, *(x for pair in zip(a.tolist(), z.tolist()) for x in pair), last]
        kept = b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
        row = (doc_id, last - first, last - first - len(kept), len(a), hashlib.sha256(kept).hexdigest())
        if with_text:
            row += ([[x - first, y - first] for x, y in zip(a.tolist(), z.tolist())], kept)
        out.append(row)
    return out
