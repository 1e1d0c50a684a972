"""SentencePiece encoding and decoding: an automaton over the pieces drives Viterbi."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import ship

SPACE = "▁"  # fixed value: stands for a space in the pieces
_MARK = SPACE.encode()
#: Words a worker remembers with their ids; when full it starts again, the ids are the same.
MEMORY = 500_000
#: Places for pairs of pieces that a worker remembers as apart or not, a power of two; a new pair
#: takes the place of the one before it.
PAIRS = 1 << 21
#: What an unknown character costs beside the worst piece.
UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class Automaton:
    """Aho-Corasick over the pieces' bytes.

    `step[state * 256 + byte]` is the next state with all failure links followed;
    `piece[state]` the piece that ends there or -1, `link[state]` the next shorter state
    that ends a piece or 0. `ids` is None for a model whose best segmentation is that of
    the highest sum of scores; for a model of merges it holds the id of each piece's
    text, and scores are the order of the merges.
    """

    step: np.ndarray
    piece: np.ndarray
    link: np.ndarray
    length: np.ndarray
    score: np.ndarray
    byte_id: np.ndarray
    unknown: float
    texts: tuple[bytes, ...]
    ids: dict[bytes, int] | None = None
    apart: np.ndarray = field(default_factory=lambda: np.full(PAIRS, -1, np.int64), compare=False)


def merge(word: bytes, auto: Automaton) -> list[int]:
    """A word's ids by the merges themselves: of the neighbours whose joint text is a piece,
    those of the best score are joined first, of equal scores the leftmost. A character that
    is no piece has id -1."""
    ids, score = auto.ids, auto.score
    parts: list[bytes | None] = [c.encode() for c in word.decode()]
    n = len(parts)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        p = ids.get(parts[i] + parts[i + 1])
        if p is not None:
            heap.append((-score[p], i, p))
    heapify(heap)
    while heap:
        _, i, p = heappop(heap)
        j = after[i]
        # an entry whose parts have been joined to others since then is void
        if parts[i] is None or j >= n or len(parts[i]) + len(parts[j]) != auto.length[p]:
            continue
        if parts[i] + parts[j] != auto.texts[p]:
            continue
        parts[i], parts[j] = auto.texts[p], None
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for a, z in ((before[i], i), (i, after[i])):
            if a >= 0 and z < n:
                p = ids.get(parts[a] + parts[z])
                if p is not None:
                    heappush(heap, (-score[p], a, p))
    return [ids.get(part, -1) for part in parts if part is not None]


def _apart(first: np.ndarray, second: np.ndarray, auto: Automaton) -> np.ndarray:
    """Of each pair of pieces, whether the merges of their joint text leave just the two."""
    key = first.astype(np.int64) << 32 | second
    place = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - PAIRS.bit_length())
    held = auto.apart[place]
    out = (held & 1).astype(bool)
    new = np.flatnonzero(held >> 1 != key)
    if len(new):
        keys, back = np.unique(key[new], return_inverse=True)
        found = np.zeros(len(keys), bool)
        for k, (a, b) in enumerate(zip((keys >> 32).tolist(), (keys & 0xFFFFFFFF).tolist())):
            both = auto.texts[a] + auto.texts[b]
            found[k] = both not in auto.ids and merge(both, auto) == [a, b]
        out[new] = found[back]
        auto.apart[place[new]] = key[new] << 1 | out[new]
    return out


def build_automaton(
    pieces: list[tuple[str, float]], byte_ids: list[int], skipped: frozenset[int], merges: bool = False
) -> Automaton:
    """`pieces`: text and score by id; `skipped`: ids that match no text; `byte_ids`: of the 256 bytes.

    `merges`: the model joins neighbours in the order of scores. Pieces that its merges
    never make of their own text are left out.
    """
    texts = [t.encode() for t, _ in pieces]
    if merges:
        plain = Automaton(
            *[np.zeros(0, np.int32)] * 3,
            np.array([len(t) for t in texts], np.int64),
            np.array([s for _, s in pieces], np.float64),
            np.zeros(0, np.int64),
            0.0,
            tuple(texts),
            {texts[i]: i for i in range(len(texts)) if i not in skipped},
        )
        skipped = skipped.union(
            i for i in range(len(texts)) if i not in skipped and merge(texts[i], plain) != [i]
        )
    scores = np.array([s for _, s in pieces], np.float64)
    children: list[dict[int, int]] = [{}]
    piece = [-1]
    for i in sorted(set(range(len(texts))) - skipped, key=lambda i: texts[i]):
        at = 0
        for byte in texts[i]:
            nxt = children[at].get(byte)
            if nxt is None:
                nxt = children[at][byte] = len(children)
                children.append({})
                piece.append(-1)
            at = nxt
        if at:
            piece[at] = i
    n = len(children)
    step = np.zeros((n, 256), np.int32)
    fail, link = np.zeros(n, np.int32), np.zeros(n, np.int32)
    level = [0]
    while level:
        following = []
        for at in level:
            # a failed step is the step of the longest proper suffix
            step[at] = step[fail[at]] if at else 0
            for byte, child in children[at].items():
                fail[child] = step[fail[at], byte] if at else 0
                step[at, byte] = child
                suffix = fail[child]
                link[child] = suffix if piece[suffix] >= 0 else link[suffix]
                following.append(child)
        level = following
    usable = [i for i in range(len(texts)) if i not in skipped]
    return Automaton(
        step.ravel(),
        np.array(piece, np.int32),
        link,
        np.array([len(t) for t in texts], np.int64),
        scores,
        np.array(byte_ids, np.int64),
        float(scores[usable].min()) - UNKNOWN_PENALTY if usable else -UNKNOWN_PENALTY,
        tuple(texts),
        plain.ids if merges else None,
    )


@lru_cache(maxsize=1)
def load(path: str) -> Automaton:
    """The automaton of a model file. Its pieces must begin, never continue, with a space mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(n)]
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    skipped = frozenset(
        i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    )
    if any(SPACE in t.lstrip(SPACE) for i, (t, _) in enumerate(pieces) if i not in skipped):
        raise ValueError("a piece of this model crosses words")
    # a model of merges numbers them: whole numbers from 0 down, all others have logarithms
    merges = all(s <= 0 and s == int(s) for i, (_, s) in enumerate(pieces) if i not in skipped)
    return build_automaton(pieces, byte_ids, skipped, merges)


def segment(words: list[bytes], auto: Automaton) -> list[bytes]:
    """Each word's ids (32-bit) on its best path, all words in step, byte by byte.

    One pass: at each byte the automaton takes one step, and along the output links every
    piece that ends here relaxes the best score of this place. A character that no piece
    covers alone costs `unknown` and becomes its bytes. Of equal scores the longest last
    piece stays.

    In a model of merges a piece relaxes a place only if the merges leave it and the piece
    before it apart. So every place has one way to it, the merges' own; longer pieces are
    asked first, and a place that is reached asks no more. A word that ends unreached is
    merged step by step.
    """
    out: list[bytes] = [b""] * len(words)
    order = sorted(range(len(words)), key=lambda i: -len(words[i]))
    at = 0
    while at < len(order):
        # words of like length together, so that the table has little unused room
        most = len(words[order[at]])
        end = at
        room = max(1, (1 << 21) // (most + 1))
        while end < len(order) and end - at < room and 2 * len(words[order[end]]) >= most:
            end += 1
        group = order[at:end]
        for i, ids in zip(group, _segment([words[i] for i in group], auto)):
            out[i] = ids
        at = end
    return out


def _segment(words: list[bytes], auto: Automaton) -> list[bytes]:
    """`segment` for words of falling length; tables have a row for each place of a word."""
    n, most = len(words), len(words[0])
    size = np.array([len(w) for w in words])
    text = np.zeros((n, most), np.uint8)
    text[np.arange(most) < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    text = np.ascontiguousarray(text.T)
    best = np.full((most + 1, n), -np.inf)
    best[0] = 0.0
    came = np.zeros((most + 1, n), np.int32)  # length of the last piece
    used = np.full((most + 1, n), -1, np.int32)  # its id, -1 for an unknown character
    flat_best, flat_came, flat_used = best.ravel(), came.ravel(), used.ravel()
    state = np.zeros(n, np.int32)
    begun = np.zeros(n, np.int64)  # where the character at hand begins
    live = n
    for i in range(most):
        while size[live - 1] <= i:
            live -= 1
        byte = text[i, :live]
        begun[:live][(byte & 0xC0) != 0x80] = i
        state = auto.step[(state[:live] << 8) | byte]
        here = np.where(auto.piece[state] >= 0, state, auto.link[state])
        on = np.flatnonzero(here)
        here = here[on]
        while len(on):
            p = auto.piece[here]
            length = auto.length[p]
            start = (i + 1 - length) * n + on
            score = flat_best[start] + auto.score[p]
            to = (i + 1) * n + on
            better = score > flat_best[to]
            if auto.ids is not None:
                # at a word's begin and after an unknown character every piece is apart
                asked = np.flatnonzero(better & (flat_used[start] >= 0))
                better[asked] = _apart(flat_used[start[asked]], p[asked], auto)
            to = to[better]
            flat_best[to], flat_came[to], flat_used[to] = score[better], length[better], p[better]
            here = auto.link[here]
            more = here > 0
            if auto.ids is not None:
                more &= ~better
            on, here = on[more], here[more]
        # the end of a character: the next byte begins one, or the word ends
        last = size[:live] == i + 1
        if i + 1 < most:
            last |= (text[i + 1, :live] & 0xC0) != 0x80
        w = np.flatnonzero(last)
        score = flat_best[begun[w] * n + w] + auto.unknown
        better = score > best[i + 1, w]
        if auto.ids is not None:
            # here a character is unknown only if it is no piece, reached or not
            for k in np.flatnonzero(better).tolist():
                better[k] = words[w[k]][begun[w[k]] : i + 1] not in auto.ids
        w, score = w[better], score[better]
        best[i + 1, w], came[i + 1, w], used[i + 1, w] = score, i + 1 - begun[w], -1
    # back along the paths, all words in step
    taken: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    reached = np.isfinite(best[size, np.arange(n)])
    on = np.flatnonzero((size > 0) & reached)
    where = size[on].astype(np.int64)
    while len(on):
        cell = where * n + on
        taken.append((on, flat_used[cell], where))
        where = where - flat_came[cell]
        on, where = on[where > 0], where[where > 0]
    none = np.zeros(0, np.int64)
    owner, ids, ends = (np.concatenate([none, *(t[k] for t in taken[::-1])]) for k in range(3))
    sort = np.argsort(owner, kind="stable")
    owner, ids, ends = owner[sort], ids[sort], ends[sort]
    bounds = np.searchsorted(owner, np.arange(n + 1)).tolist()
    raw = ids.astype("<u4").tobytes()
    out = [raw[4 * a : 4 * b] for a, b in zip(bounds, bounds[1:])]
    for k in np.unique(owner[ids < 0]).tolist():
        own = slice(bounds[k], bounds[k + 1])
        out[k] = _spell(ids[own], ends[own], words[k], auto).astype("<u4").tobytes()
    for k in np.flatnonzero(~reached).tolist():
        out[k] = _merged(words[k], auto)
    return out


def _merged(word: bytes, auto: Automaton) -> bytes:
    """`merge` as 32-bit ids, with the bytes of unknown characters."""
    found = np.array(merge(word, auto), np.int64)
    parts, at = [], 0
    for p in found.tolist():
        # an unknown character is one character long, by its first byte
        lead = word[at]
        at += int(auto.length[p]) if p >= 0 else 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        parts.append(at)
    return _spell(found, np.array(parts, np.int64), word, auto).astype("<u4").tobytes()


def _spell(ids: np.ndarray, ends: np.ndarray, word: bytes, auto: Automaton) -> np.ndarray:
    """The path with the bytes of its unknown characters."""
    out, start = [], 0
    for i, end in zip(ids, ends):
        out.extend([i] if i >= 0 else auto.byte_id[list(word[start:end])])
        start = end
    return np.array(out, np.int64)


class Encoder:
    def __init__(self, auto: Automaton):
        self.auto = auto
        self.known: dict[bytes, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers.

        A space is put before the text, and every space becomes a mark. No piece crosses
        from a word into the next mark, so the best path of a text is that of its words.
        """
        if len(self.known) > MEMORY:
            self.known = {}
        split = [_words(t) for t in texts]
        new = list({w for words in split for w in words}.difference(self.known))
        self.known.update(zip(new, segment(new, self.auto)))
        known = self.known.__getitem__
        return [b"".join(map(known, words)) for words in split]


def _words(text: str) -> list[bytes]:
    """A text's bytes, parted before each run of marks; the runs stay with what follows."""
    if not text:
        return []
    raw = text.encode()
    if _MARK not in raw and b"  " not in raw and raw[:1] != b" " and raw[-1:] != b" ":
        return [_MARK + w for w in raw.split(b" ")]
    raw = _MARK + raw.replace(b" ", _MARK)
    words, at = [], 0
    while at < len(raw):
        end = at
        while raw.startswith(_MARK, end):
            end += len(_MARK)
        end = raw.find(_MARK, end)
        end = len(raw) if end < 0 else end
        words.append(raw[at:end])
        at = end
    return words


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(load(path))


def decode_ids(ids: np.ndarray, auto: Automaton, spelled: dict[int, bytes]) -> str:
    """The text of ids: pieces and bytes joined, marks read as spaces, the first one dropped."""
    raw = b"".join(spelled[i] for i in ids.tolist()).replace(_MARK, b" ")
    return raw[1:].decode("utf-8", "replace")


def spelling(auto: Automaton) -> dict[int, bytes]:
    return dict(enumerate(auto.texts)) | {int(i): bytes([b]) for b, i in enumerate(auto.byte_id)}


def encode_documents(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, ids) for each row: the whole text's ids; none for an empty or null text.

    A row's ids depend on its text only, whatever its id, its copies or other columns.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(model)
        for b in batches:
            for a in range(0, len(b), 256):
                part = b.iloc[a : a + 256]
                ids = [np.frombuffer(x, "<i4") for x in coder.encode(list(part["t"]))]
                yield pd.DataFrame({"doc_id": part["i"].astype("Int64"), "ids": ids})

    rows = ship(docs).select(
        F.col(id_col).cast("bigint").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")
    )
    return rows.mapInPandas(encode, "doc_id bigint, ids array<int>")


def round_trips(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, decoded) for each row.

    `ids_crc32` is the CRC-32 of the ids as little-endian 32-bit integers, `decoded`
    whether decoding them gives the text again (a null text counts as empty).
    """

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(model)
        spelled = spelling(coder.auto)
        for b in batches:
            for a in range(0, len(b), 256):
                part = b.iloc[a : a + 256]
                ids = coder.encode(list(part["t"]))
                same = [
                    decode_ids(np.frombuffer(x, "<i4"), coder.auto, spelled) == t for x, t in zip(ids, part["t"])
                ]
                yield pd.DataFrame(
                    {
                        "doc_id": part["i"].astype("Int64"),
                        "n_pieces": [len(x) // 4 for x in ids],
                        "ids_crc32": [zlib.crc32(x) for x in ids],
                        "decoded": same,
                    }
                )

    rows = ship(docs).select(
        F.col(id_col).cast("bigint").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")
    )
    return rows.mapInPandas(check, "doc_id bigint, n_pieces bigint, ids_crc32 bigint, decoded boolean")


def encode_and_decode(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, ids, n_pieces, text) for each row: the whole text's ids, and the text decoded from them.

    Both ways in one task function, so that a worker holds the automaton once. A null text
    counts as empty; a row depends on its text only.
    """

    def both(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(model)
        spelled = spelling(coder.auto)
        for b in batches:
            for a in range(0, len(b), 256):
                part = b.iloc[a : a + 256]
                ids = [np.frombuffer(x, "<i4") for x in coder.encode(list(part["t"]))]
                yield pd.DataFrame(
                    {
                        "doc_id": part["i"].astype("Int64"),
                        "ids": ids,
                        "n_pieces": [len(x) for x in ids],
                        "text": [decode_ids(x, coder.auto, spelled) for x in ids],
                    }
                )

    rows = ship(docs).select(
        F.col(id_col).cast("bigint").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")
    )
    return rows.mapInPandas(both, "doc_id bigint, ids array<int>, n_pieces bigint, text string")


def decoded(ids: Column, model: str) -> Column:
    """The texts that arrays of ids stand for; null ids give null."""

    @F.pandas_udf("string")
    def decode(column: pd.Series) -> pd.Series:
        auto = load(model)
        spelled = spelling(auto)
        return column.map(lambda x: None if x is None else decode_ids(np.asarray(x), auto, spelled))

    return decode(ids)
