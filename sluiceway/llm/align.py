"""Cross-tokenizer alignment: pointer jumping over overlapping tokens labels the groups."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import ship, stage

SPACE = "▁"  # fixed value: stands for a space in the second vocabulary's pieces
#: Words a worker remembers with their groups; when full it starts again, the groups are the same.
MEMORY = 400_000
#: Words with more characters are not remembered.
LONG = 100
#: Characters of new words that are encoded and aligned at once.
ROOM = 1 << 14
#: Links of documents that are looked up at once.
LINKS = 1 << 20

# --- alignment ------------------------------------------------------------------------


def terminals(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """For each token, those of the first sequence before those of the second, its component's last.

    Both sequences cover the same bytes; `a_ends` and `b_ends` are where their tokens end.
    Every token points to the token of the other sequence that covers its last byte, which
    is the farthest-right one that it overlaps; of two that end together, the one of the
    second sequence points to itself. The successor's successor is taken, for all tokens at
    once, until nothing changes: after k rounds a token has jumped 2^k steps.
    """
    n = len(a_ends)
    over_a = np.searchsorted(b_ends, a_ends, "left") + n
    over_b = np.searchsorted(a_ends, b_ends, "left")
    stays = a_ends[over_b] == b_ends
    after = np.concatenate([over_a, np.where(stays, np.arange(n, n + len(b_ends)), over_b)])
    while True:
        further = after[after]
        if np.array_equal(further, after):
            return after
        after = further


def _byte_of_char() -> dict[str, int]:
    """How byte-level vocabularies write a byte as a character: printable ones as they are."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Aligns whole texts, each word encoded and aligned once and remembered.

    No token of either vocabulary crosses from a word that ends in a visible character into
    the single space before the next visible one, so both end there and the groups of a
    text are those of its words.
    """

    def __init__(self, first: str, second: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        byte = _byte_of_char()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode()
            for i, p in enumerate(pieces)
        ]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece of the second vocabulary crosses words")
        self.a_size = np.array([len(x) for x in self.a_bytes])
        self.b_size = np.array([len(x) for x in self.b_bytes])
        self.wide = len(pieces)
        self.names = [str(i) for i in range(max(len(self.a_bytes), self.wide))]
        self._forget()

    @property
    def most_pairs(self) -> int:
        """Bound on the distinct linked pairs of ids, whatever the texts.

        Of two tokens that end together one is a suffix of the other; no two ids of the
        first vocabulary and at most two of the second (piece and byte) read the same.
        """
        return int(2 * self.a_size.sum() + self.b_size.sum())

    def _forget(self) -> None:
        self.known: dict[str, int] = {}  # by the word without its space; -1 where white space touches it
        self.odd: dict[str, int] = {}  # by a stretch that holds further white space
        self.groups: list[str] = []
        self.pairs: list[bytes] = []
        self.sizes = np.zeros((1 << 16, 3), np.int64)  # tokens of both and groups, by number

    # A text's parts are numbered; a number stands for groups, pairs and counts.

    def _whole(self, text: str) -> tuple[list[int], list[int], bool]:
        """Ids of space + text by both vocabularies, and whether both spell it."""
        (whole,) = self.a.encode_batch_fast([" " + text], add_special_tokens=False)
        a = whole.ids
        b = self.b.encode(text)
        raw = b" " + text.encode()
        same = b"".join(map(self.a_bytes.__getitem__, a)) == raw and b"".join(map(self.b_bytes.__getitem__, b)) == raw
        return a, b, same

    def _learn(self, into: dict[str, int], new: list[str]) -> None:
        held, room = [], 0
        for word in new:
            held.append(word)
            room += len(word) + 1
            if room >= ROOM:
                self._align(into, held)
                held, room = [], 0
        if held:
            self._align(into, held)

    def _align(self, into: dict[str, int], words: list[str]) -> None:
        """Number words; those that a vocabulary does not spell get -2."""
        text = " ".join(words)
        a, b, same = self._whole(text)
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        if same:
            a, b = np.array(a, np.int64), np.array(b, np.int64)
            a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
            same = bool(np.isin(ends, a_ends).all() and np.isin(ends, b_ends).all())
        if not same:
            if len(words) == 1:
                into[words[0]] = -2
                return
            half = len(words) // 2
            self._align(into, words[:half])
            self._align(into, words[half:])
            return
        last = terminals(a_ends, b_ends)
        group = np.cumsum(np.bincount(last, minlength=len(last)) > 0)[last] - 1
        n, m = len(a), len(b)
        # in the order of groups, the first sequence's tokens first
        order = np.argsort(2 * group + (np.arange(n + m) >= n), kind="stable")
        ids, of, second = np.concatenate([a, b])[order], group[order], order >= n
        ends_at = np.flatnonzero(np.diff(of, append=-1))
        begins = np.concatenate(([0], ends_at[:-1] + 1))
        done = b_ends[order[ends_at] - n]  # byte at which a group ends
        owner = np.searchsorted(ends, done, "left")  # its word
        mark = np.where(np.diff(second.astype(np.int8), prepend=1) == 1, 1, 0)
        mark[begins] = np.where(np.diff(owner, prepend=-1) > 0, 3, 2)
        marks = (",", "|", ";", "\n")
        written = "".join(chain.from_iterable(zip(
            map(marks.__getitem__, mark.tolist()), map(self.names.__getitem__, ids.tolist())
        )))[1:].split("\n")
        # the tokens that end together: the last of both sides of a group
        a_last = np.flatnonzero(np.diff(second.astype(np.int8), append=0) == 1)
        pair = ids[a_last] * self.wide + ids[ends_at]
        bounds = np.searchsorted(owner, np.arange(len(words) + 1))
        raw = pair.astype("<i8").tobytes()
        lo = bounds.tolist()
        start = len(self.groups)
        self.groups += written
        self.pairs += [raw[8 * x : 8 * y] for x, y in zip(lo, lo[1:])]
        while len(self.groups) > len(self.sizes):
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        sizes = self.sizes[start : len(self.groups)]
        sizes[:, 0] = np.diff(np.searchsorted(a_ends, ends, "right"), prepend=0)
        sizes[:, 1] = np.diff(np.searchsorted(b_ends, ends, "right"), prepend=0)
        sizes[:, 2] = np.diff(bounds)
        into.update(zip(words, range(start, start + len(words))))

    def align(self, texts: list[str]) -> list[tuple[int, int, int, str, np.ndarray]]:
        """Of each text: tokens by both vocabularies, groups, the groups' hash, linked pairs.

        An empty text and one that a vocabulary does not spell have none, and an empty hash.
        """
        if len(self.groups) > MEMORY:
            self._forget()
        split = [t.split(" ") for t in texts]
        new = set().union(*split).difference(self.known)
        plain = [w for w in new if w and not w[0].isspace() and not w[-1].isspace()]
        self.known.update(dict.fromkeys(new, -1))
        self._learn(self.known, plain)
        parts = [list(map(self.known.__getitem__, words)) for words in split]
        for k, numbers in enumerate(parts):
            if texts[k] and -1 in numbers:
                stretches = _BREAK.split(texts[k])
                self._learn(self.odd, list(set(stretches).difference(self.odd)))
                parts[k] = list(map(self.odd.__getitem__, stretches))
        out = []
        for text, numbers in zip(texts, parts):
            if text and -2 in numbers:
                numbers = self._apart(text)
            if not text or not numbers:
                out.append((0, 0, 0, "", _NONE))
                continue
            n_a, n_b, n_groups = self.sizes[np.array(numbers)].sum(axis=0).tolist()
            written = ";".join(map(self.groups.__getitem__, numbers)).encode()
            pairs = np.frombuffer(b"".join(map(self.pairs.__getitem__, numbers)), "<i8")
            out.append((n_a, n_b, n_groups, hashlib.sha256(written).hexdigest(), pairs))
        for held in (self.known, self.odd):
            for word in [w for w in held if len(w) > LONG]:
                del held[word]
        return out

    def _apart(self, text: str) -> list[int]:
        """A text of which a word is not spelled alone: aligned as one word if it is as a whole."""
        if not self._whole(text)[2]:
            return []
        alone: dict[str, int] = {}
        self._align(alone, [text])
        return [alone[text]]


_NONE = np.zeros(0, np.int64)
_BREAK = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=1)
def aligner(first: str, second: str) -> Aligner:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Aligner(first, second)


# --- links and their counts -------------------------------------------------------------


def _press(pairs: np.ndarray) -> bytes:
    """Pairs, sorted, as differences, byte plane by byte plane."""
    gaps = np.diff(np.sort(pairs), prepend=0).astype("<i8")
    return zstandard.ZstdCompressor(level=1).compress(gaps.view(np.uint8).reshape(-1, 8).T.tobytes())


def _open(bags: list[bytes]) -> np.ndarray:
    """The pairs of documents, one document behind the other."""
    plain = zstandard.ZstdDecompressor().decompress
    found = [np.frombuffer(plain(b), np.uint8) for b in bags if b]
    found = [np.cumsum(x.reshape(8, -1).T.copy().view("<i8").ravel()) for x in found]
    return np.concatenate(found) if found else _NONE


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches cut so that a cut holds about LINKS links, or one document."""
    for b in batches:
        piece = (np.cumsum(b["n_links"].to_numpy()) // LINKS).tolist()
        a = 0
        for z in range(1, len(b) + 1):
            if z == len(b) or piece[z] != piece[a]:
                yield b.iloc[a:z]
                a = z


def _summed(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(pairs, return_inverse=True)
    return distinct, np.bincount(at, counts, len(distinct)).astype(np.int64)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count): how many links of all documents hold it. A task sends each pair once."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, counts = _NONE, _NONE
        for b in _slices(batches):
            some = _open(list(b["bag"]))
            pairs, counts = _summed(
                np.concatenate([pairs, some]), np.concatenate([counts, np.ones(len(some), np.int64)])
            )
        yield pd.DataFrame({"pair": pairs, "count": counts})

    sent = aligned.select("n_links", "bag").where("n_links > 0").mapInPandas(count, "pair bigint, count bigint")
    return sent.groupBy("pair").agg(F.sum("count").alias("count"))


def align_documents(
    docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Align the tokens of space + text by two vocabularies, in every row's whole text.

    `first` is a byte-level vocabulary's file, `second` a model file that marks spaces.
    Per row: doc_id, n_a, n_b (tokens), n_groups, n_links (pairs of tokens that end
    together), n_best (links whose pair's count is the highest of its second id), count_sum
    (counts of its links added up), groups_sha256. A pair's count is over all documents.

    A null or empty text, or one that the ids of a vocabulary do not spell, has zeros and an
    empty hash. Rows without an id and rows of one id are rows like all others. Other
    columns are not read. Texts are encoded once: their links are kept in the shared folder.
    The counted pairs are broadcast; `Aligner.most_pairs`, which only the vocabularies
    decide, bounds them (about 0.8 million, 17 bytes each, for vocabularies of 50,000 and
    32,000 ids).
    """
    schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, bag binary"

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = aligner(first, second)
        for b in batches:
            for a in range(0, len(b), 256):
                part = b.iloc[a : a + 256]
                found = both.align(list(part["t"]))
                n_a, n_b, n_groups, hashes, pairs = zip(*found)
                yield pd.DataFrame(
                    {
                        "doc_id": part["i"].astype("Int64").to_numpy(),
                        "n_a": n_a,
                        "n_b": n_b,
                        "n_groups": n_groups,
                        "n_links": [len(p) for p in pairs],
                        "groups_sha256": hashes,
                        "bag": [_press(p) if len(p) else b"" for p in pairs],
                    }
                )

    rows = ship(docs).select(
        F.col(id_col).cast("bigint").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")
    )
    aligned = stage(rows.mapInPandas(encode, schema), "aligned")
    table = pair_counts(aligned).toPandas().sort_values("pair")
    pairs, counts = table["pair"].to_numpy(np.int64), table["count"].to_numpy(np.int64)
    wide = _pieces(second)
    best = np.zeros(wide, np.int64)
    np.maximum.at(best, pairs % wide, counts)
    shared = docs.sparkSession.sparkContext.broadcast((pairs, counts, counts == best[pairs % wide]))

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, counts, top = shared.value
        for b in _slices(batches):
            n = b["n_links"].to_numpy()
            at = np.searchsorted(pairs, _open(list(b["bag"])))
            owner = np.repeat(np.arange(len(b)), n)
            yield b.drop(columns="bag").assign(
                n_best=np.bincount(owner[top[at]], minlength=len(b)),
                count_sum=_group_sum(counts[at], n),
            )[columns]

    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return aligned.mapInPandas(
        look_up, ", ".join(f"{c} string" if c == "groups_sha256" else f"{c} bigint" for c in columns)
    )


def _group_sum(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whole sums of runs of `sizes` values each."""
    ends = np.concatenate(([0], np.cumsum(values)))
    at = np.cumsum(sizes)
    return ends[at] - ends[at - sizes]


@lru_cache(maxsize=1)
def _pieces(second: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=second).get_piece_size()
