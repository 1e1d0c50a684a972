"""Benchmark decontamination: BM25 over test items, searched by block-max WAND."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import ship

_FOLD = bytes(
    32 if chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else c + 32 if 65 <= c <= 90 else c for c in range(256)
)
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


#: Ranges of items for which passages are bounded at once.
RANGES = 256


@dataclass(frozen=True)
class LeakParams:
    k1: float = 1.2
    b: float = 0.75
    #: Share of an item's score against itself that a passage must reach.
    threshold: float = 0.5
    #: Share of the question's and of the answer's shingles that the passage must hold,
    overlap: float = 0.5
    #: or of the whole item's.
    whole: float = 0.7
    shingle: int = 5
    #: Postings in a block of the index.
    block: int = 32
    #: Bytes of item text in one index; further items go to further indexes.
    index_bytes: int = 16 << 20


def words_of(text: str) -> list[bytes]:
    """Words by white space and ASCII punctuation, A-Z lowered."""
    return text.encode().translate(_FOLD).split()


def _shingles(words: list[bytes], k: int) -> set[tuple[bytes, ...]]:
    k = min(k, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()


def question_answer(text: str) -> tuple[str, str]:
    """The last sentence is the answer; of a single sentence, both are the whole."""
    parts = [p for p in _SENTENCE.split(text) if words_of(p)]
    return (text, text) if len(parts) < 2 else (" ".join(parts[:-1]), parts[-1])


class Index:
    """Items' postings in blocks with their largest weight.

    A weight is the term's BM25 weight in an item as a share of the item's score against
    itself, so one threshold holds for all items.
    """

    def __init__(self, items: list[tuple[int, str]], n_items: int, mean_words: float, df: dict[bytes, int], params: LeakParams):
        self.params = params
        self.ids, self.words, self.parts = [], [], []
        postings: dict[bytes, list[tuple[int, float]]] = defaultdict(list)
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            weight = {}
            for term, tf in Counter(words).items():
                idf = math.log(1 + (n_items - df[term] + 0.5) / (df[term] + 0.5))
                near = params.k1 * (1 - params.b + params.b * len(words) / mean_words)
                weight[term] = idf * tf * (params.k1 + 1) / (tf + near)
            whole = sum(weight.values())
            nth = len(self.ids)
            self.ids.append(item_id)
            self.words.append(words)
            question, answer = question_answer(text)
            self.parts.append(
                tuple(_shingles(words_of(x), params.shingle) for x in (question, answer, text))
            )
            for term, w in weight.items():
                postings[term].append((nth, w / whole))
        self.longest = max(map(len, self.words), default=0)
        self.vocabulary = {t: i for i, t in enumerate(postings)}
        self.lists = [np.array([d for d, _ in p]) for p in postings.values()]
        self.weights = [np.array([w for _, w in p]) for p in postings.values()]
        size = params.block
        self.most = [float(w.max()) for w in self.weights]
        self.block_most = [
            [float(w[a : a + size].max()) for a in range(0, len(w), size)] for w in self.weights
        ]
        self.block_last = [
            [int(d[min(a + size, len(d)) - 1]) for a in range(0, len(d), size)] for d in self.lists
        ]
        self.docs = [d.tolist() for d in self.lists]
        self.shares = [w.tolist() for w in self.weights]
        # the most that a term adds to an item of each range of items, at most RANGES of them
        wide = max(1, -(-len(self.ids) // RANGES))
        self.ranges = np.zeros((len(postings), max(1, -(-len(self.ids) // wide))), np.float32)
        for t, (docs, shares) in enumerate(zip(self.lists, self.weights)):
            np.maximum.at(self.ranges[t], docs // wide, shares.astype(np.float32))

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items whose score with these distinct terms reaches the threshold."""
        size = self.params.block
        found = []
        at = {t: 0 for t in terms}
        live = list(terms)
        while True:
            live = [t for t in live if at[t] < len(self.docs[t])]
            live.sort(key=lambda t: self.docs[t][at[t]])
            # the first item that the terms so far could bring above the threshold
            bound, pivot = 0.0, -1
            for k, t in enumerate(live):
                bound += self.most[t]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = self.docs[live[pivot]][at[live[pivot]]]
            while pivot + 1 < len(live) and self.docs[live[pivot + 1]][at[live[pivot + 1]]] == item:
                pivot += 1
            # the same with the blocks' own bounds
            bound, next_item = 0.0, math.inf
            for t in live[: pivot + 1]:
                block = at[t] // size
                last = self.block_last[t]
                while block < len(last) and last[block] < item:
                    block += 1
                if block < len(last):
                    bound += self.block_most[t][block]
                    next_item = min(next_item, last[block] + 1)
            if bound < threshold:
                # no item up to the nearest block end can reach it
                if pivot + 1 < len(live):
                    next_item = min(next_item, self.docs[live[pivot + 1]][at[live[pivot + 1]]])
                item = max(next_item, item + 1)
                for t in live[: pivot + 1]:
                    at[t] = _seek(self.docs[t], at[t], item)
            elif self.docs[live[0]][at[live[0]]] == item:
                score = 0.0
                for t in live[: pivot + 1]:
                    score += self.shares[t][at[t]]
                    at[t] += 1
                if score >= threshold:
                    found.append((item, score))
            else:
                for t in live[:pivot]:
                    at[t] = _seek(self.docs[t], at[t], item)

    def _passages(self, words: list[bytes], limit: float) -> Iterator[tuple[int, list[int]]]:
        """(first word, terms) of the passages whose bound for some range of items reaches the limit.

        A passage is two stretches of the longest item's words; a range's bound is the sum
        of what each distinct term adds at most to one of its items.
        """
        none = -1
        terms = np.fromiter(map(self.vocabulary.get, words, repeat(none)), np.int64, len(words))
        at = np.flatnonzero(terms >= 0)
        if not len(at):
            return
        many = len(self.vocabulary)
        pairs = np.unique((at // self.longest) * many + terms[at])
        part, term = np.divmod(pairs, many)
        parts = -(-len(words) // self.longest)
        total = np.zeros((parts + 1, self.ranges.shape[1]), np.float32)
        used, first = np.unique(part, return_index=True)
        total[used] = np.add.reduceat(self.ranges[term], first, axis=0)
        bound = total[:-1] + total[1:]
        # a term in both stretches counts once
        both = np.searchsorted(pairs, pairs + many)
        both[both == len(pairs)] = 0
        again = np.flatnonzero(pairs[both] == pairs + many)
        if len(again):
            owners, first = np.unique(part[again], return_index=True)
            bound[owners] -= np.add.reduceat(self.ranges[term[again]], first, axis=0)
        edges = np.searchsorted(part, np.arange(parts + 2))
        for i in np.flatnonzero((bound >= limit).any(axis=1)).tolist():
            if i + 1 < parts or parts == 1 or not bound[i - 1].max() >= limit:
                yield i * self.longest, np.unique(term[edges[i] : edges[i + 2]]).tolist()

    def leaks(self, text: str) -> list[tuple[int, float, float, float, float]]:
        """(item id, score, question, answer and whole overlap), the best passage of each verified id.

        Passages are windows of twice the longest item's words that overlap by half, so
        every item that stands in the text lies whole in one of them.
        """
        words = words_of(text)
        if not words or not self.longest:
            return []
        limit = self.params.threshold - 1e-9
        # by id, whose texts may be several
        best: dict[int, tuple] = {}
        for a, own in self._passages(words, limit - 1e-4):
            z = a + 2 * self.longest
            for item, score in self.search(own, limit):
                shingles: dict[int, set] = {}
                shares = []
                for part in self.parts[item]:
                    k = len(next(iter(part)))
                    if k not in shingles:
                        part_words = words[a:z]
                        shingles[k] = _shingles(part_words, k) if len(part_words) >= k else set()
                    shares.append(len(part & shingles[k]) / len(part))
                question, answer, whole = shares
                p = self.params
                if min(question, answer) >= p.overlap or whole >= p.whole:
                    row = (whole, score, question, answer)
                    item_id = self.ids[item]
                    best[item_id] = max(best.get(item_id, row), row)
        return [(i, s, q, w_a, w) for i, (w, s, q, w_a) in sorted(best.items())]


def _seek(docs: list[int], at: int, item: int) -> int:
    while at < len(docs) and docs[at] < item:
        at += 1
    return at


def build_indexes(items: DataFrame, params: LeakParams, id_col: str, text_col: str) -> Iterator[Index]:
    """One index for each `index_bytes` of item texts; counts are over all items.

    Each distinct text of an id is an item of its own, all of one id in one index; those
    without an id, a text or a word are left out.
    """
    split = lambda batches: (
        pd.DataFrame({"i": b["i"], "t": b["t"], "w": [words_of(t) for t in b["t"]]}) for b in batches
    )
    clean = (
        ship(items).select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t"))
        .where("i IS NOT NULL AND t IS NOT NULL")
        .distinct()
        .mapInPandas(split, "i bigint, t string, w array<binary>")
        .where(F.size("w") > 0)
    )
    n, mean, size = clean.agg(
        F.count(F.lit(1)), F.avg(F.size("w")), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))
    ).first()
    shards = max(1, -(-size // params.index_bytes))
    counts = clean.select(F.explode(F.array_distinct("w")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    for s in range(shards if n else 0):
        part = clean.where(F.pmod(F.xxhash64("i"), F.lit(shards)) == s)
        own = part.select(F.explode("w").alias("w")).distinct()
        df = {bytes(r["w"]): r["df"] for r in counts.join(own, "w", "left_semi").toLocalIterator()}
        rows = [(r["i"], r["t"]) for r in part.select("i", "t").orderBy("i", "t").toLocalIterator()]
        yield Index(rows, n, mean, df, params)


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    params: LeakParams = LeakParams(),
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, overlap) for every verified pair.

    Every passage of every whole text is a query. Null and empty texts hold nothing;
    rows are judged each by itself, so repeated rows repeat their pairs, and a null id
    gives null. Without items there are no pairs. Each index is sent to all tasks, and
    is bounded by `index_bytes`; documents are never shuffled.
    """
    rows = ship(docs).select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t"))
    schema = (
        "doc_id bigint, item_id bigint, score double, question_overlap double, "
        "answer_overlap double, overlap double"
    )
    out = docs.sparkSession.createDataFrame([], schema)
    spark = docs.sparkSession
    for index in build_indexes(items, params, item_id_col, item_text_col):
        out = out.unionByName(
            rows.where("t IS NOT NULL").mapInPandas(_search(spark.sparkContext.broadcast(index)), schema)
        )
    return out


def _search(shared):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for b in batches:
            found = [(i, *row) for i, t in zip(b["i"].astype("Int64"), b["t"]) for row in index.leaks(t)]
            if found:
                names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "overlap"]
                yield pd.DataFrame(found, columns=names).astype({"doc_id": "Int64"})

    return search


def drop_leaks(
    docs: DataFrame, items: DataFrame, params: LeakParams = LeakParams(), text_col: str = "text", **columns
) -> DataFrame:
    """The rows of `docs`, with all their columns, in whose text no item is found."""
    clean = F.lit(True)
    for index in build_indexes(items, params, columns.get("item_id_col", "item_id"), columns.get("item_text_col", "text")):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        clean = clean & _is_clean(shared)(F.coalesce(F.col(text_col), F.lit("")))
    return docs.where(clean)


def _is_clean(shared):
    @F.pandas_udf("boolean")
    def judge(texts: pd.Series) -> pd.Series:
        index = shared.value
        return pd.Series([not index.leaks(t) for t in texts], dtype=bool)

    return judge
