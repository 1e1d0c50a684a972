"""Quality scores from preference pairs: Bradley-Terry over features of the text."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import ship

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_HIGH = bytes(range(128, 256))
_SYMBOL = b"!#$%&*+<=>@[\\]^_`{|}~"
_WORDLY = re.compile(rb"[a-zA-Z\x80-\xff]$")

FEATURES = (
    "log_words", "word_length", "distinct", "top_word", "upper", "lower", "digit", "symbol",
    "high", "bang", "bar", "stops", "commas", "symbol_ends", "odd_ends", "line_words",
    "repeated_lines", "short_lines", "pressed", "longest_word",
)


@dataclass(frozen=True)
class QualityParams:
    #: Bound of the labelled rows that are fitted on, taken by hash of the id.
    max_labelled: int = 12_000
    #: Preference pairs for each labelled row of the rarer class.
    pairs_per_row: int = 12
    steps: int = 400
    penalty: float = 1e-3
    seed: int = 7


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def features(text: str) -> list[float]:
    """Shares and sizes of one whole text; an empty text has zeros."""
    raw = text.encode()
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    share = lambda drop: (size - len(raw.translate(None, drop))) / size
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ends = Counter(w[-1] for w in words)
    symbol_ends = sum(ends[c] for c in _SYMBOL)
    plain = sum(v for c, v in ends.items() if 97 <= c <= 122 or c >= 128)
    return [
        np.log1p(n),
        size / n,
        len(counts) / n,
        max(counts.values()) / n,
        share(_UPPER),
        share(_LOWER),
        share(_DIGIT),
        share(_SYMBOL),
        share(_HIGH),
        raw.count(b"!") / n,
        raw.count(b"|") / n,
        raw.count(b".") / n,
        raw.count(b",") / n,
        symbol_ends / n,
        (n - plain) / n,
        np.log1p(n / len(lines)),
        1 - len(set(lines)) / len(lines),
        sum(len(x) < 40 for x in lines) / len(lines),
        len(zlib.compress(raw, 1)) / size,
        np.log1p(max(map(len, counts))),
    ]


@dataclass(frozen=True)
class QualityModel:
    """Weights over hinges of each feature, and the score that parts the classes."""

    knots: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    spread: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return _hinges(x, self.knots, self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        away = np.clip((self.raw(x) - self.cut) / self.spread, -35, 35)
        return 1 / (1 + np.exp(-away))


def _hinges(x: np.ndarray, knots: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Each feature within its range, and what it has beyond each of its knots."""
    y = np.clip(x, knots[0], knots[-1])
    return np.concatenate([np.maximum(y - k, 0) / scale for k in knots[:-1]], axis=1)


def fit_pairs(x: np.ndarray, y: np.ndarray, params: QualityParams = QualityParams()) -> QualityModel:
    """Logistic loss on the feature differences of pairs (better, worse).

    Without rows of both labels every score is 0.5.
    """
    x, y = np.asarray(x, float).reshape(-1, len(FEATURES)), np.asarray(y, int)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        knots = np.zeros((2, len(FEATURES)))
        return QualityModel(knots, np.ones(len(FEATURES)), np.zeros(len(FEATURES)), 0.0, 1.0)
    knots = np.quantile(x, [0, 0.02, 0.1, 0.25, 0.5, 0.75, 0.9, 0.98, 1], axis=0)
    scale = x.std(axis=0) + 1e-9
    h = _hinges(x, knots, scale)
    rng = np.random.default_rng(params.seed)
    n = params.pairs_per_row * min(len(good), len(bad))
    better, worse = rng.choice(good, n), rng.choice(bad, n)
    w = np.zeros(h.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, params.steps + 1):
        s = h @ w
        lost = 1 / (1 + np.exp(np.clip(s[better] - s[worse], -35, 35)))
        pull = np.bincount(worse, lost, len(h)) - np.bincount(better, lost, len(h))
        g = pull @ h / n + params.penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    s = h @ w
    # the quantile of the scores below which the rows marked 0 would lie
    share = len(bad) / len(y)
    cut = float(np.quantile(s, share))
    return QualityModel(knots, scale, w, cut, float(s.std() / 4 + 1e-9))


def _feature_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return ship(docs).select(
        F.col(id_col).cast("bigint").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")
    )


def train(
    docs: DataFrame,
    labels: DataFrame,
    params: QualityParams = QualityParams(),
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> QualityModel:
    """Fit on at most `max_labelled` labelled rows that are not held out.

    Of an id with several labels the smallest counts; null labels and ids are left out.
    """
    marked = (
        labels.select(F.col(id_col).cast("bigint").alias("i"), F.col(label_col).alias("y"))
        .where(F.col("i").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("i")))
        .groupBy("i")
        .agg(F.min("y").cast("int").alias("y"))
        .orderBy(F.xxhash64("i"), "i")
        .limit(params.max_labelled)
    )

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "x": [features(t) for t in b["t"]]})

    rows = (
        _feature_rows(docs, id_col, text_col)
        .join(F.broadcast(marked), "i")
        .select("y", "t")
        .mapInPandas(extract, "y int, x array<double>")
        .toPandas()
    )
    rows["k"] = [tuple(x) for x in rows["x"]]
    rows = rows.sort_values(["k", "y"])  # the fit does not depend on the order of tasks
    return fit_pairs(np.array(rows["x"].tolist()), rows["y"].to_numpy(), params)


def score_documents(
    docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row; a null text is an empty one.

    Only the text enters a score, so equal texts score alike and repeated rows or other
    columns change nothing. A null id keeps its row, with held_out false.
    """

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array([features(t) for t in b["t"]]).reshape(len(b), len(FEATURES))
            yield pd.DataFrame({"i": b["i"].astype("Int64"), "score": model.score(x)})

    rows = _feature_rows(docs, id_col, text_col).mapInPandas(score, "i bigint, score double")
    return rows.select(
        F.col("i").alias("doc_id"),
        F.coalesce(held_out(F.col("i")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_quality(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, whose text is not rejected."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([features(t) for t in texts]).reshape(len(texts), len(FEATURES))
        return pd.Series(model.score(x))

    return ship(docs).where(score(F.coalesce(F.col(text_col), F.lit(""))) >= 0.5)
