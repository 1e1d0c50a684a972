"""Approximate nearest neighbours: best bins of a hierarchical k-means tree, as many as recall needs."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import ship, stage


@dataclass(frozen=True)
class SearchParams:
    #: Neighbours of each query.
    k: int = 20
    #: Share of the true neighbours that the trial queries must find.
    recall: float = 0.95
    #: Queries of the trial, which are compared with every vector.
    trials: int = 192
    #: Children of a node of the tree.
    branches: int = 16
    #: Vectors that a leaf should hold, and how many leaves there are at most. What a query
    #: costs beside the comparisons grows with the leaves it opens, so their number is fixed
    #: and large leaves are compared block by block.
    leaf_rows: int = 32
    most_leaves: int = 256
    #: The tree is fitted on about so many vectors, and on so many bytes of them at most;
    #: every vector is put into a leaf.
    sample: int = 1 << 15
    sample_bytes: int = 1 << 26
    #: Vectors and queries of a leaf that meet in one task at a time.
    block: int = 4096
    seed: int = 13


# --- the tree ---------------------------------------------------------------------------


class Tree:
    """Hierarchical k-means. Node 0 is the root; `leaf[node]` is a leaf's number or -1.

    Vectors are scaled by the largest part and get one more part that brings all to the
    same length, the longest; a query gets a zero there. The nearest of these longer
    vectors by distance is then the one with the largest inner product.
    """

    def __init__(self, scale: float, longest: float, dims: int):
        self.scale, self.longest, self.dims = scale, longest, dims
        self.centres = np.zeros((1, dims + 1))
        self.children: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.leaf: list[int] = [0]
        self.leaves = 1

    def lengthened(self, x: np.ndarray) -> np.ndarray:
        x = x / self.scale
        rest = np.sqrt(np.maximum(self.longest - (x * x).sum(axis=1), 0.0))
        return np.column_stack([x, rest])

    def as_query(self, q: np.ndarray) -> np.ndarray:
        return np.append(q / self.scale, 0.0)

    def grow(self, x: np.ndarray, n: int, params: SearchParams) -> None:
        """Split the largest leaf until all are as small as wanted; `x` stands for n vectors."""
        rng = np.random.default_rng(params.seed)
        x = self.lengthened(x)
        wanted = params.leaf_rows * len(x) / max(n, 1)
        open_leaves = [(-len(x), 0, np.arange(len(x)))]
        while open_leaves and self.leaves < params.most_leaves:
            size, node, rows = heapq.heappop(open_leaves)
            if -size <= max(wanted, 1):
                break
            centres, of = _k_means(x[rows], params.branches, rng)
            if len(centres) < 2:
                continue  # copies of one vector
            first = len(self.leaf)
            self.children[node] = np.arange(first, first + len(centres))
            self.centres = np.concatenate([self.centres, centres])
            self.leaf[node] = -1
            for c in range(len(centres)):
                own = rows[of == c]
                self.children.append(np.zeros(0, np.int64))
                self.leaf.append(0)
                heapq.heappush(open_leaves, (-len(own), first + c, own))
            self.leaves += len(centres) - 1
        numbers = iter(range(self.leaves))
        self.leaf = [next(numbers) if i >= 0 else -1 for i in self.leaf]

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: from the root to the nearest child again and again."""
        x = self.lengthened(x)
        out = np.empty(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            kids = self.children[node]
            near = _distances(x[rows], self.centres[kids]).argmin(axis=1)
            todo += [(kids[c], rows[near == c]) for c in np.unique(near)]
        return out

    def best_bins(self, q: np.ndarray) -> Iterator[int]:
        """Leaves from the most promising one on: a queue of nodes by their centre's distance."""
        q = self.as_query(q)
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                yield self.leaf[node]
                continue
            kids = self.children[node]
            gaps = self.centres[kids] - q
            for d, kid in zip((gaps * gaps).sum(axis=1).tolist(), kids.tolist()):
                heapq.heappush(queue, (d, kid))


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances but for |x|²."""
    return (centres * centres).sum(axis=1) - 2.0 * (x @ centres.T)


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Centres and each row's centre; fewer than k where rows are alike."""
    centres = np.unique(x[rng.choice(len(x), min(k, len(x)), replace=False)], axis=0)
    if len(centres) < 2:
        # the sample may have met copies only
        other = np.flatnonzero((x != centres[0]).any(axis=1))
        if not len(other):
            return centres, np.zeros(len(x), np.int64)
        centres = np.concatenate([centres, x[other[:1]]])
    of = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        of = _distances(x, centres).argmin(axis=1)
        there, of = np.unique(of, return_inverse=True)
        sums = np.zeros((len(there), x.shape[1]))
        np.add.at(sums, of, x)
        centres = sums / np.bincount(of)[:, None]
    of = _distances(x, centres).argmin(axis=1)
    there, of = np.unique(of, return_inverse=True)
    return centres[there], of


# --- search -----------------------------------------------------------------------------


def _matrix(rows: pd.Series, dims: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    if rows.map(len).eq(dims).all():
        return np.array(rows.tolist(), np.float64).reshape(len(rows), dims)
    out = np.zeros((len(rows), dims))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def _nearest(q_ids, q, ids, x, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, vector's place, score) of each query's k nearest, ties to smaller ids.

    The product of matrices only finds who may be among them: its last digits depend on
    where a row stands. Scores are sums in one fixed order, so equal vectors score alike.
    """
    found = []
    with np.errstate(over="ignore", invalid="ignore"):
        room = np.abs(q).max(axis=1, initial=0.0) * np.abs(x).max(initial=0.0) * q.shape[1] * 1e-12
        for a in range(0, len(q), 256):
            near = np.nan_to_num(q[a : a + 256] @ x.T, nan=-np.inf)
            near[q_ids[a : a + 256, None] == ids] = -np.inf
            if len(ids) > k:
                bound = np.partition(near, -k, axis=1)[:, -k] - room[a : a + 256]
            else:
                bound = np.full(len(near), -np.inf)
            i, j = np.nonzero((near >= bound[:, None]) & (q_ids[a : a + 256, None] != ids))
            for lo in range(0, len(i), 1 << 16):
                u, v = i[lo : lo + (1 << 16)] + a, j[lo : lo + (1 << 16)]
                found.append((u, v, (q[u] * x[v]).sum(axis=1)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    u, v, score = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((ids[v], -score, u))
    u, v, score = u[order], v[order], score[order]
    nth = np.arange(len(u)) - np.searchsorted(u, u, "left")
    return u[nth < k], v[nth < k], score[nth < k]


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(v, e): rows with an id and a vector that is not zero and has only finite parts."""
    e = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("v"), e.alias("e"))
    kept = rows.where(F.col("v").isNotNull() & F.col("e").isNotNull())
    return kept.where(~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).where(
        F.exists("e", lambda x: x != 0.0)
    )


def fit(rows: DataFrame, params: SearchParams = SearchParams()) -> Tree:
    """A tree over (v, e), fitted on a bounded sample that the hash of the ids picks."""
    n, dims, scale = rows.agg(
        F.count(F.lit(1)), F.max(F.size("e")), F.max(F.array_max(F.transform("e", F.abs)))
    ).first()
    if not n:
        return Tree(1.0, 0.0, 0)
    size = max(1, min(params.sample, params.sample_bytes // (8 * dims)))
    share = F.pmod(F.xxhash64("v", F.lit(params.seed)), F.lit(1 << 30)) < int(min(1.0, size / n) * (1 << 30))
    length = F.aggregate("e", F.lit(0.0), lambda s, x: s + (x / scale) * (x / scale))
    tree = Tree(scale, rows.agg(F.max(length)).first()[0], dims)
    # twice the wanted size only if ids repeat
    sample = rows.where(share).select("e").limit(2 * size).toPandas()["e"]
    if len(sample):
        tree.grow(_matrix(sample, dims), n, params)
    return tree


def _visits(trials: pd.DataFrame, truth: pd.DataFrame, tree: Tree, params: SearchParams) -> int:
    """How many best leaves the trial queries must open to find the wanted share."""
    nth = []
    of = {q: rows["leaf"].to_numpy() for q, rows in truth.groupby("query_id")}
    for q, e in zip(trials["v"], _matrix(trials["e"], tree.dims)):
        place = np.empty(tree.leaves, np.int64)
        for i, leaf in enumerate(tree.best_bins(e)):
            place[leaf] = i
        nth.append(place[of.get(q, np.zeros(0, np.int64))])
    nth = np.concatenate([np.zeros(0, np.int64), *nth])
    visits = 1
    while visits < tree.leaves and (nth < visits).mean() < params.recall:
        visits += max(1, visits // 8)
    return min(visits, tree.leaves)


def search(
    vectors: DataFrame,
    asks: Column,
    params: SearchParams = SearchParams(),
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest of each row for which `asks` holds.

    Nearness is the inner product in double precision; ties go to the smaller id. A
    query's candidates are all rows but those of its own id. Trial queries, at most
    `trials`, are first compared with every vector; each query then opens as many of its
    best leaves as these needed to find `recall` of their true neighbours, and more while
    they hold fewer than k other vectors.

    Rows whose id or vector is null, whose vector is empty, zero or has null or non-finite
    parts take no part. A shorter vector counts as filled up with zeros. Rows that repeat
    an id are candidates each; as a query, the smallest vector of an id stands. An empty
    table gives no rows. Other columns are read by `asks` only. A leaf of any size is cut
    into blocks, and so are its queries.
    """
    spark = vectors.sparkSession
    k = params.k
    tree = fit(usable(vectors, id_col, vector_col), params)
    shared = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a in range(0, len(b), 4096):
                part = b.iloc[a : a + 4096]
                yield part.assign(leaf=shared.value.place(_matrix(part["e"], shared.value.dims)))

    rows = ship(usable(vectors, id_col, vector_col))
    held = stage(rows.mapInPandas(place, "v bigint, e array<double>, leaf bigint"), "leaves")
    asking = usable(vectors.where(asks), id_col, vector_col)
    queries = stage(asking.groupBy("v").agg(F.min("e").alias("e")), "queries")

    # the trial
    trials = queries.orderBy(F.xxhash64("v", F.lit(params.seed)), "v").limit(params.trials).toPandas()
    tried = spark.sparkContext.broadcast(
        (trials["v"].to_numpy(np.int64), _matrix(trials["e"], tree.dims) if len(trials) else np.zeros((0, tree.dims)))
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q_ids, q = tried.value
        best = pd.DataFrame({"query_id": [], "vec_id": [], "leaf": [], "score": []})
        for b in batches:
            for a in range(0, len(b), params.block):
                part = b.iloc[a : a + params.block]
                ids = part["v"].to_numpy(np.int64)
                u, v, score = _nearest(q_ids, q, ids, _matrix(part["e"], tree.dims), k)
                now = pd.DataFrame(
                    {"query_id": q_ids[u], "vec_id": ids[v], "leaf": part["leaf"].to_numpy()[v], "score": score}
                )
                best = pd.concat([best, now]) if len(best) else now
                best = best.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
                best = best.groupby("query_id").head(k)
        yield best

    found = held.mapInPandas(compare, "query_id bigint, vec_id bigint, leaf bigint, score double")
    truth = _ranked(found, k).select("query_id", "leaf").toPandas()
    visits = _visits(trials, truth, tree, params)

    # which leaves each query opens
    sizes = dict(held.groupBy("leaf").count().collect())  # one row a leaf, at most `most_leaves`
    counts = spark.sparkContext.broadcast(sizes)

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, sizes = shared.value, counts.value
        for b in batches:
            chosen = []
            for e in _matrix(b["e"], tree.dims):
                opened, n = [], 0
                for leaf in tree.best_bins(e):
                    if len(opened) >= visits and n > k:
                        break
                    opened.append(leaf)
                    n += sizes.get(leaf, 0)
                chosen.append(opened)
            yield b.assign(leaves=chosen)

    opened = stage(queries.mapInPandas(choose, "v bigint, e array<double>, leaves array<bigint>"), "opened")
    visitors = dict(opened.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect())
    cuts = spark.createDataFrame(
        [(leaf, -(-n // params.block), -(-visitors.get(leaf, 0) // params.block)) for leaf, n in sizes.items()],
        "leaf bigint, parts int, sides int",
    )
    cuts = F.broadcast(cuts)  # one row a leaf
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ours = (
        held.join(cuts.where("sides > 0"), "leaf")
        .withColumn("part", F.pmod(F.monotonically_increasing_id(), F.col("parts")).cast("int"))
        .select("leaf", "part", every("sides").alias("side"), "v", "e")
    )
    theirs = (
        opened.select("v", "e", F.explode("leaves").alias("leaf"))
        .join(cuts, "leaf")
        .withColumn("side", F.pmod(F.xxhash64("v"), F.col("sides")).cast("int"))
        .select("leaf", every("parts").alias("part"), "side", "v", "e")
    )

    def meet(here: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(here) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        q_ids, ids = asked["v"].to_numpy(np.int64), here["v"].to_numpy(np.int64)
        u, v, score = _nearest(q_ids, _matrix(asked["e"], tree.dims), ids, _matrix(here["e"], tree.dims), k)
        return pd.DataFrame({"query_id": q_ids[u], "vec_id": ids[v], "score": score})

    near = (
        ours.groupBy("leaf", "part", "side")
        .cogroup(theirs.groupBy("leaf", "part", "side"))
        .applyInPandas(meet, "query_id bigint, vec_id bigint, score double")
    )
    return _ranked(near, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
