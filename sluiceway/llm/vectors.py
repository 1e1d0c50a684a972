"""Near-duplicate embeddings: sorted projection passes whose odds are kept for each vector, exact counts within classes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import components, partitions, ship, stage


@dataclass(frozen=True)
class VectorParams:
    cosine: float = 0.95
    #: Orders of the vectors, each by random hashes of its own; more find more.
    passes: int = 16
    #: Random hyperplanes whose signs, one behind the other, are an order's key.
    bits: int = 62
    #: Vectors behind a block that its vectors are compared with, too.
    window: int = 512
    #: Consecutive vectors of an order that are all compared.
    block: int = 4096
    seed: int = 11
    #: A vector is open while the odds that the passes missed a link of it are above this.
    miss: float = 1e-6
    #: Open vectors of a part, which are compared with all others.
    audit: int = 4096
    #: Rounds of passes, each of four times the window before.
    rounds: int = 4
    #: Up to so many parts' open vectors need no further round; a job compares so many parts.
    few: int = 8


def _unit(rows: pd.Series) -> np.ndarray:
    x = np.array(rows.tolist(), np.float64)
    # by the largest part first, so that no square overflows or vanishes
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _planes(params: VectorParams, nth: int, size: int) -> np.ndarray:
    return np.random.default_rng([params.seed, nth, size]).standard_normal((size, params.bits))


def _same_side(cosine: float) -> np.ndarray:
    """For a vector at i / 64 of a random plane: log of the odds that a vector so near lies on its side.

    With x at a, a vector of cosine c to x lies at c a + sqrt(1 - c^2) g, g normal and
    independent of a.
    """
    apart = math.sqrt(max(1 - cosine * cosine, 1e-18))
    return np.array([math.log(max(math.erfc(-cosine * i / 64 / apart / math.sqrt(2)) / 2, 1e-300)) for i in range(512)])


def _odds(x: np.ndarray, key: np.ndarray, planes: np.ndarray, ends: tuple[bool, bool], same: np.ndarray) -> np.ndarray:
    """-log of the odds that a link of each vector was missed, if all of these were compared.

    `key` is sorted; `ends` tells whether others may precede or follow. All vectors whose
    keys begin like a vector's lie here as soon as that beginning is neither the first
    key's nor the last's. So a link is missed only if a plane of that beginning parts it.
    """
    bits, shift = planes.shape[1], max(0, planes.shape[1] - 52)
    depth = np.zeros(len(key), np.int64)
    for there, end in zip(ends, (key[0], key[-1])):
        if there:
            # common beginnings of 52 bits or more count as no beginning of its own
            alike = (bits - shift) - np.frexp(((key ^ end) >> shift).astype(np.float64))[1]
            depth = np.maximum(depth, alike + 1)
    whole = depth <= bits - shift
    at = np.minimum(np.abs(x @ planes[:, : min(depth.max(), bits)]) * 64, len(same) - 1).astype(np.int64)
    logs = np.concatenate([np.zeros((len(x), 1)), np.cumsum(same[at], axis=1)], axis=1)
    found = np.exp(logs[np.arange(len(x)), np.where(whole, depth, 0)])
    return np.where(whole, -np.log1p(-np.minimum(found, 1 - 1e-15)), 0.0)


def _near(x: np.ndarray, y: np.ndarray, x32: np.ndarray, y32: np.ndarray, cosine: float) -> np.ndarray:
    """Which pairs are linked; single precision decides where its error cannot matter."""
    cos = x32 @ y32.T
    slack = 1e-6 + 2e-7 * x.shape[1]
    near = cos >= cosine - slack
    i, j = np.nonzero(near & (cos < cosine + slack))
    for a in range(0, len(i), 65536):
        p, q = i[a : a + 65536], j[a : a + 65536]
        near[p, q] = (x[p] * y[q]).sum(axis=1) >= cosine
    return near


def _orders(classes: DataFrame, params: VectorParams) -> DataFrame:
    """(pass, key, v, e): each vector in each pass, keyed by its signs."""

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        places = 1 << np.arange(params.bits - 1, -1, -1, dtype=np.int64)
        for b in batches:
            for a in range(0, len(b), 4096):
                part = b.iloc[a : a + 4096]
                for size, rows in part.groupby(part["e"].map(len)):
                    x = _unit(rows["e"])
                    for p in range(params.passes):
                        if (p, size) not in planes:
                            planes[p, size] = _planes(params, p, size)
                        key = ((x @ planes[p, size]) >= 0) @ places
                        yield pd.DataFrame({"pass": p, "dims": size, "key": key, "v": rows["v"], "e": rows["e"]})

    return classes.select("v", "e").mapInPandas(
        keyed, "pass int, dims int, key bigint, v bigint, e array<float>"
    )


def _linked(orders: DataFrame, params: VectorParams) -> DataFrame:
    """(a, b): verified links within blocks, as a forest of each; (a, seen): what a block's comparison
    leaves of the odds of a missed link (`_odds`)."""
    spark = orders.sparkSession

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = 0
        for b in batches:
            yield b.assign(part=TaskContext.get().partitionId(), nth=np.arange(n, n + len(b)))
            n += len(b)

    schema = "pass int, dims int, key bigint, v bigint, e array<float>, part int, nth bigint"
    ranked = stage(
        orders.repartitionByRange(partitions(spark), "pass", "dims", "key", "v")
        .sortWithinPartitions("pass", "dims", "key", "v")
        .select("pass", "dims", "key", "v", "e")
        .mapInPandas(numbered, schema),
        "ranked",
    )
    # one number for each partition
    counts = {r["part"]: r["n"] for r in ranked.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    bases, total = [], 0
    for part in sorted(counts):
        bases.append((part, total))
        total += counts[part]
    base = spark.createDataFrame(bases, "part int, base bigint")
    rank = F.col("base") + F.col("nth")
    placed = ranked.join(F.broadcast(base), "part").select(
        "pass", "dims", "key", "v", "e", rank.alias("rank"), F.floor(rank / params.block).alias("block")
    )
    # a block is compared with itself and the first vectors of the next
    ahead = placed.where((F.col("rank") % params.block < params.window) & (F.col("block") > 0))
    both = placed.unionByName(ahead.withColumn("block", F.col("block") - 1))

    same = _same_side(params.cosine)

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        v, keys = rows["v"].to_numpy(), rows["key"].to_numpy(np.int64)
        own = (rows["rank"] // params.block == rows["block"]).to_numpy()
        kind = rows["pass"].to_numpy().astype(np.int64) << 32 | rows["dims"].to_numpy()
        starts = np.flatnonzero(np.diff(kind, prepend=kind[0] - 1))
        out = []
        for lo, hi in zip(starts, [*starts[1:], len(rows)]):
            x = _unit(rows["e"].iloc[lo:hi])
            x32, label, found = x.astype(np.float32), np.arange(hi - lo), []
            for a in range(0, hi - lo, 256):
                near = _near(x[a : a + 256], x[a:], x32[a : a + 256], x32[a:], params.cosine)
                np.fill_diagonal(near, True)
                for i in np.flatnonzero(near.sum(axis=1) > 1):
                    others = a + np.flatnonzero(near[i])
                    others = others[label[others] != label[a + i]]
                    if len(others):
                        labels, first = np.unique(label[others], return_index=True)
                        found += [(v[lo + a + i], v[lo + j]) for j in others[first]]
                        label[np.isin(label, labels)] = label[a + i]
            out.append(pd.DataFrame(found, columns=["a", "b"], dtype="Int64").assign(seen=0.0))
            planes = _planes(params, int(kind[lo] >> 32), x.shape[1])
            seen = _odds(x, keys[lo:hi], planes, (lo == 0, hi == len(rows)), same)
            mine = own[lo:hi]
            none = pd.array([None] * int(mine.sum()), dtype="Int64")
            out.append(pd.DataFrame({"a": v[lo:hi][mine], "b": none, "seen": seen[mine]}))
        return pd.concat(out)

    return stage(both.groupBy("block").applyInPandas(compare, "a bigint, b bigint, seen double"), "compared")


def _missed(classes: DataFrame, linked: DataFrame, left: DataFrame, parts: int, nth: int, params: VectorParams) -> DataFrame:
    """(a, b): of all links of part `nth` of the vectors `left`, those between components, as forests."""
    spark = classes.sparkSession
    known = classes.join(linked, classes["v"] == linked["node"], "left").select(
        F.coalesce("component", "v").alias("c"), "v", "e"
    )
    drawn = known.where(F.pmod(F.xxhash64("v"), F.lit(parts)) == nth).join(left, "v", "left_semi").select("c", "e").toPandas()
    held = {
        size: (rows["c"].to_numpy(np.int64), _unit(rows["e"])) for size, rows in drawn.groupby(drawn["e"].map(len))
    }
    shared = spark.sparkContext.broadcast(held)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {size: (theirs, y, y.astype(np.float32)) for size, (theirs, y) in shared.value.items()}
        for b in batches:
            for size, rows in b.groupby(b["e"].map(len)):
                if size not in held:
                    continue
                theirs, y, y32 = held[size]
                mine, x = rows["c"].to_numpy(np.int64), _unit(rows["e"])
                x32 = x.astype(np.float32)
                pairs = []
                for a in range(0, len(rows), 512):
                    one = slice(a, a + 512)
                    for z in range(0, len(y), 4096):
                        two = slice(z, z + 4096)
                        i, j = np.nonzero(_near(x[one], y[two], x32[one], y32[two], params.cosine))
                        apart = mine[a + i] != theirs[z + j]
                        if apart.any():
                            pairs.append(np.unique(np.stack([mine[a + i], theirs[z + j]], 1)[apart], axis=0))
                if pairs:
                    names, at = np.unique(np.concatenate(pairs), return_inverse=True)
                    parent, found = list(range(len(names))), []
                    for one, other in at.reshape(-1, 2).tolist():
                        ra, rb = _root(parent, one), _root(parent, other)
                        if ra != rb:
                            parent[rb] = ra
                            found.append((names[one], names[other]))
                    yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return stage(known.select("c", "e").mapInPandas(check, "a bigint, b bigint"), "missed")


def _components(classes: DataFrame, params: VectorParams) -> DataFrame:
    """(node, component) over the links.

    Each pass tells for every vector how likely a link of it would have been missed; what
    the passes leave multiplies up. Vectors for which this is above `miss`, those in
    crowded places, go through further rounds, and in the end are compared with all. The
    number of rows decides nothing but how soon that is cheaper than another round.
    """
    need = -math.log(params.miss)
    tied = lambda x: x.select(F.col("node").alias("a"), F.col("component").alias("b"))
    linked = seen = None
    for nth in range(params.rounds):
        window = params.window * 4**nth
        now = replace(params, window=window, block=max(params.block, window), seed=params.seed + nth)
        compared = _linked(_orders(classes, now), now)
        links = compared.where("b IS NOT NULL").select("a", "b")
        linked = components(links if linked is None else links.unionByName(tied(linked)))
        told = compared.where("b IS NULL").select("a", "seen")
        seen = stage(
            (told if seen is None else told.unionByName(seen)).groupBy("a").agg(F.sum("seen").alias("seen")), "seen"
        )
        left = seen.where(F.col("seen") < need)
        n, mean = left.agg(F.count(F.lit(1)), F.coalesce(F.avg("seen"), F.lit(0.0))).first()
        # or the rounds left would not do at this pace
        if n <= params.few * params.audit or mean / (nth + 1) * params.rounds < need:
            break
    parts = -(-n // (max(1, params.few) * params.audit))
    left = left.select(F.col("a").alias("v"))
    missed = [_missed(classes, linked, left, parts, k, params) for k in range(parts)]
    if any(not m.isEmpty() for m in missed):
        linked = components(reduce(DataFrame.unionByName, missed, tied(linked)))
    return linked


def near_vectors(
    vectors: DataFrame,
    params: VectorParams = VectorParams(),
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each vector.

    Equal vectors are one class from the start. Classes are linked by sorted passes; those
    for which the passes may have missed links are compared with all (`_components`). The
    links within each set of reachable classes are then all counted, however many there
    are: classes within half the angle of one centre are all linked with each other and
    only counted, the rest are compared with all of their set in blocks.

    Null, empty, zero and non-finite vectors link with nothing. Rows of one id are one
    vector, the smallest; rows without an id are left out. Vectors of other lengths are
    compared with their like only.
    """
    spark = vectors.sparkSession
    rows = (
        ship(vectors).select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("e"))
        .where("vec_id IS NOT NULL")
        .groupBy("vec_id")
        .agg(F.min("e").alias("e"))
    )
    good = (F.size("e") > 0) & F.forall(
        "e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    valid = F.coalesce(good & F.exists("e", lambda x: x != 0), F.lit(False))
    rows = stage(rows.withColumn("ok", valid), "vectors")
    classes = stage(
        rows.where("ok").groupBy("e").agg(F.min("vec_id").alias("v"), F.count(F.lit(1)).alias("copies")),
        "classes",
    )
    linked = _components(classes, params)
    members = stage(
        classes.join(linked, classes["v"] == linked["node"]).select("component", "v", "copies", "e"), "members"
    )
    more = _count_links(members, params)
    each = (
        classes.join(linked, classes["v"] == linked["node"], "left")
        .join(more, classes["v"] == more["x"], "left")
        .select(
            "e",
            F.coalesce("component", "v").alias("component_id"),
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        )
    )
    found = rows.where("ok").select("vec_id", "e").join(each, "e")
    out = found.select("vec_id", "n_links", "component_id").unionByName(
        rows.where("NOT ok").select(
            "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")
        )
    )
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _count_links(members: DataFrame, params: VectorParams) -> DataFrame:
    """(x, links): for each class, the vectors of other classes linked with it."""
    half = math.cos(math.acos(min(1.0, params.cosine)) / 2) + 1e-9
    centre = members.where("v = component").select("component", F.col("e").alias("c"))

    def apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cos = np.concatenate(
                [np.zeros(0)]
                + [
                    (_unit(b["e"].iloc[a : a + 4096]) * _unit(b["c"].iloc[a : a + 4096])).sum(axis=1)
                    for a in range(0, len(b), 4096)
                ]
            )
            yield pd.DataFrame(
                {"component": b["component"], "v": b["v"], "copies": b["copies"], "e": b["e"], "core": cos >= half}
            )

    parted = stage(
        members.join(centre, "component").mapInPandas(
            apart, "component bigint, v bigint, copies bigint, e array<float>, core boolean"
        ),
        "parted",
    )
    cores = parted.where("core").groupBy("component").agg(F.sum("copies").alias("all"))
    inside = (
        parted.where("core")
        .join(cores, "component")
        .select(F.col("v").alias("x"), (F.col("all") - F.col("copies")).alias("links"))
    )
    outside = stage(parted.where("NOT core"), "outside")
    sizes = parted.groupBy("component").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("core"), 1)).alias("n_out")
    )
    sizes = stage(sizes.where("n_out > 0"), "sizes")
    blocks = lambda rows, n: rows.join(sizes, "component").withColumn(
        "block", F.pmod(F.xxhash64("v"), F.ceil(F.col(n) / params.block))
    )

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        x = _unit(rows["e"])
        return pd.DataFrame(
            {
                "component": rows["component"].iloc[:1],
                "v": [rows["v"].to_numpy(np.int64).tobytes()],
                "copies": [rows["copies"].to_numpy(np.int64).tobytes()],
                "core": [rows["core"].to_numpy(bool).tobytes()],
                "x": [x.tobytes()],
            }
        )

    kind = "component bigint, v binary, copies binary, core binary, x binary"
    whole = blocks(parted, "n").groupBy("component", "block").applyInPandas(gather, kind)
    out = blocks(outside, "n_out").groupBy("component", "block").applyInPandas(gather, kind)
    left = out.select("component", *(F.col(c).alias(f"o_{c}") for c in ("v", "copies", "x")))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                v, copies = np.frombuffer(r.v, np.int64), np.frombuffer(r.copies, np.int64)
                o, o_copies = np.frombuffer(r.o_v, np.int64), np.frombuffer(r.o_copies, np.int64)
                core = np.frombuffer(r.core, bool)
                x = np.frombuffer(r.x).reshape(len(v), -1)
                y = np.frombuffer(r.o_x).reshape(len(o), -1)
                near = (y @ x.T >= params.cosine) & (o[:, None] != v[None, :])
                yield pd.DataFrame({"x": o, "links": near @ copies})
                yield pd.DataFrame({"x": v[core], "links": o_copies @ near[:, core]})

    met = left.join(whole, "component").mapInPandas(count, "x bigint, links bigint")
    return inside.unionByName(met).groupBy("x").agg(F.sum("links").alias("links"))
