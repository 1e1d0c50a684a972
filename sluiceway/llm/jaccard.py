"""N-gram Jaccard join by a token-group matrix.

1. Shingles that lie in one document only can link nothing. They are found by an exchange
   of hashes, and with them all documents that hold too few shared shingles to be linked.
2. The rest is partitioned into groups of similar documents: documents that agree in
   a smallest hash meet a leader, and join it where they are verified to be linked.
3. The matrix holds every group's union of prefix tokens, the rarest tokens of each set.
   Groups that meet there, and aren't connected yet and share enough tokens are candidates;
   a query document's overlap with the group's union bounds its overlap with any member, and
   only groups that pass are opened, and members that pass the same bound verified.
4. Tokens of very many groups are kept out of the matrix. A set has one in its prefix only if
   nearly four fifths of it are such tokens; sets that share one are compared block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .common import apart, components, discard, pack_docs, partitions, read_classes, shared_keys, ship, stage, unpack_docs


@dataclass(frozen=True)
class JaccardParams:
    words: int = 5
    #: Linked if 100 * intersection >= percent * union.
    percent: int = 80
    #: Rounds in which documents look for a leader, each by another smallest hash.
    rounds: int = 2
    #: Prefix tokens beyond the first that linked sets must share.
    more: int = 12
    #: Leaders kept at once for documents of one smallest hash; others go on to the next step.
    leaders: int = 8
    #: Documents of one smallest hash that meet in one task; more are salted.
    meet: int = 512
    #: Groups of a token of the matrix; sets that share a token of more are compared in blocks.
    hot: int = 64
    #: Sets of such a block, and tokens of them all together.
    block: int = 512
    block_tokens: int = 1 << 18


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PLACES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


def shingles(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(owners, hashes): every shingle of each text, one text after the other.

    Words are what stands between ASCII white space, A-Z lowered. A text of fewer than k
    words has its whole sequence as its one shingle, a text without words none.
    """
    words = [t.lower().split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    every = list(chain.from_iterable(words))
    known = {w: xxhash.xxh3_64_intdigest(w) for w in set(every)}
    codes = np.fromiter(map(known.__getitem__, every), np.uint64, len(every))
    factors = [np.uint64(_PLACES[j % 5] + 2 * (j // 5)) for j in range(k)]
    h = codes * factors[0]
    for j in range(1, min(k, len(codes))):
        h[:-j] += codes[j:] * factors[j]
    ends = np.cumsum(counts)
    left = np.repeat(ends, counts) - np.arange(len(every))  # words from here to the text's end
    at = np.flatnonzero(left >= k)
    owner = np.repeat(np.arange(len(texts)), counts)[at]
    h = h[at]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        own = [
            (codes[ends[d] - counts[d] : ends[d]] * np.array(factors[: counts[d]])).sum(dtype=np.uint64)
            + np.uint64(counts[d])
            for d in short
        ]
        owner, h = np.concatenate((owner, short)), np.concatenate((h, np.array(own, np.uint64)))
    return owner, _mix(h, 1)


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, sizes, places): the distinct hashes in order; each text's distinct ones as places there."""
    owner, h = shingles(texts, k)
    keys, where = np.unique(h, return_inverse=True)
    pairs = np.unique(owner * max(1, len(keys)) + where)
    owner, where = np.divmod(pairs, max(1, len(keys)))
    return keys, np.bincount(owner, minlength=len(texts)), where


def _distinct_sets(sizes: np.ndarray, where: np.ndarray) -> np.ndarray:
    """For each set the place of the first equal set."""
    ends = np.cumsum(sizes)
    first: dict[bytes, int] = {}
    raw = where.astype(np.int64).tobytes()
    return np.array(
        [
            first.setdefault(xxhash.xxh3_128_digest(raw[8 * (e - n) : 8 * e]) if n else b"", i)
            for i, (n, e) in enumerate(zip(sizes.tolist(), ends.tolist()))
        ],
        np.int64,
    )


def linked(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int, percent: int) -> bool:
    """Whether two sets are linked, by their sorted shared tokens and whole sizes."""
    small, large = (n_a, n_b) if n_a < n_b else (n_b, n_a)
    if 100 * small < percent * large:
        return False
    x, y = (a, b) if len(a) < len(b) else (b, a)
    if not len(y):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = len(y) - 1
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (n_a + n_b - both)


def _needed(n: int, percent: int) -> int:
    return -(-percent * n // 100)


_ROW = "v bigint, n bigint, tokens binary"


def press_tokens(tokens: np.ndarray) -> bytes:
    """Sorted tokens of 56 bits as differences, byte plane by byte plane."""
    gaps = np.diff(tokens, prepend=np.uint64(0)).astype("<u8")
    return zstandard.compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T[:7]).tobytes(), 1)


def open_tokens(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(7, -1)
    gaps = np.zeros((planes.shape[1], 8), np.uint8)
    gaps[:, :7] = planes.T
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64)


def _candidates(docs: DataFrame, params: JaccardParams, id_col: str, text_col: str) -> DataFrame:
    """(v, n, alike, tokens): every row with an id, its set's size, an equal document of its chunk.

    `tokens` are the shared shingles of a set that may link, else null: 48 bits of the hash
    behind 8 that tell in how many chunks it lies, so that the rarest are the first.
    """
    buckets = partitions(docs.sparkSession)
    k, percent = params.words, params.percent
    chunks = pack_docs(ship(docs), id_col, text_col)

    def keys_of(blob: bytes) -> np.ndarray:
        return np.unique(shingles(unpack_docs(blob)[1], k)[1])

    flags = shared_keys(chunks, keys_of, buckets, counted=True)

    def choose(key, mine: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        out = []
        for blob in mine["blob"]:
            ids, texts = unpack_docs(blob)
            keys, sizes, where = shingle_sets(texts, k)
            first = _distinct_sets(sizes, where)
            leads = np.repeat(first == np.arange(len(ids)), sizes)
            classes = read_classes(keys, buckets, replies)
            shared = (classes > 0) | (np.bincount(where[leads], minlength=len(keys)) > 1)
            named = classes.astype(np.uint64) << np.uint64(48) | keys >> np.uint64(16)
            ends = np.cumsum(sizes)
            for i, (v, n, f, e) in enumerate(zip(ids.tolist(), sizes.tolist(), first.tolist(), ends.tolist())):
                own = None
                if n and f == i:
                    mark = shared[where[e - n : e]]
                    if int(mark.sum()) >= _needed(n, percent):
                        own = press_tokens(np.sort(named[where[e - n : e][mark]]))
                out.append((v, n, int(ids[f]) if n else v, own))
        return pd.DataFrame(out, columns=["v", "n", "alike", "tokens"])

    sets = stage(
        chunks.groupBy("chunk")
        .cogroup(flags.groupBy("chunk"))
        .applyInPandas(choose, "v bigint, n bigint, alike bigint, tokens binary"),
        "sets",
    )
    discard(chunks)
    return sets


def _join_leaders(rows: DataFrame, nth: int, params: JaccardParams, last: bool) -> DataFrame:
    """(v, n, tokens, leader): the leader each row was verified to be linked to, else its tokens.

    After the `last` round tokens are not needed.
    """
    percent = params.percent

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            low = [
                _mix(open_tokens(t), 101 + nth).min().astype(np.int64)
                for t in b["tokens"]
            ]
            yield pd.DataFrame({"key": np.array(low, np.int64), "v": b["v"], "n": b["n"], "tokens": b["tokens"]})

    keys = rows.mapInPandas(keyed, "key bigint, " + _ROW)
    many = stage(
        keys.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > params.meet), "many"
    )
    salt = F.pmod(F.xxhash64("v"), F.ceil(F.coalesce("rows", F.lit(1)) / params.meet))

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, leaders = None, []
        for b in batches:
            found = []
            for key, salt_, v, n, t in zip(b["key"], b["salt"], b["v"], b["n"], b["tokens"]):
                if at != (key, salt_):
                    at, leaders = (key, salt_), []
                own = open_tokens(t)
                leader = next((w for w, m, x in leaders if linked(own, x, n, m, percent)), None)
                if leader is None and len(leaders) < params.leaders:
                    leaders.append((v, n, own))
                found.append(leader)
            yield pd.DataFrame(
                {
                    "v": b["v"],
                    "n": b["n"],
                    "tokens": [t if w is None and not last else None for t, w in zip(b["tokens"], found)],
                    "leader": pd.array(found, dtype="Int64"),
                }
            )

    return stage(
        keys.join(many, "key", "left")
        .select("key", salt.alias("salt"), "v", "n", "tokens")
        .repartition(partitions(rows.sparkSession), "key", "salt")
        .sortWithinPartitions("key", "salt", "v")
        .mapInPandas(follow, _ROW + ", leader bigint"),
        "led",
    )


def _prefixes(rows: DataFrame, params: JaccardParams) -> DataFrame:
    """(token, v, n): of each set the first tokens, of which a linked set shares `more` + 1.

    The order is the same for all sets: tokens of one document first, which need not be
    named, then those of fewer chunks, then by hash. Two sets with at least m tokens in common share min(k, m) of the
    first size - m + k of each.
    """

    def prefix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a in range(0, len(b), 512):
                part = b.iloc[a : a + 512]
                tokens, sizes = [np.zeros(0, np.uint64)], []
                for n, t in zip(part["n"], part["tokens"]):
                    own = open_tokens(t)
                    own = own[: len(own) - _needed(n, params.percent) + 1 + params.more]
                    tokens.append(own)
                    sizes.append(len(own))
                yield pd.DataFrame(
                    {
                        "token": np.concatenate(tokens).view(np.int64),
                        **{c: np.repeat(part[c].to_numpy(), sizes) for c in ("v", "n")},
                    }
                )

    return rows.select("v", "n", "tokens").mapInPandas(prefix, "token bigint, v bigint, n bigint")


def _open_groups(sets: DataFrame, groups: DataFrame, params: JaccardParams) -> DataFrame:
    """(a, b): verified links between documents of different groups; `groups` has (v, n, g)."""
    percent = params.percent
    # a token of one document only meets nothing; most are, and go before they are grouped
    prefixes = _prefixes(sets, params)
    twice = stage(
        prefixes.groupBy("token")
        .agg(F.min("v").alias("a"), F.max("v").alias("z"))
        .where("a <> z")
        .select("token"),
        "twice",
    )
    prefixes = stage(
        prefixes.join(twice, "token", "left_semi").join(groups, ["v", "n"]).select("token", "v", "n", "g").distinct(),
        "prefixes",
    )
    matrix = stage(
        prefixes.groupBy("token", "g").agg(F.min("n").alias("low"), F.max("n").alias("high")), "matrix"
    )
    # two sets that share enough prefix tokens share a hot one, or all they share is in the matrix
    hot = stage(matrix.groupBy("token").agg(F.count(F.lit(1)).alias("groups")).where(F.col("groups") > params.hot).select("token"), "hot")
    crowded = _crowded(prefixes.join(hot, "token", "left_semi"), sets, params)
    prefixes, matrix = (x.join(hot, "token", "left_anti") for x in (prefixes, matrix))

    def enough(shared: str, size: Column) -> Column:
        """Whether so many shared prefix tokens let a set of this size be linked."""
        return F.col(shared) >= F.least(F.lit(params.more + 1), F.ceil(size * percent / 100))

    def alike(m: str, n: str) -> Column:
        return (F.col(m) * percent <= F.col(n) * 100) & (F.col(n) * percent <= F.col(m) * 100)

    x, y = matrix.alias("x"), matrix.alias("y")
    near = lambda p, q: F.col(f"{p}.low") * percent <= F.col(f"{q}.high") * 100
    met = stage(
        x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.g") < F.col("y.g")) & near("x", "y") & near("y", "x"))
        .groupBy(F.col("x.g").alias("p"), F.col("y.g").alias("q"))
        .agg(F.count(F.lit(1)).alias("shared"), F.min(F.greatest("x.low", "y.low")).alias("least"))
        .where(enough("shared", F.col("least")))
        .select("p", "q"),
        "met",
    )
    # groups whose first documents are linked need no question
    firsts = stage(_verified(met.select(F.col("p").alias("a"), F.col("q").alias("b")), sets, params), "firsts")
    met = _apart(met, firsts, "p", "q")
    sizes = groups.groupBy("g").agg(F.count(F.lit(1)).alias("rows"))
    # the smaller group asks, the larger is opened
    p, q = sizes.alias("s"), sizes.alias("t")
    asks = (
        met.join(p, F.col("p") == F.col("s.g"))
        .join(q, F.col("q") == F.col("t.g"))
        .select(
            F.when(F.col("s.rows") <= F.col("t.rows"), F.col("p")).otherwise(F.col("q")).alias("g"),
            F.when(F.col("s.rows") <= F.col("t.rows"), F.col("q")).otherwise(F.col("p")).alias("group"),
        )
    )
    asking = stage(prefixes.join(asks, "g").select("token", "v", "n", "group"), "asking")
    unions = matrix.withColumnRenamed("g", "group")
    passed = (
        asking.join(unions, ["token", "group"])
        .where(F.col("n") * percent <= F.col("high") * 100)
        .groupBy("v", "n", "group")
        .agg(F.count(F.lit(1)).alias("shared"))
        .where(enough("shared", F.col("n")))
        .select("v", "n", "group")
    )
    passed = stage(passed, "passed")
    # most are linked to the group's first document, and need not open it
    led = stage(
        _verified(passed.select(F.col("v").alias("a"), F.col("group").alias("b")), sets, params), "joined"
    )
    # nor do those that others connect meanwhile
    own = passed.join(groups.select("v", "g").distinct(), "v")
    inside = own.select(F.col("v").alias("a"), F.col("g").alias("b"))
    passed = _apart(passed, firsts.unionByName(led).unionByName(inside), "v", "group")
    # the members of an opened group
    left = asking.join(passed, ["v", "n", "group"]).select("token", F.col("v").alias("a"), F.col("n").alias("n_a"), "group")
    right = prefixes.select("token", F.col("v").alias("b"), F.col("n").alias("n_b"), F.col("g").alias("group"))
    pairs = stage(
        left.join(right, ["token", "group"])
        .where(alike("n_a", "n_b"))
        .groupBy("a", "n_a", "b", "n_b")
        .agg(F.count(F.lit(1)).alias("shared"))
        .where(enough("shared", F.greatest("n_a", "n_b")))
        .select("a", "b"),
        "pairs",
    )
    return _verified(pairs, sets, params).unionByName(led).unionByName(firsts).unionByName(crowded)


def _crowded(shared: DataFrame, sets: DataFrame, params: JaccardParams) -> DataFrame:
    """(a, b): links between sets of different groups that share a hot token, as forests.

    `shared` has (token, v, n, g) of the hot tokens. Sets are one crowd if hot tokens
    connect them; each is in one crowd only, whose blocks are all compared. A block pair
    counts its shared tokens by a product of matrices, and emits no more than a forest.
    """
    percent = params.percent
    first = shared.groupBy("token").agg(F.min("v").alias("least"))
    crowds = components(shared.join(first, "token").select("v", "least").distinct())
    members = stage(
        shared.select("v", "n", "g")
        .distinct()
        .join(crowds, F.col("v") == F.col("node"))
        .join(sets.select("v", "n", "tokens"), ["v", "n"])
        # equal sets ask once
        .groupBy("component", "g", "n", "tokens")
        .agg(F.min("v").alias("v")),
        "crowded",
    )

    def sized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"component": b["component"], "m": [len(open_tokens(t)) for t in b["tokens"]]})

    sizes = (
        members.select("component", "tokens")
        .mapInPandas(sized, "component bigint, m bigint")
        .groupBy("component")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("m").alias("m"))
        .select(
            "component",
            F.ceil(F.greatest(F.col("rows") / params.block, F.col("m") / params.block_tokens)).alias("blocks"),
        )
    )

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        own = [open_tokens(t) for t in rows["tokens"]]
        packed = zstandard.compress(np.concatenate(own).astype("<u8").tobytes(), 1)
        whole = {c: [rows[c].to_numpy(np.int64).tobytes()] for c in ("v", "n", "g")}
        m = np.fromiter(map(len, own), np.int64, len(own)).tobytes()
        return pd.DataFrame({"component": rows["component"].iloc[:1], "block": rows["block"].iloc[:1], **whole, "m": m, "tokens": packed})

    kind = "component bigint, block bigint, v binary, n binary, g binary, m binary, tokens binary"
    blocks = stage(
        members.join(sizes, "component")
        .withColumn("block", F.pmod(F.xxhash64("v", "g"), F.col("blocks")))
        # else the join's partitions, one for each crowd, would do
        .repartition(partitions(shared.sparkSession), "component", "block")
        .groupBy("component", "block")
        .applyInPandas(gather, kind),
        "blocks",
    )
    ids = blocks.select("component", "block")
    pairs = ids.alias("x").join(ids.alias("y"), (F.col("x.component") == F.col("y.component")) & (F.col("x.block") <= F.col("y.block")))
    pairs = pairs.select(F.col("x.component").alias("component"), F.col("x.block").alias("block"), F.col("y.block").alias("other"))
    theirs = blocks.select("component", F.col("block").alias("other"), *(F.col(c).alias(f"o_{c}") for c in ("v", "n", "g", "m", "tokens")))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                v, n, g, m, w, k, h, o = (np.frombuffer(x, np.int64) for x in (r.v, r.n, r.g, r.m, r.o_v, r.o_n, r.o_g, r.o_m))
                x, y = (np.frombuffer(zstandard.decompress(t), "<u8") for t in (r.tokens, r.o_tokens))
                both = _overlaps(x, m, y, o)
                near = (100 * both >= percent * (n[:, None] + k[None, :] - both)) & (g[:, None] != h[None, :])
                i, j = np.nonzero(near)
                # one link for each two groups
                _, one = np.unique(np.stack([g[i], h[j]], 1), axis=0, return_index=True)
                yield pd.DataFrame({"a": v[i[one]], "b": w[j[one]]})

    return stage(
        pairs.join(blocks, ["component", "block"])
        .join(theirs, ["component", "other"])
        .mapInPandas(compare, "a bigint, b bigint"),
        "crowd",
    )


def _overlaps(x: np.ndarray, m: np.ndarray, y: np.ndarray, o: np.ndarray, columns: int = 8192) -> np.ndarray:
    """How many tokens each set of one block shares with each of the other; `m`, `o` are the sets' sizes."""
    names = np.intersect1d(x, y)
    sides = []
    for tokens, sizes in ((x, m), (y, o)):
        at = np.minimum(np.searchsorted(names, tokens), max(0, len(names) - 1))
        there = names[at] == tokens if len(names) else np.zeros(len(tokens), bool)
        place, owner = at[there], np.repeat(np.arange(len(sizes)), sizes)[there]
        order = np.argsort(place, kind="stable")
        sides.append((place[order], owner[order], len(sizes)))
    both = np.zeros((len(m), len(o)), np.float32)
    for a in range(0, len(names), columns):
        parts = []
        for place, owner, rows in sides:
            lo, hi = np.searchsorted(place, (a, a + columns))
            part = np.zeros((rows, min(columns, len(names) - a)), np.float32)
            part[owner[lo:hi], place[lo:hi] - a] = 1
            parts.append(part)
        both += parts[0] @ parts[1].T
    return both.astype(np.int64)


def _apart(pairs: DataFrame, links: DataFrame, a: str, b: str) -> DataFrame:
    """The pairs that the links do not connect."""
    found = components(links)
    ends = found.select(F.col("node").alias(a), F.col("component").alias("__a"))
    starts = found.select(F.col("node").alias(b), F.col("component").alias("__b"))
    joined = pairs.join(ends, a, "left").join(starts, b, "left")
    same = F.coalesce(F.col("__a"), F.col(a)) == F.coalesce(F.col("__b"), F.col(b))
    return stage(joined.where(~same).select(*pairs.columns), "apart")


def _verified(pairs: DataFrame, sets: DataFrame, params: JaccardParams) -> DataFrame:
    """Those of the pairs (a, b) whose sets are linked."""
    percent = params.percent
    one = sets.select(F.col("v").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a"))
    two = sets.select(F.col("v").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [
                linked(open_tokens(s), open_tokens(t), m, n, percent)
                for s, t, m, n in zip(b["t_a"], b["t_b"], b["n_a"], b["n_b"])
            ]
            yield b.loc[ok, ["a", "b"]]

    return pairs.join(one, "a").join(two, "b").mapInPandas(verify, "a bigint, b bigint")


def jaccard_groups(
    docs: DataFrame,
    params: JaccardParams = JaccardParams(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row with an id.

    Documents without a word (null and empty texts) have no shingles and are linked with
    nothing. Rows that repeat an id are judged each by itself and share a component; rows
    without an id are left out. Every link is found, whatever the size of a group.
    """
    sets = _candidates(docs, params, id_col, text_col)
    rows = sets.where("tokens IS NOT NULL").select("v", "n", "tokens")
    everyone, left = rows, None
    led_to = []
    for nth in range(params.rounds):
        led = _join_leaders(rows, nth, params, last=nth == params.rounds - 1)
        found = led.where("leader IS NOT NULL").select(F.col("v").alias("a"), F.col("leader").alias("b"))
        led_to.append(stage(found, "links"))
        if left is not None:
            discard(left)
        left, rows = led, led.where("leader IS NULL").select("v", "n", "tokens")
    links = reduce(DataFrame.unionByName, led_to)
    groups = components(links)
    grouped = stage(
        everyone.select("v", "n")
        .join(groups, everyone["v"] == groups["node"], "left")
        .select("v", "n", F.coalesce("component", "v").alias("g")),
        "grouped",
    )
    more = stage(_open_groups(everyone, grouped, params), "more")
    alike = sets.where("v <> alike").select(F.col("v").alias("a"), F.col("alike").alias("b"))
    groups = components(links.unionByName(more).unionByName(alike))
    return sets.join(groups, sets["v"] == groups["node"], "left").select(
        F.col("v").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "v").alias("component_id"),
    )


def one_of_each(
    docs: DataFrame,
    params: JaccardParams = JaccardParams(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of `docs`, with all their columns, whose id is the smallest of its component.

    Rows without an id stay; rows that repeat the smallest id all stay. Columns may have
    any names.
    """
    gone = f"{apart(docs)}drop"
    drop = (
        jaccard_groups(docs, params, id_col, text_col)
        .where("doc_id <> component_id")
        .select(F.col("doc_id").alias(gone))
        .distinct()
    )
    return docs.join(drop, docs[id_col].cast("bigint") == F.col(gone), "left_anti")
