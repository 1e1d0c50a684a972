"""Merkle manifest of a dataset: superblocks of a tree reduced, proved and folded by cogroups."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import partitions, ship, stage

#: Fixed value of the manifest: nodes that become one.
ARITY = 3
#: Levels of a superblock, which has ARITY ** LEVELS nodes at most.
LEVELS = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NODES = "g string, pos bigint, node binary"
_PATHS = "g string, pos bigint, name string, node binary, lefts array<string>, rights array<string>, subroot string, root string"


def row_digest(*values: Column) -> Column:
    """SHA-256 of the values' forms: `-` if null, else UTF-8 byte count, a colon, the value."""
    forms = []
    for value in values:
        text = value.cast("string")
        form = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
        forms.append(F.coalesce(form, F.lit("-")))
    return F.unhex(F.sha2(F.concat(*forms), 256))


def _digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


# --- places of rows in their group ------------------------------------------------------


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """`rows` with `pos`, each row's place among those of its `g`, written out.

    Rows are dealt by range of (g, order), so a group of any size is spread. A task numbers
    its runs of a group; what earlier tasks hold of a task's first group is added from one
    row a task.
    """
    by = ("g", *order)

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not len(b):
                continue
            g = b["g"].to_numpy()
            starts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            run = np.searchsorted(starts, np.arange(len(b)), "right") - 1
            nth = np.arange(len(b)) - starts[run]
            if g[0] == last:
                nth[run == 0] += seen
            last, seen = g[-1], int(nth[-1]) + 1
            yield b.assign(part=part, nth=nth)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    numbered = stage(
        ship(rows)
        .repartitionByRange(partitions(rows.sparkSession), *by)
        .sortWithinPartitions(*by)
        .mapInPandas(number, f"{schema}, part int, nth bigint"),
        "numbered",
    )
    spans = numbered.groupBy("part").agg(
        F.min("g").alias("first"), F.max(F.struct("g", "nth")).alias("last")
    )
    bases, held, before = [], None, 0
    for r in sorted(spans.collect(), key=lambda r: r["part"]):  # one row a task
        base = before if r["first"] == held else 0
        bases.append((r["part"], r["first"], base))
        held = r["last"]["g"]
        before = r["last"]["nth"] + 1 + (base if held == r["first"] else 0)
    base = rows.sparkSession.createDataFrame(bases, "part int, first string, base bigint")
    at = F.col("nth") + F.when(F.col("g") == F.col("first"), F.col("base")).otherwise(0)
    return numbered.join(F.broadcast(base), "part").select(*rows.columns, at.alias("pos"))


# --- the tree ---------------------------------------------------------------------------


def _levels(nodes: list[str], first: bool, levels: int) -> list[list[str]]:
    """A superblock's nodes level by level, up to the one that stands for it.

    The group's first superblock ends with one node as soon as it can if it is not full,
    for then it is the whole group; any other goes through all levels.
    """
    out = [nodes]
    alone = first and len(nodes) < ARITY**levels
    while len(out) <= levels and not (alone and len(out[-1]) == 1):
        below = out[-1]
        out.append([_digest("".join(below[i : i + ARITY])) for i in range(0, len(below), ARITY)])
    return out


def _reduced(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """(g, pos, node) of superblocks, of superblocks of these and so on, to one node a group."""

    def reduce(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = [x.hex() for x in rows.sort_values("pos")["node"]]
        (top,) = _levels(own, key[1] == 0, levels)[-1]
        return pd.DataFrame({"g": [key[0]], "pos": [key[1]], "node": [bytes.fromhex(top)]})

    out = [nodes]
    while True:
        blocks = ship(out[-1]).select("g", "pos", "node", _block(levels).alias("block"))
        out.append(stage(blocks.groupBy("g", "block").applyInPandas(reduce, _NODES), "superblocks"))
        if not out[-1].agg(F.max("pos")).first()[0]:
            return out


def _block(levels: int) -> Column:
    return F.expr(f"pos div {ARITY**levels}L")


def _siblings(tree: list[list[str]], i: int) -> tuple[list[str], list[str]]:
    """What stands left and right of node `i` in its run, on each level of a superblock."""
    lefts, rights = [], []
    for level in tree[:-1]:
        run = i - i % ARITY
        lefts.append("".join(level[run:i]))
        rights.append("".join(level[i + 1 : run + ARITY]))
        i //= ARITY
    return lefts, rights


def _paths(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """The nodes with the way from each to the root, given the ways of their superblocks."""

    def join(key: tuple, rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        tree = _levels([x.hex() for x in rows["node"]], key[1] == 0, levels)
        (up,) = outer.to_dict("records")
        ways = [_siblings(tree, i) for i in range(len(rows))]
        return pd.DataFrame(
            {
                "g": rows["g"],
                "pos": rows["pos"],
                "name": rows["name"],
                "node": rows["node"],
                "lefts": [[*lefts, *up["lefts"]] for lefts, _ in ways],
                "rights": [[*rights, *up["rights"]] for _, rights in ways],
                "subroot": up["subroot"],
                "root": up["root"],
            }
        )

    return (
        ship(nodes)
        .withColumn("block", _block(levels))
        .groupBy("g", "block")
        .cogroup(above.groupBy("g", "pos"))
        .applyInPandas(join, _PATHS)
    )


def _down(tree: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """From the ways of a tree's top nodes to those of the superblocks of its lowest nodes."""
    for nodes in tree[-2:0:-1]:
        above = stage(_paths(nodes.withColumn("name", F.lit(None).cast("string")), above, levels), "paths")
    return above


def manifest(docs: DataFrame, changed: DataFrame | None = None, levels: int = LEVELS) -> DataFrame:
    """Hash rows to leaves, sources to subroots, all to a root; prove and check every row.

    Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. `changed` is
    `docs` with an extra column `_leaf`, the digest of the row as it is found later
    (by default as it is): from it and the row's siblings `folded_root` is folded, and
    `verified` says whether that is the root. Digests are lowercase hex text.

    Rows of a source stand by doc_id, nulls first, rows of one id by leaf; a null source
    comes first. An empty table gives no rows. Columns beside FIELDS are not read. No task
    meets more than one superblock of ARITY ** levels nodes, however large a source is.
    """
    leaf = row_digest(*(F.col(c) for c in FIELDS))
    source = F.col("source").cast("string")
    rows = (docs if changed is None else changed).select(
        # a null source sorts before all others
        F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("g"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        leaf.alias("node"),
        (leaf if changed is None else F.col("_leaf")).alias("found"),
    )
    leaves = placed(stage(rows, "leaves"), "doc_id", "node", "found")
    sources = _reduced(leaves, levels)
    # the subroots are the nodes of one more tree
    subroots = placed(
        sources[-1].select(F.lit("").alias("g"), F.col("g").alias("name"), "node"), "name"
    )
    top = _reduced(subroots, levels)
    root = top[-1].first()
    nothing = F.array().cast("array<string>")
    above = top[-1].select(
        "g", "pos", F.lit(None).cast("string").alias("name"), "node", nothing.alias("lefts"),
        nothing.alias("rights"), F.lit("").alias("subroot"),
        F.lit(root["node"].hex() if root else None).alias("root"),
    )
    above = _paths(subroots, _down(top, above, levels), levels).select(
        F.col("name").alias("g"), F.lit(0).cast("bigint").alias("pos"), "name", "node", "lefts", "rights",
        F.lower(F.hex("node")).alias("subroot"), "root",
    )
    above = _down(sources, stage(above, "paths"), levels)

    def fold(key: tuple, rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        own = [x.hex() for x in rows["node"]]
        tree = _levels(own, key[1] == 0, levels)
        (up,) = outer.to_dict("records")
        beyond = "".join(map("".join, zip(up["lefts"], up["rights"])))
        ends: dict[str, str] = {}  # a superblock's node, folded to the root
        proofs, folded = [], []
        for i, found in enumerate(rows["found"]):
            lefts, rights = _siblings(tree, i)
            proofs.append(_digest("".join(map("".join, zip(lefts, rights))) + beyond))
            at = _folded(found.hex(), lefts, rights)
            if at not in ends:
                ends[at] = _folded(at, up["lefts"], up["rights"])
            folded.append(ends[at])
        return pd.DataFrame(
            {
                "doc_id": rows["doc_id"].astype("Int64"),
                "leaf": own,
                "subroot": up["subroot"],
                "root": up["root"],
                "proof_sha256": proofs,
                "folded_root": folded,
                "verified": [x == up["root"] for x in folded],
            }
        )

    return (
        ship(leaves)
        .withColumn("block", _block(levels))
        .groupBy("g", "block")
        .cogroup(above.groupBy("g", "pos"))
        .applyInPandas(
            fold,
            "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, "
            "folded_root string, verified boolean",
        )
    )


def _folded(at: str, lefts: list[str], rights: list[str]) -> str:
    for left, right in zip(lefts, rights):
        at = _digest(left + at + right)
    return at
