"""A hash-tree manifest of captured pages: one root for a run, and for every page the proof that it is under that root.

Pages are appended in order to aligned blocks. A task appends one block: a subtree that is still open carries a partial
witness, and each sibling that completes later extends it. Roots of blocks are appended in the same way in the next
round, so no task holds more than a block, however many pages a side has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlens.llm.shared import keep

ARITY = 3
LEVELS = 6
SNAPSHOT_FIELDS = ("path", "side", "requestedUrl", "finalUrl", "status", "title", "contentHash")
_WITNESS = T.ArrayType(T.StructType([T.StructField("left", T.BinaryType()), T.StructField("right", T.BinaryType())]))
_WITNESS_ARROW = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))


def page_leaf(*values: Column | str) -> Column:
    """SHA-256 (lowercase hex) of values: `-` for a null, else the UTF-8 byte count, a colon and the value as text."""
    parts = []
    for value in values:
        text = (F.col(value) if isinstance(value, str) else value).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _hex(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def proof_digest(witness: Column | str) -> Column:
    """SHA-256 of all siblings of a witness as hex text, from the leaf's level to the root's, left to right."""
    siblings = F.transform(witness, lambda level: _hex(F.concat(level["left"], level["right"])))
    return F.sha2(F.array_join(siblings, ""), 256)


def fold_root(witness: Column | str, leaf: Column) -> Column:
    """The root that a leaf and a witness lead to; it equals the manifest's root only for the leaf that was sealed."""
    return F.aggregate(witness, leaf, lambda below, level: F.sha2(F.concat(_hex(level["left"]), below, _hex(level["right"])), 256))


class OpenTree:
    """Appends digests in order; at each level at most ARITY - 1 complete subtrees are open."""

    def __init__(self) -> None:
        self.digest: list[bytes] = []
        self.left: list[bytes] = []
        self.right: list[bytes] = []
        self.parent: list[int] = []
        self.open: list[list[int]] = []
        self.made: list[int] = []

    def append(self, digest: bytes, level: int = 0) -> None:
        """Add a complete subtree, which extends the partial witnesses of the open ones before it."""
        if level == len(self.open):
            self.open.append([])
            self.made.append(0)
        run, node = self.open[level], len(self.digest)
        self.digest.append(digest)
        self.left.append(b"".join([self.digest[older] for older in run]))
        self.right.append(b"")
        self.parent.append(-1)
        for older in run:
            self.right[older] += digest
        run.append(node)
        self.made[level] += 1
        if len(run) == ARITY:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        above = len(self.digest)
        self.append(hashlib.sha256(b"".join([self.digest[n].hex().encode() for n in run])).digest(), level + 1)
        for node in run:
            self.parent[node] = above

    def close(self, levels: int | None) -> bytes:
        """Complete what is open and return the root: `levels` above the leaves, or with None the lowest that is alone."""
        level = 0
        while level < levels if levels is not None else self.made[level] > 1:
            if self.open[level]:
                self._complete(level)
            level += 1
        return self.digest[-1]

    def witness(self, node: int) -> list[int]:
        """The nodes whose siblings prove `node`, itself first; the root is not among them."""
        found = []
        while self.parent[node] >= 0:
            found.append(node)
            node = self.parent[node]
        return found


def _grow(levels: int, names: Sequence[str]):
    def grow(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        block = block.take(pa.array(np.argsort(block.column("seat").to_numpy(), kind="stable")))
        tree, leaves = OpenTree(), []
        for digest in block.column("node").to_pylist():
            leaves.append(len(tree.digest))
            tree.append(digest)
        top = tree.close(None if block.column("whole")[0].as_py() else levels)
        chains = [tree.witness(leaf) for leaf in leaves]
        nodes = [node for chain in chains for node in chain]
        sides = pa.StructArray.from_arrays([pa.array([tree.left[n] for n in nodes], pa.binary()), pa.array([tree.right[n] for n in nodes], pa.binary())], ["left", "right"])
        ends = np.cumsum([0] + [len(chain) for chain in chains]).astype(np.int32)
        witness = pa.ListArray.from_arrays(pa.array(ends), sides).cast(_WITNESS_ARROW)
        return pa.table([block.column(n) for n in names] + [witness, pa.array([top] * block.num_rows, pa.binary())], names=[*names, "witness", "top"])

    return grow


def _numbered(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add `place`, from 0 in each `tree` by `order`, and `total`, the rows of the tree.

    Rows are sorted by range over all trees, so that one big tree spreads over many tasks; only one count per tree and
    task is summed up across a tree.
    """
    placed = keep(nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("row", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("row", 33))
    counts = placed.groupBy("tree", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    across = Window.partitionBy("tree").orderBy("part")
    before = F.coalesce(F.sum("n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("tree", "part", "first", before.alias("before"), F.sum("n").over(Window.partitionBy("tree")).alias("total"))
    return placed.join(counts, ["tree", "part"]).withColumn("place", F.col("row") - F.col("first") + F.col("before")).drop("row", "part", "first", "before")


def _climb(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Append the nodes of all trees, then the roots of their blocks, until each tree has one; one stored table a round.

    `nodes` holds `tree, place, total, node` and may hold more, which is kept. Each round adds `block`, `seat`, the
    `witness` inside the block, and the block's root `top`.
    """
    width, rounds = ARITY**levels, []
    while True:
        seated = nodes.withColumns(
            {"block": F.floor(F.col("place") / width).cast("long"), "seat": (F.col("place") % width).cast("int"), "whole": F.col("total") <= width}
        )
        fields = [*seated.schema.fields, T.StructField("witness", _WITNESS), T.StructField("top", T.BinaryType())]
        grown = keep(seated.groupBy("tree", "block").applyInArrow(_grow(levels, seated.columns), T.StructType(fields)))
        rounds.append(grown)
        if grown.filter(~F.col("whole")).isEmpty():
            return rounds
        tops = grown.filter("seat = 0").select("tree", F.col("block").alias("place"), F.ceil(F.col("total") / width).cast("long").alias("total"), F.col("top").alias("node"))
        nodes = tops


def _descend(rounds: Sequence[DataFrame], above: DataFrame) -> DataFrame:
    """The first round's rows with whole witnesses; `above` holds what follows for each `tree`: `upper`, and columns kept as they are."""
    more = [c for c in above.columns if c not in ("tree", "upper")]
    last = rounds[-1].join(above, "tree").withColumns({"witness": F.concat("witness", "upper"), "subroot": F.col("top")}).drop("upper")
    for grown in reversed(rounds[:-1]):
        up = last.select("tree", F.col("place").alias("block"), F.col("witness").alias("upper"), "subroot", *more)
        last = grown.join(up, ["tree", "block"]).withColumn("witness", F.concat("witness", "upper")).drop("upper")
    return last


def seal_pages(pages: DataFrame, fields: Sequence[str] = SNAPSHOT_FIELDS, carry: Sequence[str] = (), levels: int = LEVELS) -> DataFrame:
    """Seal captured pages under one root: one row per page with its leaf, its side's root, the root and its witness.

    `pages` holds `side`, `path` (any orderable type) and the `fields` that a leaf covers, by default those of a stored
    capture that tell its state; `carry` names columns to return as they are, other columns are ignored. A leaf is
    `page_leaf(*fields)`. In each side leaves ascend by path; while several nodes remain, every three in a row (the last
    run: fewer, even one) become the SHA-256 of their hex texts. What remains is the side's `subroot`; subroots, ordered
    by side, lead to the `root` likewise. Returns `side, path, leaf, subroot, root, witness` and `carry`; a witness has
    for each level the siblings on the left and on the right, as raw digests. `fold_root` checks a page against it.

    A null field has a mark of its own; a null side is a side like any other, before all others, and a null path comes
    first in its side. Pages that share side and path are ordered by leaf; rows equal in all of it are interchangeable and
    have a leaf each. A side of one page has that page's leaf as its subroot. An empty table returns no rows. A task
    appends 3**`levels` nodes at a time.
    """
    kept = pages.select(
        F.coalesce(F.concat(F.lit("="), F.col("side").cast("string")), F.lit("")).alias("tree"), "side", "path",
        F.unhex(page_leaf(*fields)).alias("node"), F.struct(*carry, F.lit(0).alias("_")).alias("carried"),
        F.monotonically_increasing_id().alias("tie"),
    )
    # The tie only deals equal rows to several tasks; such rows may stand in any order.
    rounds = _climb(_numbered(kept, ["path", "node", "tie"]).drop("tie"), levels)
    subroots = rounds[-1].filter("seat = 0").select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("top").alias("node"))
    sides = _climb(_numbered(subroots, ["of"]), levels)
    nothing = F.array().cast(_WITNESS)
    whole = sides[-1].filter("seat = 0").select("tree", F.col("top").alias("root"), nothing.alias("upper"))
    above = keep(_descend(sides, whole).select(F.col("of").alias("tree"), "root", F.col("witness").alias("upper")))
    sealed = _descend(rounds, above)
    return sealed.select("side", "path", _hex("node").alias("leaf"), _hex("subroot").alias("subroot"), _hex("root").alias("root"), "witness", *[F.col("carried")[c].alias(c) for c in carry])
