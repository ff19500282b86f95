"""A Merkle manifest of a dataset: leaves, trees of three children, proofs and their check.

A leaf is the digest of a row. The leaves of a source, in order of doc_id, form a tree:
while more than one node remains, every three consecutive ones, or the fewer at the end,
become their parent. The roots of the sources, in order of source, form the crown, a tree
of the same kind, whose root stands for the dataset.

Trees are reduced superblock by superblock, 3**SPAN consecutive nodes of a tree in one
group, SPAN levels at once; what comes out are the nodes of the next round. So a tree of n
leaves takes log(n) / log(3**SPAN) rounds, and no group ever holds more than 3**SPAN rows.
On the way down, the nodes of a superblock are cogrouped with the one row that holds its
outer nodes: the siblings on the way from the superblock's own root to the dataset's. The
group reduces its nodes once more, which gives the inner siblings, and joins both to whole
paths; a path of a block's root is the outer row of the superblock below it. At the
leaves the paths become proofs, from which each row's root is folded again.

Places of leaves follow from range partitions and running sums over these, a row per
source and partition, so a source may hold any share of all rows.

Defined results: a null column is `-` in its leaf; a null source comes first and is a
source of its own; a null doc_id comes before all others; rows of equal doc_id are in
order of their leaves. A row alone in its source is its subroot, a source alone is the
root, and the proof of a row alone in the dataset is the digest of nothing. An empty table
gives no row. Columns that FIELDS does not name are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import ranged, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3
SPAN = 6  # levels of a superblock
TOP = "crown"  # the tree key of the crown

NODE = "tree string, pos long, n long, digest string"
OUTER = "tree string, block long, lefts array<string>, rights array<string>, subroot string, root string"
PROOF = "pos long, tree string, doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def leaf(fields: dict[str, Column]) -> Column:
    """The digest of a row: each field as byte count, colon and value."""
    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*(part(c) for c in fields.values())), 256)


def parent(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def _levels(digests: list[str], levels: int | None) -> list[list[str]]:
    """The nodes of each level, from the given ones up: so many levels, or up to a single node."""
    out = [digests]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        below = out[-1]
        out.append([parent(below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
    return out


def _within(n: int, span: int) -> int | None:
    """Levels of a superblock of a tree of n nodes: all there are, if it is the only one."""
    return None if n <= ARITY**span else span


def _inner(levels: list[list[str]], at: int) -> tuple[list[str], list[str]]:
    """The siblings left and right of node `at`, of each level but the last."""
    lefts, rights = [], []
    for nodes in levels[:-1]:
        first = at - at % ARITY
        lefts.append("".join(nodes[first:at]))
        rights.append("".join(nodes[at + 1 : first + ARITY]))
        at //= ARITY
    return lefts, rights


def fold(digest: str, lefts: list[str], rights: list[str]) -> str:
    for left, right in zip(lefts, rights):
        digest = parent([left, digest, right])
    return digest


def _block(span: int) -> Column:
    return F.floor(F.col("pos") / F.lit(ARITY**span)).cast("long").alias("block")


def _up(span: int):
    """The root of a superblock, as a node of the next round."""
    def run(nodes: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("pos")
        n, size = int(nodes["n"].iloc[0]), ARITY**span
        top = _levels(list(nodes["digest"]), _within(n, span))[-1][0]
        return pd.DataFrame({
            "tree": [nodes["tree"].iloc[0]], "pos": [int(nodes["pos"].iloc[0]) // size],
            "n": [-(-n // size)], "digest": [top],
        })

    return run


def _joined(nodes: pd.DataFrame, outer: pd.DataFrame, span: int):
    """Each node of a superblock, in order, with its whole path of siblings."""
    nodes = nodes.sort_values("pos")
    levels = _levels(list(nodes["digest"]), _within(int(nodes["n"].iloc[0]), span))
    lefts, rights = list(outer["lefts"].iloc[0]), list(outer["rights"].iloc[0])
    for at in range(len(nodes)):
        inner = _inner(levels, at)
        yield inner[0] + lefts, inner[1] + rights


def _down(span: int):
    """The outer rows of the superblocks whose roots the given nodes are."""
    def run(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("pos")
        paths = list(_joined(nodes, outer, span))
        return pd.DataFrame({
            "tree": list(nodes["tree"]), "block": list(nodes["pos"]), "lefts": [p[0] for p in paths],
            "rights": [p[1] for p in paths], "subroot": outer["subroot"].iloc[0], "root": outer["root"].iloc[0],
        })

    return run


def _proved(span: int):
    """The proof of each leaf, and the root that its present row folds to."""
    def run(leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        leaves = leaves.sort_values("pos")
        proofs, folded = [], []
        for (lefts, rights), now in zip(_joined(leaves, outer, span), leaves["now"]):
            proofs.append(parent([side for level in zip(lefts, rights) for side in level]))
            folded.append(fold(now, lefts, rights))
        return pd.DataFrame({
            "pos": list(leaves["pos"]), "tree": list(leaves["tree"]), "doc_id": list(leaves["doc_id"]),
            "leaf": list(leaves["digest"]), "subroot": outer["subroot"].iloc[0], "root": outer["root"].iloc[0],
            "proof_sha256": proofs, "folded_root": folded,
        })

    return run


def _placed(rows: DataFrame, *order: str) -> DataFrame:
    """`rows` with their places `pos` in their trees, in the given order, and the trees' sizes `n`."""
    sorted_rows = ranged(rows, "tree", *order)
    kept = written(sorted_rows.withColumn("mark", F.monotonically_increasing_id()), "merkle-nodes")
    parts = kept.groupBy("tree", "part").agg(F.min("mark").alias("lowest"), F.count("*").alias("size"))
    whole = Window.partitionBy("tree")
    before = F.sum("size").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = written(
        parts.select(
            "tree", "part", F.sum("size").over(whole).alias("n"),
            (F.coalesce(before, F.lit(0)) - F.col("lowest")).alias("shift"),
        ),
        "merkle-parts",  # its size is known then: Spark broadcasts it if it is small enough
    )
    return kept.join(parts, ["tree", "part"]).withColumn("pos", F.col("mark") + F.col("shift")).drop(
        "mark", "shift", "part"
    )


def _rounds(nodes: DataFrame, span: int) -> list[DataFrame]:
    """The nodes of each round, from the given ones up to one of each tree."""
    out = [nodes]
    while True:
        rest = out[-1] if len(out) == 1 else out[-1].where("n > 1")
        if len(out) > 1 and rest.isEmpty():
            return out
        up = rest.select("tree", "pos", "n", "digest", _block(span)).groupBy("tree", "block").applyInPandas(_up(span), NODE)
        out.append(written(up, "merkle-round"))


def _descended(rounds: list[DataFrame], crown: DataFrame, span: int) -> DataFrame:
    """The outer rows of the superblocks of the first round; `crown` has those of the trees' roots."""
    paths = None
    for k in range(len(rounds) - 1, 0, -1):
        ended = rounds[k].where("n = 1").select("tree").join(crown, "tree")
        outer = ended if paths is None else ended.unionByName(paths)
        if k == 1:
            return outer
        nodes = rounds[k - 1].where("n > 1").select("tree", "pos", "n", "digest", _block(span))
        down = nodes.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(_down(span), OUTER)
        paths = written(down, "merkle-paths")


def manifest(
    docs: DataFrame, *, text_now: Column | None = None, fields: tuple[str, ...] = FIELDS, span: int = SPAN,
) -> DataFrame:
    """A row per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    `text_now` is the text as it is found when the rows are checked; the leaf of that row
    is folded with the proof of the original one, and `verified` tells whether the root is
    the same. Without it the rows are checked as they are. `fields` are the columns of a
    leaf, among them doc_id, source and text.
    """
    columns = {c: F.col(c) for c in fields}
    original = leaf(columns)
    now = original if text_now is None else F.when(text_now.eqNullSafe(F.col("text")), original).otherwise(
        leaf(columns | {"text": text_now})
    )
    source = F.col("source").cast("string")
    rows = docs.select(
        F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit(":"), source)).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"), original.alias("digest"), now.alias("now"),
    )
    leaves = _placed(rows, "doc_id", "digest")
    rounds = _rounds(leaves, span)
    every = rounds[1]
    for more in rounds[2:]:
        every = every.unionByName(more)
    subroots = written(every.where("n = 1").select("tree", "digest"), "merkle-subroots")

    tops = _placed(subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("source"), "digest"), "source")
    above = _rounds(tops, span)
    none = F.array().cast("array<string>")
    start = above[-1].where("n = 1").select(
        "tree", F.lit(0).cast("long").alias("block"), none.alias("lefts"), none.alias("rights"),
        F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"),
    )
    blocks = tops.select("tree", "pos", "n", "digest", "source", _block(span))
    outer = _descended(above, start, span)
    crowned = blocks.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(_crown(span), OUTER)
    crown = written(crowned, "merkle-crown")

    # As text: pandas would make numbers with nulls floating ones.
    blocks = leaves.select("tree", "pos", "n", "digest", F.col("doc_id").cast("string"), "now", _block(span))
    outer = _descended(rounds, crown, span)
    proved = blocks.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(_proved(span), PROOF)
    return proved.drop("pos", "tree").withColumns({
        "doc_id": F.col("doc_id").cast("long"), "verified": F.col("folded_root") == F.col("root"),
    })


def _crown(span: int):
    """The outer row of each tree's root: its siblings among the subroots, and above them."""
    def run(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("pos")
        paths = list(_joined(nodes, outer, span))
        return pd.DataFrame({
            "tree": list(nodes["source"]), "block": 0, "lefts": [p[0] for p in paths],
            "rights": [p[1] for p in paths], "subroot": list(nodes["digest"]), "root": outer["root"].iloc[0],
        })

    return run
