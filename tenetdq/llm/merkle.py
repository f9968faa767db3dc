"""Merkle manifest of a dataset: every row a leaf, a tree of fan-out three per source and one over the sources.

*Leaf*: the SHA-256 digest of the row's fields, each written as ``-`` (null) or its UTF-8 length, a colon and the
value. *Levels* are climbed by windows. Nodes stand in the order of their first leaf, so that at level k the
neighbours of a node are the rows ``FANOUT ** k`` places before and after it: fixed-offset lag and lead columns, masked
by the node's slot in its run and by the run's length, are its siblings, and the row in a run's first slot hashes them to
the parent. A node's siblings are then handed down to the rows below it by a running window of the same order.

``LEVELS`` levels share one shuffle: windows are keyed by source and a block of ``FANOUT ** LEVELS`` nodes, runs never
cross blocks, and the order never changes, so all windows of a block run in one stage after one sort. What a block
leaves is one node, so the next shuffle has 729 times fewer rows; a source of any size is spread over its blocks and
no window holds more than a block. Places within a source come from a range-partitioned running count. Each tier is a
table in the shared folder. The proof of a row is joined from the tier above by block: broadcast where that tier
is measured small, shuffled by block (at most 729 rows a key) otherwise.

Defined cases: every row is a leaf, repeated and empty ones too; rows of one source with equal identifiers are ordered
by their digests; null identifiers come first, and null sources are a source of their own, before all others; texts of any length
are hashed whole in the scan and never shuffled; columns not named as fields are ignored, whatever their names; an empty table has no rows and
no root.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenetdq.functions.lookup import attach
from tenetdq.functions.running import running
from tenetdq.llm.common import settled

FANOUT = 3
LEVELS = 6                     # levels between two shuffles
WIDTH = FANOUT ** LEVELS       # nodes of a block
STEP = "struct<left:string,right:string>"


def digest(*parts: Column) -> Column:
    """H: SHA-256 of the concatenated strings, as lower-case hex."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as its leaf writes it."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(*map(field, values))


def _up(n: Column, step: int) -> Column:
    return F.floor((n + (step - 1)) / step).cast("long")


def _within(nodes: DataFrame) -> DataFrame:
    """Climb ``LEVELS`` levels inside each block of nodes (g, pos, n, node, ...): adds block, path (the siblings left and
    right at each level that exists) and, in a block's first row, top (the node above the block)."""
    base = list(nodes.columns)
    place, n = F.col("pos"), F.col("n")
    window = Window.partitionBy("g", "block").orderBy("pos")
    rows = nodes.withColumn("block", F.floor(place / WIDTH).cast("long")).withColumn("up", F.col("node"))
    empty = F.lit("")
    for k in range(LEVELS):
        step = FANOUT ** k
        at = F.floor(place / step).cast("long")
        first, slot, width = place % step == 0, at % FANOUT, _up(n, step)
        run = F.least(F.lit(FANOUT).cast("long"), width - at + slot)
        near = rows.select("*", *[F.lag("up", j * step).over(window).alias(f"before{j}") for j in (1, 2)],
                           *[F.lead("up", j * step).over(window).alias(f"after{j}") for j in (1, 2)])
        left = F.concat(*[F.when(slot >= j, F.col(f"before{j}")).otherwise(empty) for j in (2, 1)])
        right = F.concat(*[F.when(run > slot + j, F.col(f"after{j}")).otherwise(empty) for j in (1, 2)])
        near = near.withColumn("step", F.struct(left.alias("left"), right.alias("right")))
        parent = F.when(width > 1, digest(F.col("up"), F.col("step.right"))).otherwise(F.col("up"))
        rows = near.select(*base, "block", *[f"step{j}" for j in range(k)],
                           F.when(first & (width > 1), F.col("step")).alias(f"step{k}"),
                           F.when(first & (slot == 0), parent).alias("up"))
    so_far = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    handed = [F.last(f"step{k}", ignorenulls=True).over(so_far).alias(f"step{k}") for k in range(LEVELS)]
    return rows.select(*base, "block", F.col("up").alias("top"), *handed).select(
        *base, "block", "top", F.array_compact(F.array(*[f"step{k}" for k in range(LEVELS)])).alias("path"))


def climb(nodes: DataFrame) -> DataFrame:
    """The nodes (g, pos, n, node, ...) with path (siblings from their level up to the top) and top of their tree g."""
    base = [c for c in nodes.columns if c != "n"]
    inside = settled(_within(nodes), "merkle-tier")
    heads = inside.where("top is not null").select("g", F.col("block").alias("pos"), _up(F.col("n"), WIDTH).alias("n"),
                                                   F.col("top").alias("node"))
    most = heads.agg(F.max("n")).first()[0]
    if most is None or most <= 1:
        above = heads.select("g", F.col("pos").alias("block"), F.array().cast(f"array<{STEP}>").alias("above"),
                             F.col("node").alias("top"))
    else:
        above = climb(heads).select("g", F.col("pos").alias("block"), F.col("path").alias("above"), "top")
    above = settled(above, "merkle-above")
    joined = attach(inside.drop("top"), above, ["g", "block"])
    return joined.select(*base, F.concat("path", "above").alias("path"), "top")


def numbered(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds pos, the place of each row in its group g, and n, the group's rows."""
    placed = running(leaves.withColumn("__one", F.lit(1).cast("long")), ["g"], order, {"pos": ("sum", "__one")})
    placed = settled(placed.drop("__one"), "merkle-places")
    counts = settled(placed.groupBy("g").agg(F.count("*").alias("n")), "merkle-counts")
    return attach(placed, counts, ["g"], weight="n")


def group_name(source: Column) -> Column:
    """A source as a non-null string whose byte order is that of the sources, null first."""
    return F.coalesce(F.concat(F.lit("1"), source.cast("string")), F.lit("0"))


def manifest(leaves: DataFrame, order: str = "doc_id", source: str = "source", keep: Sequence[str] = ()) -> DataFrame:
    """``leaves`` has the columns ``order``, ``source``, leaf and ``keep``. Returns these with pos (place in the source), subroot, root and
    path: the siblings (left, right) of each level from the leaf up to the root."""
    rows = settled(leaves.select(group_name(F.col(f"`{source}`")).alias("g"), F.col(f"`{order}`").alias("order"),
                                 F.col("leaf").alias("node"), *[F.col(f"`{c}`").alias(f"keep_{c}") for c in keep]),
                   "merkle-leaves")
    inner = climb(numbered(rows, [c for c in rows.columns if c != "g"]))
    subroots = inner.where("pos = 0").select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("top").alias("node"))
    outer = climb(numbered(settled(subroots, "merkle-subroots"), ["name"]))
    outer = settled(outer.select(F.col("name").alias("g"), F.col("path").alias("above"), F.col("top").alias("root"),
                                 F.col("node").alias("subroot")), "merkle-sources")
    sizes = settled(inner.groupBy("g").agg(F.count("*").alias("weight")), "merkle-sizes")
    joined = attach(inner, outer.join(sizes, "g"), ["g"], weight="weight")
    return joined.select(
        F.col("order").alias(order), F.when(F.col("g") != "0", F.substring("g", 2, 1 << 30)).alias(source),
        F.col("node").alias("leaf"), *[F.col(f"keep_{c}").alias(c) for c in keep], "pos", "subroot", "root",
        F.concat("path", "above").alias("path"))


def proof(path: Column) -> Column:
    """Digest of all siblings of a path, from the leaf up and left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def fold(node: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, node, lambda up, s: digest(s["left"], up, s["right"]))
