"""The counting kernel: many group-by statistics from one scan."""
from __future__ import annotations

import json
from dataclasses import dataclass
from itertools import combinations
from math import prod
from typing import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

COLLAPSE_ROWS = 1_000_000  # distinct tuples up to which a table is folded into weights
GRID_COLUMNS = 6           # columns from which pairs are counted on grids instead of by exploding
GRID_CELLS = 4_000_000     # counters of one pair that are added up densely; beyond, its codes are sorted
HELD_CODES = 16_000_000    # coded cells a task holds before their pairs are counted (64 MB)

Spec = tuple[tuple[str, ...], str]


@dataclass
class Weighted:
    """Rows with a multiplicity: either the table itself or its folded distinct tuples."""
    df: DataFrame
    weight: str = "n"


def fold_pays(cards: Sequence[int], n: int) -> bool:
    """Whether folding equal tuples is certain to pay: the product of the cardinalities bounds
    the number of distinct tuples, so no extra job is needed to decide."""
    return prod(max(1, c) for c in cards) <= max(COLLAPSE_ROWS, n // 20)


def value_counts(df: DataFrame, cols: Sequence[str], weight: str | None = None) -> DataFrame:
    """(column, value, n) for all ``cols`` from one exploded aggregation."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in cols]))
    total = F.count("*") if weight is None else F.sum("w")
    w = [] if weight is None else [F.col(weight).alias("w")]
    return (df.select(cells.alias("cell"), *w).select("cell.*", *(["w"] if w else []))
            .groupBy("column", "value").agg(total.alias("n")))


def literal_rows(rows: Sequence[dict], schema: str) -> Column:
    """A constant array of structs, whatever its length, as one expression."""
    return F.from_json(F.lit(json.dumps(list(rows))), f"array<struct<{schema}>>")


def joint_counts(rows: Weighted, cols: Sequence[str], specs: Sequence[Spec]) -> DataFrame:
    """(spec, lhs, rhs, n): joint value counts of every spec ``(lhs columns, rhs column)``.

    The specs travel as one constant array that is exploded per row, so one scan and one shuffle serve all of them.
    Map-side aggregation bounds what is shuffled by the number of
    distinct combinations, whatever the number of rows or the share of one value.
    """
    pos = {c: i for i, c in enumerate(cols)}
    base = rows.df.select(F.array(*[F.col(f"`{c}`") for c in cols]).alias("v"),
                          F.col(rows.weight).alias("w"))
    width = max(len(lhs) for lhs, _ in specs)
    told = literal_rows([{"spec": i, "r": pos[rhs], "size": len(lhs)} | {f"l{k}": pos[a] for k, a in enumerate(lhs)}
                         for i, (lhs, rhs) in enumerate(specs)],
                        ", ".join(["spec: int", "r: int", "size: int", *[f"l{k}: int" for k in range(width)]]))
    x = base.select("v", "w", F.explode(told).alias("s"))
    values = [F.get("v", F.col(f"s.l{k}")) for k in range(width)]
    lhs_vals = F.slice(F.array(*values), F.lit(1), F.col("s.size")) if width else F.array().cast("array<string>")
    return (x.select(F.col("s.spec").alias("spec"), lhs_vals.alias("lhs"), F.get("v", F.col("s.r")).alias("rhs"), "w")
            .groupBy("spec", "lhs", "rhs").agg(F.sum("w").alias("n")))


def spec_stats(counts: DataFrame) -> DataFrame:
    """Per spec: rows covered by the group majorities, groups, groups with several values."""
    groups = counts.groupBy("spec", "lhs").agg(
        F.max("n").alias("top"), F.sum("n").alias("size"), F.count("*").alias("values"))
    return groups.groupBy("spec").agg(
        F.sum("top").alias("covered"), F.sum("size").alias("rows"),
        F.count("*").alias("groups"), F.sum((F.col("values") > 1).cast("long")).alias("broken"))


def _both_directions(joint: DataFrame) -> DataFrame:
    """(l, r, covered, combos, rows) from joint counts (i, j, a, b, n) of unordered pairs."""
    both = joint.select("n", F.explode(F.array(
        F.struct(F.col("i").alias("l"), F.col("j").alias("r"), F.col("a").alias("key")),
        F.struct(F.col("j").alias("l"), F.col("i").alias("r"), F.col("b").alias("key")),
    )).alias("d")).select("d.*", "n")
    return (both.groupBy("l", "r", "key")
            .agg(F.max("n").alias("top"), F.sum("n").alias("size"), F.count("*").alias("values"))
            .groupBy("l", "r").agg(F.sum("top").alias("covered"), F.sum("values").alias("combos"),
                                   F.sum("size").alias("rows")))


def pair_stats(rows: Weighted, cols: Sequence[str]) -> DataFrame:
    """(l, r, covered, combos, rows) for all ordered pairs, by column position.

    Each unordered pair is counted once and read in both directions; one scan serves all pairs.
    """
    cols = list(cols)
    base = rows.df.select(F.array(*[F.col(f"`{c}`") for c in cols]).alias("v"),
                          F.col(rows.weight).alias("w"))
    last = len(cols) - 1
    left = base.select("v", "w", F.explode(F.sequence(F.lit(0), F.lit(max(0, last - 1)))).alias("i")).where(F.lit(last > 0))
    both = left.select("v", "w", "i", F.explode(F.sequence(F.col("i") + 1, F.lit(last))).alias("j"))
    return _both_directions(
        both.select("i", "j", F.get("v", F.col("i")).alias("a"), F.get("v", F.col("j")).alias("b"), "w")
        .groupBy("i", "j", "a", "b").agg(F.sum("w").alias("n")))


def _grid_kernel(values: list[list[str]]):
    """Arrow task: codes every column once, then counts each pair of the held rows by one integer histogram."""
    def count(batches):
        lookups = [pa.array(v, pa.string()) for v in values]
        held: list[list[np.ndarray]] = [[] for _ in values]
        size = 0

        def counted():
            codes = [np.concatenate(a) for a in held]
            for i, j in combinations(range(len(values)), 2):
                cells = len(values[i]) * len(values[j])
                key = codes[i].astype(np.int64) * len(values[j]) + codes[j]
                if cells <= max(GRID_CELLS, len(key)):
                    grid = np.bincount(key, minlength=cells)
                    at = np.flatnonzero(grid)
                    n = grid[at]
                else:
                    at, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), i, np.int32)), pa.array(np.full(len(at), j, np.int32)),
                     pa.array((at // len(values[j])).astype(np.int32)), pa.array((at % len(values[j])).astype(np.int32)),
                     pa.array(n)], names=["i", "j", "a", "b", "n"])

        for batch in batches:
            for c, lookup in enumerate(lookups):
                codes = pc.index_in(batch.column(c), value_set=lookup)
                held[c].append(codes.to_numpy(zero_copy_only=False).astype(np.int32))
            size += batch.num_rows
            if size * len(values) >= HELD_CODES:
                yield from counted()
                held, size = [[] for _ in values], 0
        if size:
            yield from counted()
    return count


def grid_pair_stats(df: DataFrame, cols: Sequence[str], values: dict[str, list[str]]) -> DataFrame:
    """:func:`pair_stats` for many columns whose distinct values are known and few.

    Exploding rows costs one record per row and pair; here a row is read and coded once, whatever the number of pairs, and
    a pair costs one integer addition. A task holds a bounded number of coded rows and the counters of one
    pair, and emits each pair's counts for the rows it held, so it reads several input splits: the
    shuffle grows with the number of tasks, not with the rows.
    """
    cols = list(cols)
    spark = df.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counted = df.select(*[f"`{c}`" for c in cols]).coalesce(tasks).mapInArrow(
        _grid_kernel([values[c] for c in cols]), "i int, j int, a int, b int, n long")
    return _both_directions(counted.groupBy("i", "j", "a", "b").agg(F.sum("n").alias("n")))
