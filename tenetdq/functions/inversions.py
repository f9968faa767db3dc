"""Kendall's tau-b of any number of joint histograms, by distributed inversion counting.

Discordant pairs are inversions: cells sorted by x whose y goes down. Three sums count them, none of which needs a pair of cells
or a histogram in one place:

* cells are range partitioned by (key, x, y) and cut into parts of at most ``CHUNK``; inversions inside a part are counted by the
  levels of a merge sort, in array operations;
* what is left of a part are its y totals. These are range partitioned by (key, y) and cut likewise; inversions between different
  parts inside one y range are counted there;
* what is left is one total for each part and y range: a joint histogram again, with far fewer cells, and counted the same way.

A histogram of at most ``SMALL_CELLS`` cells (measured) is dealt by key and counted in one step.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tenetdq.session import settle, settle_measured

SMALL_CELLS = 250_000
CHUNK = 250_000                # rows a task counts at a time: about 30 arrays of so many numbers
PARTS = "k string, part long, y double, n double, d double"


def inversions(key: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Per key (0, 1, ...) the weight of all pairs of rows, in their given order, whose y goes down. Rows come grouped by key."""
    out = np.zeros(int(key[-1]) + 1 if len(key) else 0)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    place = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
    by_y = np.lexsort((place, y))
    levels = int(place.max()).bit_length() if len(key) else 0
    for level in range(levels):
        # rows of one node: its left half stands before its right half
        node = (key.astype(np.int64) << 40) + (place >> (level + 1))
        at = by_y[np.argsort(node[by_y], kind="stable")]
        node, left = node[at], (place[at] >> level) % 2 == 0
        seen = np.cumsum(np.where(left, n[at], 0.0))
        ends = np.append(np.flatnonzero(node[1:] != node[:-1]), len(node) - 1)
        total = np.repeat(seen[ends], np.diff(np.append(-1, ends)))
        greater = np.where(left, 0.0, n[at] * (total - seen))     # left rows of the node with a larger y
        out += np.bincount(key[at], greater, len(out))
    return out


def chunks(batches: Iterator[pa.RecordBatch], size: int, whole: Sequence[str] = ()) -> Iterator[pa.Table]:
    """Consecutive rows, about ``size`` at a time, never cut between rows that are equal in ``whole``."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= size:
            t = pa.Table.from_batches(held).combine_chunks()
            cut = t.num_rows
            if whole:
                last = [t[c][cut - 1].as_py() for c in whole]
                while cut and [t[c][cut - 1].as_py() for c in whole] == last:
                    cut -= 1
            if cut:
                yield t.slice(0, cut).combine_chunks()
                held, rows = t.slice(cut).to_batches(), t.num_rows - cut
    if any(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks()


def _keys(t: pa.Table) -> tuple[pa.Array, np.ndarray]:
    coded = t["k"].combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _totals(key: np.ndarray, value: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of equal (key, value)."""
    at = np.lexsort((value, key))
    k, v = key[at], value[at]
    first = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (v[1:] != v[:-1])))
    return k[first], v[first], np.add.reduceat(n[at], first)


def _emit(names: pa.Array, part: int, key: np.ndarray, y: np.ndarray, n: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    """Rows (k, part, y, n) and, for each key, its count d."""
    some, rest = len(key), len(d)
    nothing = np.ones(rest, bool)
    return pa.RecordBatch.from_arrays([
        names.take(pa.array(np.concatenate([key, np.arange(rest)]))), pa.array(np.full(some + rest, part, np.int64)),
        pa.array(np.concatenate([y, np.zeros(rest)]), mask=np.concatenate([np.zeros(some, bool), nothing])),
        pa.array(np.concatenate([n, np.zeros(rest)]), mask=np.concatenate([np.zeros(some, bool), nothing])),
        pa.array(np.concatenate([np.zeros(some), d]), mask=np.concatenate([np.ones(some, bool), ~nothing]))],
        ["k", "part", "y", "n", "d"])


def _by_x(size: int):
    """Inversions inside each part, and its y totals."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 24
        for at, t in enumerate(chunks(batches, size)):
            names, key = _keys(t)
            y, n = t["y"].to_numpy(), t["n"].to_numpy()
            yield _emit(names, task + at, *_totals(key, y, n), inversions(key, y, n))

    return count


def _by_y(size: int):
    """Inversions between the parts inside each y range (``part`` of the result), and its totals by part (``y`` of the result)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 24
        for at, t in enumerate(chunks(batches, size, ("k", "y"))):
            names, key = _keys(t)
            part, y, n = t["part"].to_numpy(), t["y"].to_numpy(), t["n"].to_numpy()
            order = np.lexsort((y, part, key))
            yield _emit(names, task + at, *_totals(key, part.astype(float), n), inversions(key[order], y[order], n[order]))

    return count


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Inversions of whole keys; a task holds at most ``SMALL_CELLS`` rows."""
    for t in chunks(batches, 1 << 62):
        names, key = _keys(t)
        yield pa.RecordBatch.from_arrays([names, pa.array(inversions(key, t["y"].to_numpy(), t["n"].to_numpy()))], ["k", "d"])


def discordant(cells: DataFrame, rows: int, size: int = CHUNK) -> DataFrame:
    """(k, d): weight of discordant pairs from a settled histogram (k, x, y, n) of ``rows`` distinct cells."""
    if rows <= SMALL_CELLS:
        return (cells.select("k", "x", "y", "n").repartition("k").sortWithinPartitions("k", "x", "y")
                .mapInArrow(_by_key, "k string, d double"))
    first = settle(cells.repartitionByRange("k", "x", "y").sortWithinPartitions("k", "x", "y").select("k", "y", "n")
                   .mapInArrow(_by_x(size), PARTS))
    parts = first.where("y is not null").select("k", "part", "y", "n")
    second, seen = settle_measured(parts.repartitionByRange("k", "y").sortWithinPartitions("k", "y").mapInArrow(_by_y(size), PARTS),
                                   rows=F.count("y"))
    coarse = second.where("y is not null").select("k", F.col("y").alias("x"), F.col("part").cast("double").alias("y"), "n")
    fewer = seen["rows"] if seen["rows"] < rows else min(seen["rows"], SMALL_CELLS)
    return (first.where("d > 0").select("k", "d").unionByName(second.where("d > 0").select("k", "d"))
            .unionByName(discordant(coarse, fewer, size)))


def kendall(hist: DataFrame, keys: Sequence[str], size: int = CHUNK) -> DataFrame:
    """(keys, tau, rows) from joint histograms (keys, x, y, n) with one row per cell; NaN where x or y is constant."""
    schema = ", ".join(f"`{c}` {hist.schema[c].dataType.simpleString()}" for c in keys)
    cells, seen = settle_measured(
        hist.select(F.to_json(F.struct(*[f"`{c}`" for c in keys])).alias("k"), F.col("x").cast("double").alias("x"),
                    F.col("y").cast("double").alias("y"), F.col("n").cast("double").alias("n")), rows=F.count(F.lit(1)))
    def tied(weight):
        return weight * (weight - 1) / 2

    def ties(column):
        return cells.groupBy("k", column).agg(F.sum("n").alias("n")).groupBy("k").agg(F.sum(tied(F.col("n"))).alias(f"t{column}"))

    parts = (cells.groupBy("k").agg(F.sum("n").alias("total"), F.sum(tied(F.col("n"))).alias("txy"))
             .unionByName(ties("x"), allowMissingColumns=True).unionByName(ties("y"), allowMissingColumns=True)
             .unionByName(discordant(cells, seen["rows"], size), allowMissingColumns=True))
    sums = parts.groupBy("k").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("total", "tx", "ty", "txy", "d")])
    pairs = tied(F.col("total"))
    free_x, free_y = pairs - F.col("tx"), pairs - F.col("ty")
    agree = pairs - F.col("tx") - F.col("ty") + F.col("txy") - F.col("d")
    tau = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (agree - F.col("d")) / F.sqrt(free_x) / F.sqrt(free_y)))
    return sums.select(F.from_json("k", schema).alias("k"), F.col("total").cast("long").alias("rows"),
                       F.when((free_x > 0) & (free_y > 0), tau).otherwise(F.lit(float("nan"))).alias("tau")).select(
        "k.*", "tau", "rows")
