"""Isotonic least-squares fits over any number of points: pooled blocks per range partition, merged in a tree.

Pooling adjacent violators can start from blocks that are pooled already, so every range partition pools its own points, and
only blocks that are at odds with another partition go on: a block that no earlier one exceeds and no later one
undercuts is final, and nothing is ever pooled across it. The others are merged ``FAN`` partitions at a time, and what a merge leaves
is compared again. Points get the value of their block by a running maximum, since fitted values only grow.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tenetdq.functions.inversions import CHUNK, chunks
from tenetdq.functions.running import running
from tenetdq.session import settle, settle_measured

FAN = 8
BLOCKS = "g string, part long, x double, y double, n double"


def pooled(y: np.ndarray, w: np.ndarray) -> tuple[list[float], list[float], list[int]]:
    """Means, weights and lengths of the blocks of a non-decreasing least-squares fit of ``y`` in its order."""
    means: list[float] = []
    weights: list[float] = []
    sizes: list[int] = []
    for value, weight in zip(y.tolist(), w.tolist()):
        size = 1
        while means and means[-1] >= value:
            total = weights[-1] + weight
            value = (means.pop() * weights[-1] + value * weight) / total
            weight = total
            weights.pop()
            size += sizes.pop()
        means.append(value)
        weights.append(weight)
        sizes.append(size)
    return means, weights, sizes


def isotonic_fit(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted non-decreasing least-squares fit of ``y`` (already ordered by x)."""
    means, _, sizes = pooled(y, w)
    return np.repeat(means, sizes)


def _blocks(t: pa.Table, part: int) -> Iterator[pa.RecordBatch]:
    """Blocks of each group of a table sorted by (g, x); a block is named by its first x."""
    names, x = t["g"].combine_chunks(), t["x"].to_numpy()
    codes = names.dictionary_encode()
    codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
    y, n = t["y"].to_numpy(), t["n"].to_numpy()
    starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(y)]):
        means, weights, sizes = pooled(y[s:e], n[s:e])
        first = s + np.cumsum([0, *sizes[:-1]])
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[s].as_py()] * len(means), pa.string()), pa.array(np.full(len(means), part, np.int64)),
             pa.array(x[first]), pa.array(means, pa.float64()), pa.array(weights, pa.float64())], ["g", "part", "x", "y", "n"])


def _pool_parts(size: int):
    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 24
        for at, t in enumerate(chunks(batches, size)):
            yield from _blocks(t, task + at)

    return pool


def _merge(group: pa.Table) -> pa.Table:
    t = group.sort_by("x").combine_chunks()
    return pa.Table.from_batches(list(_blocks(t, t["up"][0].as_py())))


def blocks_of(points: DataFrame, size: int = CHUNK) -> DataFrame:
    """(g, x, y): the blocks of the fit of y on x in each group, by their first x."""
    found = settle(points.select("g", "x", F.col("y").cast("double").alias("y"), F.col("n").cast("double").alias("n"))
                   .repartitionByRange("g", "x").sortWithinPartitions("g", "x").mapInArrow(_pool_parts(size), BLOCKS))
    places = found.select("part").distinct().select(                # one row per part
        "part", (F.row_number().over(Window.orderBy("part")) - 1).cast("long").alias("place"))
    found = settle(found.join(F.broadcast(places), "part").select("g", F.col("place").alias("part"), "x", "y", "n"))
    final = []
    while True:
        ends = found.groupBy("g", "part").agg(F.min("y").alias("least"), F.max("y").alias("most"))    # a row per group and part
        order = Window.partitionBy("g").orderBy("part")
        near = ends.select("g", "part", F.max("most").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
                           F.min("least").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
        judged, seen = settle_measured(
            found.join(near, ["g", "part"]).withColumn(
                "open", F.coalesce(F.col("y") < F.col("before"), F.lit(False)) | F.coalesce(F.col("y") > F.col("after"), F.lit(False))
            ).drop("before", "after"), open=F.sum(F.col("open").cast("long")))
        final.append(judged.where("not open").select("g", "x", "y"))
        if not seen["open"]:
            break
        found = settle(judged.where("open").drop("open").withColumn("up", F.floor(F.col("part") / FAN).cast("long"))
                       .groupBy("g", "up").applyInArrow(_merge, BLOCKS))
    out = final[0]
    for f in final[1:]:
        out = out.unionByName(f)
    return out


def fitted(points: DataFrame, size: int = CHUNK) -> DataFrame:
    """(g, x, fit): non-decreasing fit of points (g, x, y, n), one per g and x."""
    blocks = blocks_of(points, size)
    both = points.select("g", "x", F.lit(1).alias("turn"), F.lit(None).cast("double").alias("value")).unionByName(
        blocks.select("g", "x", F.lit(0).alias("turn"), F.col("y").alias("value")))
    return running(both, ["g"], ["x", "turn"], {"fit": ("max", "value")}).where("turn = 1").select("g", "x", "fit")
