"""Prefix aggregates and average ranks over any number of rows, without a one-task window."""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tenetdq.functions.lookup import attach_cells, settle_sized
from tenetdq.session import settle

SMALL_HISTOGRAM = 1_000_000      # distinct values up to which one task ranks a histogram

_FN = {"sum": F.sum, "max": F.max, "min": F.min}


def _merge(kind: str, a: Column, b: Column) -> Column:
    if kind == "sum":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return (F.greatest if kind == "max" else F.least)(a, b)


def _codes(column: pa.Array) -> np.ndarray:
    """Equal values, nulls and NaNs included, as equal integers."""
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def _group_starts(batch: pa.RecordBatch, group: list[str], last: list | None) -> tuple[np.ndarray, bool]:
    """First rows of the groups in a sorted batch, and whether the first group goes on from ``last``."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for c in group:
        codes = _codes(batch.column(c))
        new[1:] |= codes[1:] != codes[:-1]
    same = last is not None and all(_equal(batch.column(c)[0].as_py(), v) for c, v in zip(group, last))
    return np.flatnonzero(new), same


def _equal(a, b) -> bool:
    return a == b or (a != a and b != b)


def _numbers(column: pa.Array, empty) -> np.ndarray:
    return pc.fill_null(column, empty).to_numpy(zero_copy_only=False)


class _Sum:
    """Sum of the rows before each one; integers stay exact."""

    def __init__(self, kind: pa.DataType):
        self.kind = pa.int64() if pa.types.is_integer(kind) else pa.float64()
        self.start = self.carry = 0 if pa.types.is_integer(kind) else 0.0

    def scan(self, column: pa.Array, bounds: list[tuple[int, int]], same: bool) -> pa.Array:
        v = _numbers(column.cast(self.kind), self.start)
        out = np.empty_like(v)
        if len(bounds) > len(v) // 4 and v.dtype == np.int64:          # many small groups: one pass, exact
            total = np.cumsum(v)
            first = np.array([s for s, _ in bounds])
            base = (total - v)[first]
            out = total - v - np.repeat(base, np.diff(np.append(first, len(v))))
            if same:
                out[:bounds[0][1]] += self.carry
            self.carry = out[-1] + v[-1]
            return pa.array(out)
        for k, (s, e) in enumerate(bounds):
            carry = self.carry if not k and same else self.start
            sums = np.cumsum(np.concatenate([[carry], v[s:e]]))
            out[s:e], self.carry = sums[:-1], sums[-1]
        return pa.array(out)


class _Extreme:
    """Largest or smallest value of the rows before each one; null where there is none."""

    def __init__(self, kind: pa.DataType, largest: bool):
        self.kind, self.largest, self.carry = kind, largest, None
        self.number = pa.types.is_floating(kind) or pa.types.is_integer(kind)
        if self.number:
            low, high = ((-np.inf, np.inf) if pa.types.is_floating(kind) else
                         (np.iinfo(kind.to_pandas_dtype()).min, np.iinfo(kind.to_pandas_dtype()).max))
            self.worst = low if largest else high

    def scan(self, column: pa.Array, bounds: list[tuple[int, int]], same: bool) -> pa.Array:
        if not self.number:
            return self._objects(column.to_pylist(), bounds, same)
        present = column.is_valid().to_numpy(zero_copy_only=False)
        v = _numbers(column, self.worst)
        over = np.maximum if self.largest else np.fmin          # NaN is the largest number
        out, some = np.full(len(v), self.worst, v.dtype), np.zeros(len(v), bool)
        for k, (s, e) in enumerate(bounds):
            carry = self.carry if not k and same else None
            best = over.accumulate(v[s:e])
            seen = np.logical_or.accumulate(present[s:e])
            if carry is not None:
                best, seen = over(best, carry), np.ones(e - s, bool)
                out[s], some[s] = carry, True
            out[s + 1:e], some[s + 1:e] = best[:-1], seen[:-1]
            self.carry = best[-1] if seen[-1] else None
        return pa.array(out, self.kind, mask=~some)

    def _objects(self, v: list, bounds: list[tuple[int, int]], same: bool) -> pa.Array:
        out, pick = [], max if self.largest else min
        for k, (s, e) in enumerate(bounds):
            best = self.carry if not k and same else None
            for x in v[s:e]:
                out.append(best)
                if x is not None:
                    best = x if best is None else pick(best, x)
            self.carry = best
        return pa.array(out, self.kind)


def _scan(group: list[str], aggs: list[tuple[str, str, str]]):
    """Arrow function over one sorted range partition: the aggregates before each row, with the state carried over batches."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, last, states = TaskContext.get().partitionId(), 0, None, None
        for b in batches:
            if not b.num_rows:
                continue
            states = states or [_Sum(b.schema.field(c).type) if k == "sum" else _Extreme(b.schema.field(c).type, k == "max")
                                for _, k, c in aggs]
            starts, same = _group_starts(b, group, last)
            bounds = list(zip(starts.tolist(), [*starts[1:].tolist(), b.num_rows]))
            found = [s.scan(b.column(c), bounds, same) for s, (_, _, c) in zip(states, aggs)]
            last = [b.column(c)[b.num_rows - 1].as_py() for c in group]
            own = [pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(at, at + b.num_rows))]
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, *found, *own],
                                             [*b.schema.names, *[o for o, _, _ in aggs], "__part", "__seq"])
    return scan


def running(points: DataFrame, group: Sequence[str], order: Sequence[str],
            aggs: dict[str, tuple[str, str]], small: bool = False) -> DataFrame:
    """Adds, per row, aggregates over all rows of its group that come strictly before it.

    ``order`` must be unique within a group. ``aggs`` maps an output column to
    ``(sum|max|min, input column)``; sums of integers are long, others double. ``small=True`` promises that a
    single group fits a task. Otherwise the points are range partitioned and sorted, which is the only shuffle; each
    partition is scanned once with the state carried along, and corrected by what
    the earlier partitions of the same group add up to: only a partition's last group can go on in the
    next one, so that correction has no more rows than partitions.
    """
    group, order = list(group), list(order)
    if small:
        w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return points.select("*", *[
            (F.coalesce(F.sum(c).over(w), F.lit(0)) if k == "sum" else _FN[k](c).over(w)).alias(o)
            for o, (k, c) in aggs.items()])
    types = {f.name: f.dataType for f in points.schema.fields}
    made = [T.StructField(o, (T.LongType() if isinstance(types[c], T.IntegralType) else T.DoubleType()) if k == "sum" else types[c])
            for o, (k, c) in aggs.items()]
    schema = T.StructType([*points.schema.fields, *made, T.StructField("__part", T.IntegerType()), T.StructField("__seq", T.LongType())])
    scanned = settle(points.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
                     .mapInArrow(_scan(group, [(o, k, c) for o, (k, c) in aggs.items()]), schema))
    upto = [_merge(k, F.col(o), F.col(c)).alias(o) for o, (k, c) in aggs.items()]
    ends = scanned.groupBy("__part").agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in group], *upto), "__seq").alias("e"))
    in_order = Window.orderBy("__part")                       # one row per partition
    of_group = Window.partitionBy(*[f"`{c}`" for c in group]).orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)
    carry = ends.select("__part", "e.*").select(
        F.lead("__part").over(in_order).alias("__next"), *[F.col(f"`{c}`").alias(f"__g{i}") for i, c in enumerate(group)],
        *[_FN[k](o).over(of_group).alias(f"__{o}_carry") for o, (k, _) in aggs.items()]).where("__next is not null")
    match = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(group)],
                   F.col("__part") == F.col("__next"))
    return scanned.join(F.broadcast(carry), match, "left").select(*[f"`{c}`" for c in points.columns], *[
        _merge(k, F.col(o), F.col(f"__{o}_carry")).alias(o) for o, (k, _) in aggs.items()])


def average_rank(hist: DataFrame, group: Sequence[str], value: str, weight: str,
                 constant_to_zero: bool = False, small: bool = False,
                 out: str = "rank01") -> DataFrame:
    """(group, value, weight, out): average rank / n of every distinct value of a weighted
    histogram.

    ``group`` names a bounded set (columns and metrics), so its totals are broadcast.
    """
    group = list(group)
    if not group:
        one = average_rank(hist.withColumn("__all", F.lit(0)), ["__all"], value, weight,
                           constant_to_zero, small, out)
        return one.drop("__all")
    h = hist.groupBy(*group, value).agg(F.sum(weight).alias("__w"))
    totals = hist.groupBy(*group).agg(
        F.sum(weight).alias("__n"), F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    ranked = running(h, group, [value], {"__before": ("sum", "__w")}, small=small)
    ranked = ranked.join(F.broadcast(totals), group)
    rank = (F.col("__before") + (F.col("__w") + 1) / 2) / F.col("__n")
    if constant_to_zero:
        rank = F.when(F.col("__lo") == F.col("__hi"), F.lit(0.0)).otherwise(rank)
    return ranked.select(*group, value, F.col("__w").alias(weight), rank.alias(out))


def small_rank(hist: DataFrame, group: Sequence[str], value: str, weight: str,
               constant_to_zero: bool = False, out: str = "rank01") -> DataFrame:
    """``hist`` plus the average rank / n of ``value`` per group, by windows: for histograms
    measured to fit a task."""
    group = list(group)
    if not group:
        return small_rank(hist.withColumn("__all", F.lit(0)), ["__all"], value, weight,
                          constant_to_zero, out).drop("__all")
    whole = Window.partitionBy(*group)
    upto = whole.orderBy(value)                       # ties included
    ties = Window.partitionBy(*group, value)
    rank = ((F.sum(weight).over(upto) - (F.sum(weight).over(ties) - 1) / 2) / F.sum(weight).over(whole))
    if constant_to_zero:
        rank = F.when(F.min(value).over(whole) == F.max(value).over(whole), F.lit(0.0)).otherwise(rank)
    return hist.withColumn(out, rank)


def weighted_median(hist: DataFrame, group: Sequence[str], value: str, weight: str,
                    small: bool = False, out: str = "median") -> DataFrame:
    """Exact median per group of a weighted histogram, interpolating between the two middles.

    ``small=True`` (a bounded number of distinct values per group) uses the built-in weighted
    percentile; otherwise the middle values are picked from a distributed running count.
    """
    group = list(group)
    if not group:
        return weighted_median(hist.withColumn("__all", F.lit(0)), ["__all"], value, weight,
                               small, out).drop("__all")
    if small:
        return hist.groupBy(*group).agg(
            F.expr(f"percentile(`{value}`, 0.5D, `{weight}`)").alias(out))
    h = hist.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.sum(weight).alias("__w"))
    h = running(h, group, [value], {"__before": ("sum", "__w")})
    totals = hist.where(F.col(value).isNotNull()).groupBy(*group).agg(F.sum(weight).alias("__n"))
    h = h.join(totals, group)
    lo, hi = F.floor((F.col("__n") + 1) / 2), F.floor(F.col("__n") / 2) + 1
    end = F.col("__before") + F.col("__w")
    mid = h.where((end >= lo) & (F.col("__before") < hi))
    pick_lo = F.min(F.when(end >= lo, F.col(value)))
    pick_hi = F.max(F.when(F.col("__before") < hi, F.col(value)))
    return mid.groupBy(*group).agg((pick_lo * 0.5 + pick_hi * 0.5).alias(out))


def rank_columns(scores: DataFrame, columns: Sequence[str], constant_to_zero: bool = True) -> DataFrame:
    """Replaces every score column of a wide frame by its average rank / n.

    One exploded histogram ranks all columns. Where it is measured small, rows look their ranks up per column in one narrow
    pass; otherwise the cells of all columns meet their ranks in one shuffle and go back to their rows in another,
    whatever the number of columns. ``scores`` is settled first, so both reads see the same bits.
    """
    scores = settle(scores)
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("score"))
        for c in columns]))
    hist = scores.select(cells.alias("c")).select("c.*").groupBy("column", "score").agg(
        F.count("*").alias("n"))
    hist, small, rows = settle_sized(hist)
    if rows <= SMALL_HISTOGRAM:
        whole = Window.partitionBy("column")
        upto = whole.orderBy("score").rowsBetween(Window.unboundedPreceding, 0)      # every score is there once
        rank = (F.sum("n").over(upto) - (F.col("n") - 1) / 2) / F.sum("n").over(whole)
        if constant_to_zero:
            rank = F.when(F.min("score").over(whole) == F.max("score").over(whole), F.lit(0.0)).otherwise(rank)
        ranks = hist.withColumn("rank01", rank)
    else:
        ranks = settle(average_rank(hist, ["column"], "score", "n", constant_to_zero))
    if not small:
        return attach_cells(scores, ranks, {c: c for c in columns}, "rank01", "score").select(*[f"`{c}`" for c in scores.columns])
    out = scores
    for c in columns:
        table = ranks.where(F.col("column") == c).select(F.col("score").alias(c), F.col("rank01").alias("__rank"))
        out = (out.withColumn(c, F.col(f"`{c}`").cast("double")).join(F.broadcast(table), c, "left")
               .withColumn(c, F.col("__rank")).drop("__rank"))
    return out.select(*[f"`{c}`" for c in scores.columns])
