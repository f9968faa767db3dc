"""Deciding most rows of a denial constraint with many comparisons from a few strong members.

A member is stronger than another when every probe that the other satisfies is satisfied by it as well. A small front of strong members,
found in one scan, settles most probes at once and makes most other members superfluous, whatever their number. What is left over is
decided elsewhere; nothing is dropped that the front does not prove to be decided.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tenetdq.plans.constraints import Predicate

FRONT = 256          # members that decide for the others; so many rows reach the driver
STEP = 16            # members tried before the rows they decide are set aside
KEY = "__key"


def _orders(rest: Sequence[Predicate]) -> list[int]:
    return [i for i, p in enumerate(rest) if p.op != "!="]


def _facing(column: np.ndarray, op: str) -> np.ndarray:
    """Values such that a smaller member is a stronger one, and a probe holds when its own value is larger."""
    return column if op in (">", ">=") else -column


class _Side:
    """Rows of one side as numbers: key and difference codes (of the given names), and facing values of the comparisons."""

    def __init__(self, table: pa.Table | pa.RecordBatch, rest: Sequence[Predicate], names: list[pa.Array]):
        coded = [pc.fill_null(pc.index_in(table[c], value_set=n), -1).to_numpy(zero_copy_only=False)
                 for c, n in zip([KEY, *[f"c{i}" for i, p in enumerate(rest) if p.op == "!="]], names, strict=True)]
        self.key, self.differ = coded[0], coded[1:]
        self.values = [_facing(table[f"c{i}"].to_numpy(zero_copy_only=False), rest[i].op) for i in _orders(rest)]

    def take(self, at: np.ndarray) -> "_Side":
        out = object.__new__(_Side)
        out.key, out.differ, out.values = self.key[at], [d[at] for d in self.differ], [v[at] for v in self.values]
        return out


def _names(table: pa.Table, rest: Sequence[Predicate]) -> list[pa.Array]:
    """The distinct keys, and the distinct values of each column that has to differ."""
    return [pc.unique(table[c].combine_chunks() if isinstance(table[c], pa.ChunkedArray) else table[c])
            for c in (KEY, *[f"c{i}" for i, p in enumerate(rest) if p.op == "!="])]


def _strongest(table: pa.Table, rest: Sequence[Predicate], most: int) -> pa.Table:
    """At most ``most`` rows of ``table``, none weaker than another of them, those first that stand before most others."""
    side, n = _Side(table, rest, _names(table, rest)), table.num_rows
    volume = np.zeros(n)
    for v in side.values:
        place = np.empty(n)
        place[np.argsort(v, kind="stable")] = np.arange(n)
        volume += np.log1p(n - place)
    left = np.argsort(-volume, kind="stable")
    picked = []
    while len(left) and len(picked) < most:
        best, rows = left[0], side.take(left)
        picked.append(best)
        weaker = rows.key == side.key[best]
        for mine, other in zip(rows.values, side.values):
            weaker &= mine >= other[best]
        for mine, other in zip(rows.differ, side.differ):
            weaker &= mine == other[best]
        weaker[0] = True
        left = left[~weaker]
    return table.take(pa.array(picked, pa.int64()))


def _front_of(rest: Sequence[Predicate], most: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        front = None
        for b in batches:
            if b.num_rows:
                t = pa.Table.from_batches([b])
                front = _strongest((t if front is None else pa.concat_tables([front, t])).combine_chunks(), rest, most)
        if front is not None:
            yield from front.combine_chunks().to_batches()

    return scan


def _satisfied(probes: _Side, front: _Side, strict: Sequence[bool]) -> np.ndarray:
    """Which probes some member of the front satisfies."""
    out, left = np.zeros(len(probes.key), bool), np.arange(len(probes.key))
    for at in range(0, len(front.key), STEP):
        rows, hit = probes.take(left), np.zeros(len(left), bool)
        for f in range(at, min(at + STEP, len(front.key))):
            ok = rows.key == front.key[f]
            for v, m, s in zip(rows.values, front.values, strict):
                ok &= (v > m[f]) if s else (v >= m[f])
            for v, m in zip(rows.differ, front.differ):
                ok &= v != m[f]
            hit |= ok
        out[left[hit]] = True
        left = left[~hit]
    return out


def _superfluous(members: _Side, front: _Side) -> np.ndarray:
    """Which members are no stronger than one of the front with the same differences, or, where a single column has to differ,
    than two of the front that differ in it: any probe differs from one of the two."""
    out, left = np.zeros(len(members.key), bool), np.arange(len(members.key))
    low = np.full(len(left), np.iinfo(np.int64).max)
    high = np.full(len(left), -1)
    for at in range(0, len(front.key), STEP):
        rows, weaker = members.take(left), np.zeros(len(left), bool)
        for f in range(at, min(at + STEP, len(front.key))):
            below = rows.key == front.key[f]
            for v, m in zip(rows.values, front.values):
                below &= v >= m[f]
            same = below.copy()
            for v, m in zip(rows.differ, front.differ):
                same &= v == m[f]
            weaker |= same
            if len(front.differ) == 1:
                code = front.differ[0][f]
                low[below], high[below] = np.minimum(low[below], code), np.maximum(high[below], code)
        if len(front.differ) == 1:
            weaker |= low < high
        out[left[weaker]] = True
        left, low, high = left[~weaker], low[~weaker], high[~weaker]
    return out


def _kernel(front: pa.Table, rest: Sequence[Predicate], probes: bool):
    """Probes with ``hit``; or the members that the front does not make superfluous."""
    strict = [rest[i].op in ("<", ">") for i in _orders(rest)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _names(front, rest)
        known = _Side(front.combine_chunks(), rest, names)
        for b in batches:
            side = _Side(b, rest, names)
            if probes:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_satisfied(side, known, strict))], [*b.schema.names, "hit"])
            else:
                yield b.filter(pa.array(~_superfluous(side, known)))

    return scan


def keyed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with one text for their keys; equal texts mean equal keys."""
    return rows.withColumn(KEY, F.to_json(F.struct(*keys)))


def front_of(members: DataFrame, rest: Sequence[Predicate]) -> pa.Table:
    """At most ``FRONT`` strong rows of ``members`` (with their key text): each task keeps so many, and so does a last one of theirs."""
    scan = _front_of(rest, FRONT)
    return members.mapInArrow(scan, members.schema).repartition(1).mapInArrow(scan, members.schema).toArrow()


def _best(op: str, probes: bool):
    """The value of a comparison that satisfies most: of members the smallest for ``>``, of probes the largest."""
    return F.max if (op in (">", ">=")) == probes else F.min


def reach(rows: DataFrame, rest: Sequence[Predicate], probes: bool = False) -> list[float | None]:
    """The best value of the rows for each comparison; None where there is no row."""
    return list(rows.agg(*[_best(rest[i].op, probes)(f"c{i}").alias(f"e{i}") for i in _orders(rest)]).first())


def open_reach(rest: Sequence[Predicate]) -> dict[str, Column]:
    """:func:`reach` of the probes without a hit, as columns to observe."""
    return {f"e{i}": _best(rest[i].op, True)(F.when(~F.col("hit"), F.col(f"c{i}"))) for i in _orders(rest)}


def within_reach(rows: DataFrame, rest: Sequence[Predicate], bounds: Sequence[float], probes: bool = False) -> DataFrame:
    """Rows that satisfy each comparison with the other side's best value."""
    for i, e in zip(_orders(rest), bounds, strict=True):
        a, b = (F.col(f"c{i}"), F.lit(e)) if probes else (F.lit(e), F.col(f"c{i}"))
        rows = rows.where({"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[rest[i].op])
    return rows


def judged(probes: DataFrame, rest: Sequence[Predicate], front: pa.Table, bounds: Sequence[float]) -> DataFrame:
    """Probes that some member may satisfy, with ``hit``: whether one of the front does."""
    rows = within_reach(probes, rest, bounds, probes=True)
    return rows.mapInArrow(_kernel(front, rest, True), rows.withColumn("hit", F.lit(True)).schema)


def needed(members: DataFrame, rest: Sequence[Predicate], front: pa.Table, bounds: Sequence[float]) -> DataFrame:
    """Members that may still decide a probe within ``bounds``: the front, and what it does not make superfluous."""
    rows = within_reach(members, rest, bounds)
    others = rows.mapInArrow(_kernel(front, rest, False), rows.schema)
    return others.unionByName(members.sparkSession.createDataFrame(front, members.schema)).drop(KEY).distinct()
