"""Functional dependencies: confidences, mining, and the per-group statistics of given rules."""
from __future__ import annotations

from dataclasses import dataclass, field
from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from tenetdq.functions.counting import (GRID_COLUMNS, Spec, Weighted, grid_pair_stats, joint_counts,
                                        pair_stats, spec_stats)
from tenetdq.functions.lookup import row_width, within_broadcast
from tenetdq.plans.constraints import FunctionalDependency
from tenetdq.plans.frame import Frame
from tenetdq.session import settle_measured

Confidences = dict[str, dict[str, float]]

CANDIDATES = 8        # left-side extensions per target that one scan of plain rows tries


def modeling_rows(frame: Frame) -> Weighted:
    """The modeling columns as weighted tuples, folded when their combinations are few."""
    return frame.weighted(frame.profile.modeling())


def single_source_frame(frame: Frame, columns: Sequence[str]) -> DataFrame:
    """(lhs, rhs, confidence) for every ordered pair of ``columns``."""
    cols = list(columns)
    names = F.array(*[F.lit(c) for c in cols])
    return pair_stats(frame.weighted(cols), cols).select(
        names[F.col("l")].alias("lhs"), names[F.col("r")].alias("rhs"),
        (F.col("covered") / F.col("rows")).alias("confidence"))


def pair_table(frame: Frame, columns: Sequence[str]) -> DataFrame:
    """Pair statistics of modeling columns by the cheaper route: folded tuples or few columns
    are exploded; many columns over unfolded rows are counted on grids of their known values."""
    cols = list(columns)
    if not frame.is_folded(cols) and len(cols) >= GRID_COLUMNS:
        values = frame.known_values(cols)
        if values is not None:
            return grid_pair_stats(frame.df, cols, values)
    return pair_stats(frame.weighted(cols), cols)


def single_source_confidences(frame: Frame, max_combos: int | None = None) -> Confidences:
    """conf[A][B] for all ordered pairs of modeling columns. Pairs with more than
    ``max_combos`` distinct value pairs are left out when that bound is given."""
    cols, n = frame.profile.modeling(), frame.profile.rows
    conf = {a: {b: 0.0 for b in cols if b != a} for a in cols}
    if n == 0 or len(cols) < 2:
        return conf
    for r in pair_table(frame, cols).collect():
        a, b = cols[r["l"]], cols[r["r"]]
        if max_combos is not None and r["combos"] > max_combos:
            del conf[a][b]
        else:
            conf[a][b] = r["covered"] / n
    return conf


def fd_confidences(rows: Weighted, specs: Sequence[Spec], n: int) -> list[tuple[float, float]]:
    """(confidence, mean group size) of each ``(lhs columns, rhs)``, all from one job."""
    if not specs:
        return []
    if n == 0:
        return [(0.0, 0.0)] * len(specs)
    cols = sorted({c for lhs, rhs in specs for c in (*lhs, rhs)})
    found = {r["spec"]: r for r in spec_stats(joint_counts(rows, cols, specs)).collect()}
    return [(found[i]["covered"] / n, n / found[i]["groups"]) for i in range(len(specs))]


def confidence_frame(frame: Frame, specs: Sequence[Spec]) -> DataFrame:
    """(lhs, rhs, confidence, groups, avg_group_size) of arbitrary dependencies. An empty left
    side is one group, so its confidence is the base rate of the right side."""
    cols = sorted({c for lhs, rhs in specs for c in (*lhs, rhs)})
    names = frame.spark.createDataFrame(
        [(i, ", ".join(lhs), rhs) for i, (lhs, rhs) in enumerate(specs)],
        "spec int, lhs string, rhs string")
    stats = spec_stats(joint_counts(frame.weighted(cols), cols, specs))
    return stats.join(F.broadcast(names), "spec").select(
        "lhs", "rhs", (F.col("covered") / F.col("rows")).alias("confidence"), "groups",
        (F.col("rows") / F.col("groups")).alias("avg_group_size"))


@dataclass
class _Growth:
    """A target whose left side is still being extended."""
    rhs: str
    lhs: list[str]
    conf: float
    rest: list[str]
    open: bool = True


def mine(frame: Frame, tau: float = 0.90, lift: float = 0.10, max_lhs: int = 2,
         jump: float = 0.05, min_group: float = 3.0, conf: Confidences | None = None,
         order: dict[str, list[str]] | None = None, rows: Weighted | None = None,
         ) -> list[FunctionalDependency]:
    """At most one minimal dependency per modeling column.

    A single source that reaches ``tau`` wins; otherwise the best source is extended greedily,
    in confidence order, by attributes that raise the confidence by more than ``jump`` while
    groups keep ``min_group`` rows on average. All targets grow together: each round is one
    counting job, whatever the number of targets. ``order`` breaks ties between equally
    confident sources (default: column order).
    """
    prof = frame.profile
    cols, n = prof.modeling(), prof.rows
    if len(cols) < 2 or n == 0:
        return []
    rows = rows or modeling_rows(frame)
    conf = conf if conf is not None else single_source_confidences(frame)
    growing: list[_Growth] = []
    for rhs in cols:
        first = [a for a in (order or {}).get(rhs, []) if a in conf]
        sources = [a for a in [*first, *[c for c in cols if c not in first]] if a != rhs and rhs in conf[a]]
        ranked = sorted(sources, key=lambda a: -conf[a][rhs])
        if ranked:
            best = conf[ranked[0]][rhs]
            growing.append(_Growth(rhs, [ranked[0]], best, ranked[1:], best < tau and max_lhs > 1))
    # folded tuples are cheap to count, so every candidate is tried at once; over plain rows
    # the candidates are tried a few at a time, since the first acceptable one ends the search
    step = len(cols) if frame.is_folded(cols) else CANDIDATES
    while any(g.open and g.rest for g in growing):
        tried = [(g, a) for g in growing if g.open for a in g.rest[:step]]
        stats = fd_confidences(rows, [((*g.lhs, a), g.rhs) for g, a in tried], n)
        outcome = {(g.rhs, a): s for (g, a), s in zip(tried, stats)}
        for g in growing:
            if not g.open:
                continue
            taken = next((k for k, a in enumerate(g.rest[:step])
                          if outcome[g.rhs, a][0] > g.conf + jump
                          and outcome[g.rhs, a][1] >= min_group), None)
            if taken is None:
                g.rest = g.rest[step:]
                continue
            g.conf = outcome[g.rhs, g.rest[taken]][0]
            g.lhs.append(g.rest[taken])
            g.rest = g.rest[taken + 1:]
            g.open = g.conf < tau and len(g.lhs) < max_lhs
    return [FunctionalDependency(tuple(g.lhs), g.rhs, round(g.conf, 4)) for g in growing
            if g.conf >= tau and g.conf - prof.base_rate(g.rhs) >= lift]


def learn_simple(frame: Frame, tau: float = 0.90, lift: float = 0.10,
                 max_pair_entries: int | None = None) -> list[FunctionalDependency]:
    """Single-source dependencies over the whole table. ``max_pair_entries`` optionally drops
    pairs with more distinct combinations (off by default: the count is exact either way)."""
    conf = single_source_confidences(frame, max_pair_entries)
    return mine(frame, tau, lift, max_lhs=1, conf=conf)


@dataclass
class FdCells:
    """Joint counts of given dependencies with the statistics of their groups.

    One exploded scan serves all rules. ``df``: spec, lhs (array), rhs, n (rows of the cell),
    size (rows of the group), top (rows of the majority), mode (majority value, smallest on
    ties), values (distinct right-hand values of the group), violation = 1 - n/size.
    """
    fds: list[FunctionalDependency]
    df: DataFrame
    small: dict[int, bool] = field(default_factory=dict)     # whether a rule's cells may be broadcast
    rows: dict[int, int] = field(default_factory=dict)       # cells per rule

    def where(self, i: int, condition=None) -> DataFrame:
        d = self.df.where(F.col("spec") == i)
        return d if condition is None else d.where(condition)

    def table(self, i: int, *outputs, condition=None) -> DataFrame:
        """Cells of rule ``i`` under the names of its columns, plus ``outputs``."""
        fd = self.fds[i]
        return self.where(i, condition).select(
            *[F.col("lhs")[k].alias(a) for k, a in enumerate(fd.lhs)],
            F.col("rhs").alias(fd.rhs), *outputs)

    def groups(self, i: int, *outputs, condition=None) -> DataFrame:
        """Groups of rule ``i``: one row per left-hand combination."""
        fd = self.fds[i]
        outputs = outputs or ("size", "top", "mode", "values")
        g = self.where(i, condition).groupBy("lhs").agg(*[F.first(o).alias(o) for o in outputs])
        return g.select(*[F.col("lhs")[k].alias(a) for k, a in enumerate(fd.lhs)], *outputs)


def count_cells(frame: Frame, fds: Sequence[FunctionalDependency]) -> FdCells:
    """Count ``fds`` over the whole table. Both uses of the counts share one shuffle."""
    fds = list(fds)
    cols = sorted({c for fd in fds for c in fd.attributes})
    counts = joint_counts(frame.weighted(cols), cols, [(fd.lhs, fd.rhs) for fd in fds])
    groups = counts.groupBy("spec", "lhs").agg(
        F.sum("n").alias("size"), F.max("n").alias("top"),
        F.min_by("rhs", F.struct(-F.col("n"), F.col("rhs"))).alias("mode"),
        F.count("*").alias("values"))
    cells = (counts.join(groups, ["spec", "lhs"])
             .withColumn("violation", F.lit(1.0) - F.col("n") / F.col("size")))
    width = row_width(cells)
    mine = [F.col("spec") == i for i in range(len(fds))]
    cells, seen = settle_measured(cells, **{
        k: v for i, m in enumerate(mine)
        for k, v in ((f"r{i}", F.count(F.when(m, 1))), (f"b{i}", F.sum(F.when(m, width))))})
    small = {i: within_broadcast(seen[f"r{i}"], seen[f"b{i}"]) for i in range(len(fds))}
    rows = {i: seen[f"r{i}"] for i in range(len(fds))}
    return FdCells(fds, cells, small, rows)
