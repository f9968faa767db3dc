"""Order dependencies: discovery by Kendall's tau and scoring against an isotonic trend.

Everything is computed from joint value histograms. Tau counts inversions by range partitions, trends pool blocks by range
partitions, so neither a column pair nor a context has to fit a task; histograms measured small take a shorter way.
"""
from __future__ import annotations

from dataclasses import dataclass, field
from typing import Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tenetdq.functions.counting import Weighted, literal_rows
from tenetdq.functions.inversions import kendall
from tenetdq.functions.isotonic import fitted, isotonic_fit
from tenetdq.functions.running import weighted_median
from tenetdq.functions.values import as_number, finite
from tenetdq.operators.fd import Confidences, fd_confidences, modeling_rows
from tenetdq.operators.monitors import order_constraint
from tenetdq.operators.profile import NUMERIC
from tenetdq.operators.ranking import Cells, score_by_cells
from tenetdq.plans.constraints import DenialConstraint
from tenetdq.plans.frame import Frame
from tenetdq.session import settle, settle_measured

MIN_FIT = 5            # points a context needs before a trend is fitted
NOISE = 12             # decimals kept of a residual, so equal ones rank equal
SMALL_POINTS = 1_000_000  # value combinations up to which a context is fitted in one task


def group_taus(rows: Weighted, pairs: Sequence[tuple[str, str]], contexts: Sequence[str]) -> DataFrame:
    """(pair, context, group, tau, rows): tau-b of every pair, overall (context null) and in
    every value of every context column. Rows where either side is no number are left out."""
    numbers = sorted({c for p in pairs for c in p})
    at, place = {c: i for i, c in enumerate(numbers)}, {c: i for i, c in enumerate(contexts)}
    nothing = F.array().cast("array<string>")
    base = rows.df.select(
        F.array(*[as_number(F.col(f"`{c}`")) for c in numbers]).alias("z"),
        (F.array(*[F.col(f"`{c}`") for c in contexts]) if contexts else nothing).alias("v"), F.col(rows.weight).alias("w"))
    names = F.array(*[F.lit(c) for c in contexts]) if contexts else nothing
    todo = [(k, at[x], at[y], place[c] if c else -1) for k, (x, y) in enumerate(pairs) for c in [None, *contexts]]
    told = literal_rows([{"pair": k, "x": x, "y": y, "c": c} for k, x, y, c in todo], "pair: int, x: int, y: int, c: int")
    own = F.col("s.c") >= 0
    out = (base.select("z", "v", "w", F.explode(told).alias("s"))
           .select(F.col("s.pair").alias("pair"), F.when(own, F.get(names, F.col("s.c"))).alias("context"),
                   F.when(own, F.get(F.col("v"), F.col("s.c"))).alias("group"),
                   F.get("z", F.col("s.x")).alias("x"), F.get("z", F.col("s.y")).alias("y"), "w")
           .where("x is not null and y is not null")
           .groupBy("pair", "context", "group", "x", "y").agg(F.sum("w").alias("n")))
    return kendall(out, ["pair", "context", "group"]).select("pair", "context", "group", "tau", "rows")


def context_taus(taus: DataFrame, min_group: int) -> DataFrame:
    """(pair, context, tau): size-weighted signed mean over the groups of each context with at
    least ``min_group`` rows; the overall tau where context is null; 0 where none is defined."""
    usable = ~F.isnan("tau") & (F.col("context").isNull() | (F.col("rows") >= min_group))
    num = F.sum(F.when(usable, F.col("tau") * F.col("rows")))
    den = F.sum(F.when(usable, F.col("rows")))
    return taus.groupBy("pair", "context").agg(F.coalesce(num / den, F.lit(0.0)).alias("tau"))


@dataclass(frozen=True)
class OrderSpec:
    x: str
    y: str
    context: str | None
    increasing: bool
    strength: float

    @classmethod
    def of_rule(cls, rule: DenialConstraint) -> tuple["OrderSpec", list[str]] | None:
        """The trend a denial constraint forbids to break, and its context columns; None if it compares
        fewer than two columns by size."""
        by = rule.columns_by_operator()
        compared = [(p.left, p.op) for p in rule.predicates if p.op in "<>"]
        if len(compared) < 2:
            return None
        context = by.get("=", [])
        (x, _), (y, sign) = compared[0], compared[-1]
        return cls(x, y, context[0] if context else None, sign == "<", rule.confidence), context


@dataclass
class OrderLearner:
    """Monotone column pairs, optionally within a categorical context."""
    tau_threshold: float = 0.6
    ctx_cap: int = 60
    min_group: int = 30
    min_distinct: int = 5
    max_functional: float = 0.95
    specs: dict[str, OrderSpec] = field(default_factory=dict)
    rules_: list[DenialConstraint] = field(default_factory=list)

    def fit(self, frame: Frame, conf: Confidences | None = None,
            rows: Weighted | None = None) -> "OrderLearner":
        prof = frame.profile
        self.specs, self.rules_ = {}, []
        num = prof.numeric()
        contexts = [c for c in prof.modeling()
                    if prof.kinds[c] != NUMERIC and prof.cards[c] <= self.ctx_cap]
        pairs = [(x, y) for i, x in enumerate(num) for y in num[i + 1:]]
        if not pairs:
            return self
        rows = rows or modeling_rows(frame)
        best: dict[int, tuple[str | None, float]] = {}
        found = {(r["pair"], r["context"]): r["tau"]
                 for r in context_taus(group_taus(rows, pairs, contexts), self.min_group).collect()}
        for k in range(len(pairs)):
            best[k] = (None, found.get((k, None), 0.0))
            for c in contexts:
                t = found.get((k, c), 0.0)
                if abs(t) > abs(best[k][1]):
                    best[k] = (c, t)
        strong = [k for k in best if abs(best[k][1]) >= self.tau_threshold]
        if not strong:
            return self
        spread = self._spread(rows, {(pairs[k][0], best[k][0]) for k in strong})
        if conf is None:
            stats = fd_confidences(rows, [((pairs[k][0],), pairs[k][1]) for k in strong], prof.rows)
            functional = {k: s[0] for k, s in zip(strong, stats)}
        else:
            functional = {k: conf[pairs[k][0]][pairs[k][1]] for k in strong}
        for k in strong:
            (x, y), (c, t) = pairs[k], best[k]
            if spread[x, c] < self.min_distinct or functional[k] >= self.max_functional:
                continue
            spec = OrderSpec(x, y, c, t > 0, (abs(t) + 1) / 2)
            self.specs[y] = spec
            self.rules_.append(order_constraint(x, y, c, spec.increasing, round(spec.strength, 4)))
        return self

    @staticmethod
    def _spread(rows: Weighted, wanted: set) -> dict:
        """Mean number of distinct numeric X per context value, for each (x, context)."""
        parts = None
        for x, c in sorted(wanted, key=str):
            ctx = F.col(f"`{c}`") if c else F.lit("")
            part = (rows.df.select(ctx.alias("g"), as_number(F.col(f"`{x}`")).alias("x")).distinct()
                    .groupBy("g").agg(F.count("x").alias("d"))
                    .agg(F.lit(x).alias("col"), F.lit(c).cast("string").alias("ctx"), F.avg("d").alias("mean")))
            parts = part if parts is None else parts.unionByName(part)
        return {(r["col"], r["ctx"]): r["mean"] or 0.0 for r in parts.collect()}

    @property
    def governed(self) -> set[str]:
        return set(self.specs)

    def rules(self) -> list[DenialConstraint]:
        return list(self.rules_)

    def cells(self, frame: Frame, column: str) -> Cells:
        """Residual score of each value combination."""
        s = self.specs[column]
        keys = ([s.context] if s.context else []) + [s.x, s.y]
        table = order_cells(frame.weighted(keys), s)
        return Cells(keys, table.select(*[F.col(k).alias(n) for k, n in zip(_cell_keys(s), keys)], "score", "n"))

    def score(self, frame: Frame) -> DataFrame:
        """Wide scores: average rank of the residual for governed columns, 0 elsewhere."""
        return score_by_cells(frame, {c: self.cells(frame, c) for c in self.specs},
                              constant_to_zero=False)


def _cell_keys(s: OrderSpec) -> list[str]:
    return (["ctx"] if s.context else []) + ["xt", "yt"]


def _fit_group(increasing: bool):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        if pdf["n"].sum() < MIN_FIT:
            return pdf.iloc[:0][["g", "x"]].assign(fit=pd.Series(dtype=float))
        sign = 1.0 if increasing else -1.0
        fitted = sign * isotonic_fit(sign * pdf["y"].to_numpy(), pdf["n"].to_numpy(float))
        return pdf[["g", "x"]].assign(fit=fitted)
    return fit


def trend(cells: DataFrame, increasing: bool, small: bool = True) -> DataFrame:
    """(g, x, fit): isotonic trend of y on x per group, from cells (g, x, y, n); groups of fewer than ``MIN_FIT`` rows have none.

    ``small`` promises that the points of a group, one for each distinct x, fit a task."""
    points = cells.dropna(subset=["x", "y"]).groupBy("g", "x").agg(
        (F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("y"), F.sum("n").alias("n"))
    if small:
        return points.groupBy("g").applyInPandas(_fit_group(increasing), "g string, x double, fit double")
    sign = F.lit(1.0 if increasing else -1.0)
    points = settle(points.withColumn("y", sign * F.col("y")))
    enough = points.groupBy("g").agg(F.sum("n").alias("rows")).where(F.col("rows") >= MIN_FIT).select("g")
    return fitted(points.join(enough, "g", "left_semi")).withColumn("fit", sign * F.col("fit"))


def order_cells(rows: Weighted, s: OrderSpec) -> DataFrame:
    """(ctx, xt, yt, n, x, y, fit, resid, scale, score) of each value combination.

    score = |y - fit| / (median |y - fit| of the context + 1e-9); 0 where no trend was fitted.
    """
    ctx = F.col(f"`{s.context}`") if s.context else F.lit("")
    cells, total = settle_measured(
        rows.df.select(ctx.alias("ctx"), F.col(f"`{s.x}`").alias("xt"), F.col(f"`{s.y}`").alias("yt"),
                       F.col(rows.weight).alias("w"))
        .groupBy("ctx", "xt", "yt").agg(F.sum("w").alias("n"))
        .select("ctx", "xt", "yt", "n", F.col("ctx").alias("g"),
                finite(as_number(F.col("xt"))).alias("x"), finite(as_number(F.col("yt"))).alias("y")),
        rows=F.count(F.lit(1)))
    bounded = total["rows"] <= SMALL_POINTS
    fits = trend(cells, s.increasing, bounded)
    joined = settle(cells.join(fits, ["g", "x"], "left")
                    .withColumn("resid", F.round(F.abs(F.col("y") - F.col("fit")), NOISE)))
    med = weighted_median(joined.where("resid is not null"), ["g"], "resid", "n", small=bounded, out="med")
    return (joined.join(med, "g", "left").withColumn("scale", F.col("med") + F.lit(1e-9))
            .withColumn("score", F.coalesce(F.col("resid") / F.col("scale"), F.lit(0.0))).drop("g", "med"))
