"""Learners with a common interface, their routing, and rank ensembles.

A learner has ``fit(frame)``, ``score(frame)`` (row_id plus one score per column), ``rules()``
and ``governed`` (the columns it scores). Learners that can also score value combinations
offer ``cells(frame, column)``, which lets the router rank without touching rows.
"""
from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tenetdq.functions.running import rank_columns
from tenetdq.operators.fd import Confidences, FdCells, count_cells, mine, single_source_confidences
from tenetdq.operators.linear import LinearLearner
from tenetdq.operators.marginal import MarginalSurprise
from tenetdq.operators.order import OrderLearner
from tenetdq.operators.ranking import Cells, attach_cell_ranks
from tenetdq.operators.scoring import fd_cell_scores
from tenetdq.plans.constraints import Constraint, FunctionalDependency
from tenetdq.plans.frame import ROW_ID, Frame


@dataclass
class FdLearner:
    """Functional dependencies by majority vote; composite up to ``max_lhs`` attributes."""
    tau: float = 0.90
    lift: float = 0.10
    max_lhs: int = 2
    rules_: list[FunctionalDependency] = field(default_factory=list)
    conf: Confidences | None = field(default=None, repr=False)
    _cells: FdCells | None = field(default=None, repr=False)
    _cells_of: DataFrame | None = field(default=None, repr=False)

    def fit(self, frame: Frame) -> "FdLearner":
        self.conf = single_source_confidences(frame)
        self.rules_ = mine(frame, self.tau, self.lift, self.max_lhs, conf=self.conf)
        return self

    @property
    def governed(self) -> set[str]:
        return {fd.rhs for fd in self.rules_}

    def rules(self) -> list[FunctionalDependency]:
        return list(self.rules_)

    def statistics(self, frame: Frame) -> FdCells:
        """Joint counts of the learned rules over ``frame``, counted once per table."""
        if self._cells is None or self._cells_of is not frame.df:
            self._cells, self._cells_of = count_cells(frame, self.rules_), frame.df
        return self._cells

    def cells(self, frame: Frame, column: str) -> Cells:
        stats = self.statistics(frame)
        i = next(k for k, fd in enumerate(self.rules_) if fd.rhs == column)
        fd = self.rules_[i]
        table = stats.table(i, F.col("violation").alias("score"), "n")
        return Cells([*fd.lhs, fd.rhs], table, stats.small[i], stats.rows[i])

    def score(self, frame: Frame) -> DataFrame:
        if not self.rules_:
            return frame.df.select(ROW_ID, *[F.lit(0.0).alias(c) for c in frame.columns])
        return fd_cell_scores(frame, self.rules_, self.statistics(frame))


@dataclass
class RoutedLearner:
    """The first learner that governs a column scores it; the marginal detector does the rest."""
    learners: list | None = None
    marginal: MarginalSurprise = field(default_factory=MarginalSurprise)
    owner: dict[str, object] = field(default_factory=dict)

    def fit(self, frame: Frame) -> "RoutedLearner":
        if self.learners is None:
            self.learners = [FdLearner(max_lhs=2), OrderLearner(), LinearLearner()]
        conf = None
        for learner in self.learners:
            if isinstance(learner, OrderLearner):
                learner.fit(frame, conf)
            else:
                learner.fit(frame)
            conf = getattr(learner, "conf", None) or conf
        self.marginal.fit(frame)
        self.owner = {}
        for learner in self.learners:
            for c in frame.columns:
                if c in learner.governed:
                    self.owner.setdefault(c, learner)
        return self

    @property
    def governed(self) -> set[str]:
        return set(self.owner)

    def rules(self) -> list[Constraint]:
        return [r for learner in self.learners or [] for r in learner.rules()]

    def score(self, frame: Frame) -> DataFrame:
        """Ranked scores in [0, 1]; a column on which its owner sees no difference scores 0."""
        linear = {c for o in self.owner.values() if isinstance(o, LinearLearner) for c in o.cols}
        rows = frame.numeric_rows(linear) if linear else frame.df
        at = {c: f"__r{j}" for j, c in enumerate(frame.columns)}
        for learner in self.learners or []:
            owned = {c: at[c] for c, o in self.owner.items() if o is learner}
            if owned:
                rows = attach_ranks(frame, rows, learner, owned)
        free = [c for c in frame.columns if c not in self.owner]
        rows = self.marginal.attach_scores(frame, rows, free, "__m_")
        return rows.select(ROW_ID, *[
            (F.col(f"`__m_{c}`") if c in free else F.col(at[c])).alias(c) for c in frame.columns])


def attach_ranks(frame: Frame, rows: DataFrame, learner, at: dict[str, str]) -> DataFrame:
    """``rows`` plus, per column of ``at``, the average rank / n of the learner's score under
    the given name (0 where the learner sees no difference).

    Value-based learners are ranked on their cells and looked up, so rows stay in place; only
    foreign learners without cells are joined by row id.
    """
    none = [c for c in at if c not in learner.governed]
    some = [c for c in at if c in learner.governed]
    if isinstance(learner, LinearLearner) and some:
        rows = learner.attach_rank(frame, rows, "__lin", constant_to_zero=True)
        rows = rows.withColumns({at[c]: F.col("__lin") for c in some}).drop("__lin")
    elif hasattr(learner, "cells"):
        for c in some:
            rows = attach_cell_ranks(rows, learner.cells(frame, c), at[c])
    elif not isinstance(learner, LinearLearner):
        some, none = list(at), []
        ranked = rank_columns(learner.score(frame).select(ROW_ID, *[f"`{c}`" for c in some]), some)
        rows = rows.join(ranked.select(ROW_ID, *[F.col(f"`{c}`").alias(at[c]) for c in some]), ROW_ID)
    return rows.withColumns({at[c]: F.lit(0.0) for c in none}) if none else rows


@dataclass
class EnsembleLearner:
    """Mean of the per-column ranks of several learners; best-confidence rule per target."""
    models: list = field(default_factory=list)

    def __post_init__(self):
        if not self.models:
            raise ValueError("an ensemble needs at least one model")

    def fit(self, frame: Frame) -> "EnsembleLearner":
        for m in self.models:
            m.fit(frame)
        return self

    def rules(self) -> list[Constraint]:
        """Per FD target the rule with the highest confidence (first model on ties); rules
        without a target are passed through."""
        best: dict[str, Constraint] = {}
        others: list[Constraint] = []
        for m in self.models:
            for r in m.rules():
                if not isinstance(r, FunctionalDependency):
                    others.append(r)
                elif r.rhs not in best or r.confidence > best[r.rhs].confidence:
                    best[r.rhs] = r
        return [*best.values(), *others]

    @property
    def governed(self) -> set[str]:
        return {c for m in self.models for c in m.governed}

    def score(self, frame: Frame) -> DataFrame:
        """Mean over the models of the per-column rank, in one wide pass over the table."""
        rows, n = frame.df, float(len(self.models))
        for k, m in enumerate(self.models):
            rows = attach_ranks(frame, rows, m, {c: f"__{k}_{j}" for j, c in enumerate(frame.columns)})
        return rows.select(ROW_ID, *[
            (reduce(lambda a, b: a + b, [F.col(f"__{k}_{j}") for k in range(len(self.models))])
             / F.lit(n)).alias(c) for j, c in enumerate(frame.columns)])
