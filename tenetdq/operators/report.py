"""Discovery in one call: rules, keys, normal form, relations and the worst cells."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tenetdq.operators.decompose import Schema
from tenetdq.operators.routed import RoutedLearner
from tenetdq.operators.scoring import annotate, explain
from tenetdq.plans.constraints import Constraint, report_order, rules_frame
from tenetdq.plans.frame import Frame


@dataclass
class Model:
    frame: Frame
    learner: object
    rules: list[Constraint]
    schema: Schema
    scores: DataFrame

    @property
    def constraints(self) -> DataFrame:
        """One row per rule, by arity and confidence."""
        return report_order(rules_frame(self.frame.spark, self.rules))

    @property
    def keys(self) -> DataFrame:
        return self.frame.spark.createDataFrame(
            [(i, sorted(k), self.schema.normal_form) for i, k in enumerate(self.schema.keys)],
            "ord int, key array<string>, normal_form string")

    @property
    def relations(self) -> DataFrame:
        rows = [(form, r.name, sorted(r.attributes), sorted(r.key))
                for form, rels in (("3NF", self.schema.relations_3nf), ("BCNF", self.schema.relations_bcnf))
                for r in rels]
        return self.frame.spark.createDataFrame(
            rows, "form string, name string, attributes array<string>, key array<string>")

    def top_violations(self, k: int = 10) -> DataFrame:
        return annotate(explain(self.frame, self.scores, k), self.rules)


def analyze(frame: Frame, learner=None) -> Model:
    """Fit ``learner`` (default: the routed one) and derive the data model from its rules."""
    learner = learner or RoutedLearner()
    learner.fit(frame)
    rules = learner.rules()
    return Model(frame, learner, rules, Schema(rules, frame.profile.modeling()), learner.score(frame))
