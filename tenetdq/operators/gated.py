"""Conditional model: predict each column from the others, sparsely, and score the surprise.

Distributed re-expression with ``pyspark.ml``: one L1-penalized multinomial regression per
target over one-hot sources. Training uses all rows (folded to weighted tuples when their
combinations are few), not a sample.
"""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tenetdq.operators.fd import mine
from tenetdq.plans.constraints import FunctionalDependency
from tenetdq.plans.frame import ROW_ID, Frame
from tenetdq.session import scratch_path


@dataclass
class GatedLearner:
    """score = 1 - P(value | other columns); the gate of a source is the norm of its weights."""
    l1: float = 0.001
    max_iter: int = 25
    tau: float = 0.90
    lift: float = 0.10
    max_lhs: int = 3
    value_cap: int = 300       # columns with more distinct values are neither targets nor sources
    cols: list[str] = field(default_factory=list)
    gates: dict[str, dict[str, float]] = field(default_factory=dict)
    rules_: list[FunctionalDependency] = field(default_factory=list)
    _models: dict = field(default_factory=dict, repr=False)

    def fit(self, frame: Frame) -> "GatedLearner":
        prof = frame.profile
        self.cols = [c for c in prof.modeling() if prof.cards[c] <= self.value_cap]
        self.gates, self._models, self.rules_ = {}, {}, []
        if len(self.cols) < 2:
            return self
        rows = frame.weighted(self.cols)
        self._index = StringIndexer(inputCols=self.cols, outputCols=[f"i_{c}" for c in self.cols],
                                    stringOrderType="frequencyDesc", handleInvalid="keep").fit(rows.df)
        indexed = self._index.transform(rows.df)
        self._encode = OneHotEncoder(inputCols=[f"i_{c}" for c in self.cols],
                                     outputCols=[f"x_{c}" for c in self.cols],
                                     dropLast=False, handleInvalid="keep").fit(indexed)
        # one layout with every column; a target's own block is left out of its features
        data = self._encode.transform(indexed)
        sizes = dict(zip(self.cols, self._encode.categorySizes))
        for target in self.cols:
            sources = [c for c in self.cols if c != target]
            asm = VectorAssembler(inputCols=[f"x_{c}" for c in sources], outputCol="features")
            lr = LogisticRegression(featuresCol="features", labelCol=f"i_{target}", weightCol=rows.weight,
                                    family="multinomial", elasticNetParam=1.0, regParam=self.l1,
                                    maxIter=self.max_iter, standardization=False,
                                    probabilityCol=f"p_{target}", rawPredictionCol=f"raw_{target}",
                                    predictionCol=f"pred_{target}")
            # a fitted model holds its training summary and with it the session; a loaded one does not
            path = scratch_path(frame.df.sparkSession, f"gated-{len(self._models)}")
            lr.fit(asm.transform(data)).save(path)
            model = LogisticRegressionModel.load(path)
            weights, at, gate = model.coefficientMatrix.toArray(), 0, {}
            for c in sources:
                width = int(sizes[c]) + 1
                gate[c] = float(np.linalg.norm(weights[:, at:at + width]))
                at += width
            self.gates[target] = gate
            self._models[target] = (asm, model)
        order = {t: sorted(g, key=lambda c: -g[c]) for t, g in self.gates.items()}
        self.rules_ = mine(frame, self.tau, self.lift, self.max_lhs, order=order)
        return self

    @property
    def governed(self) -> set[str]:
        return {fd.rhs for fd in self.rules_}

    def rules(self) -> list[FunctionalDependency]:
        return list(self.rules_)

    def score(self, frame: Frame) -> DataFrame:
        """Wide scores of all modeling columns, others 0; a narrow pass over the rows."""
        if not self._models:
            return frame.df.select(ROW_ID, *[F.lit(0.0).alias(c) for c in frame.columns])
        data = self._encode.transform(self._index.transform(frame.df))
        for target, (asm, model) in self._models.items():
            data = model.transform(asm.transform(data)).drop("features")
        def surprise(c):
            probs, label = vector_to_array(F.col(f"p_{c}")), F.col(f"i_{c}").cast("int")
            return F.lit(1.0) - F.coalesce(F.get(probs, label), F.lit(0.0))
        return data.select(ROW_ID, *[(surprise(c) if c in self._models else F.lit(0.0)).alias(c)
                                     for c in frame.columns])
