"""Detection quality against a clean version of the table."""
from __future__ import annotations

import logging
from functools import reduce
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tenetdq.functions.running import running
from tenetdq.operators.scoring import greatest_of
from tenetdq.plans.frame import ROW_ID, Frame
from tenetdq.session import settle

LOG = logging.getLogger(__name__)

RESULT_SCHEMA = ("dataset string, n long, d int, error_rate double, cell_auroc double, "
                 "cell_auprc double, tuple_auroc double, tuple_auprc double")


def align(clean: Frame, dirty: Frame) -> tuple[Frame, Frame]:
    """Both tables reduced to their common columns (dirty order) and common row ids."""
    common = [c for c in dirty.columns if c in clean.columns]
    both = lambda a, b: Frame(
        a.df.join(b.df.select(ROW_ID), ROW_ID, "left_semi").select(ROW_ID, *[f"`{c}`" for c in common]),
        common, a.id_cardinality)
    return both(clean, dirty), both(dirty, clean)


def error_mask(dirty: Frame, clean: Frame) -> DataFrame:
    """Wide mask: per cell, whether dirty and clean differ. Row ids must match exactly;
    a row without partner fails the query instead of being dropped."""
    if clean.columns != dirty.columns:
        raise ValueError("clean and dirty tables are not aligned")
    d = dirty.df.select(ROW_ID, F.lit(1).alias("__d"), *[F.col(f"`{c}`").alias(f"d_{c}") for c in dirty.columns])
    c = clean.df.select(ROW_ID, F.lit(1).alias("__c"), *[F.col(f"`{x}`").alias(f"c_{x}") for x in clean.columns])
    both = d.join(c, ROW_ID, "full")
    paired = F.when(F.col("__d").isNull() | F.col("__c").isNull(),
                    F.raise_error(F.lit("clean and dirty tables are not aligned")).cast("boolean")
                    ).otherwise(F.lit(True))
    return both.where(paired).select(ROW_ID, *[
        (~F.col(f"`d_{x}`").eqNullSafe(F.col(f"`c_{x}`"))).alias(x) for x in dirty.columns])


def mask_cells(mask: DataFrame, columns: list[str]) -> DataFrame:
    """(row_id, column, error)."""
    return mask.unpivot([ROW_ID], [f"`{c}`" for c in columns], "column", "error")


def curve_metrics(hist: DataFrame, group: str = "level") -> DataFrame:
    """(group, n, positives, auroc, auprc) from a score histogram (group, score, n, pos).

    AUROC is the rank sum with averaged ties, AUPRC the step-wise average precision; both are
    exact, and both come from one running count over distinct scores. Undefined (null) when a
    class is empty or a score is not finite.
    """
    hist = settle(hist)
    totals = hist.groupBy(group).agg(
        F.sum("n").alias("total"), F.sum("pos").alias("p"),
        F.max((F.isnan("score") | F.col("score").isNull() | (F.abs("score") == float("inf"))).cast("int")).alias("odd"))
    run = running(hist.where(F.col("score").isNotNull()), [group], ["score"],
                  {"bn": ("sum", "n"), "bp": ("sum", "pos")})
    rank = F.col("bn") + (F.col("n") + 1) / 2
    precision = (F.col("p") - F.col("bp")) / (F.col("total") - F.col("bn"))
    p, total = F.col("p").cast("double"), F.col("total").cast("double")
    defined = (F.col("odd") == 0) & (F.col("p") > 0) & (F.col("p") < F.col("total"))
    return (run.join(F.broadcast(totals), group)
            .groupBy(group, "total", "p", "odd")
            .agg(F.sum(F.col("pos") * rank).alias("r"), F.sum(F.col("pos") * precision).alias("a"))
            .select(group, F.col("total").alias("n"), F.col("p").alias("positives"),
                    F.when(defined, (F.col("r") - p * (p + 1) / 2) / (p * (total - p))).alias("auroc"),
                    F.when(defined, F.col("a") / p).alias("auprc")))


def score_histogram(scored: DataFrame, level: str, score: str = "score", label: str = "error") -> DataFrame:
    """(level, score, n, pos) of labelled scores."""
    return (scored.groupBy(F.col(score).cast("double").alias("score"))
            .agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
            .select(F.lit(level).alias("level"), "score", "n", "pos"))


def detection_metrics(mask: DataFrame, scores: DataFrame, columns: list[str]) -> DataFrame:
    """Curve metrics of pooled cells and of rows (any error against the largest score)."""
    both = mask.select(ROW_ID, *[F.col(f"`{c}`").alias(f"e_{c}") for c in columns]).join(
        scores.select(ROW_ID, *[F.col(f"`{c}`").alias(f"s_{c}") for c in columns]), ROW_ID)
    cells = F.array(*[F.struct(F.lit("cell").alias("level"), F.col(f"`s_{c}`").cast("double").alias("score"),
                               F.col(f"`e_{c}`").alias("error")) for c in columns])
    row = F.array(F.struct(
        F.lit("tuple").alias("level"),
        greatest_of([F.col(f"`s_{c}`").cast("double") for c in columns]).alias("score"),
        reduce(lambda a, b: a | b, [F.col(f"`e_{c}`") for c in columns]).alias("error")))
    hist = (both.select(F.explode(F.concat(cells, row)).alias("x")).select("x.*")
            .groupBy("level", "score").agg(F.count("*").alias("n"), F.sum(F.col("error").cast("long")).alias("pos")))
    return curve_metrics(hist)


def evaluate(clean: Frame, dirty: Frame, make_learner: Callable, name: str = "data") -> DataFrame:
    """One row: error rate and AUROC/AUPRC of a learner fitted on the dirty table only."""
    clean, dirty = align(clean, dirty)
    cols = dirty.columns
    scores = make_learner().fit(dirty).score(dirty)
    m = {r["level"]: r for r in detection_metrics(error_mask(dirty, clean), scores, cols).collect()}
    cell, row = m["cell"], m["tuple"]
    return dirty.spark.createDataFrame([(
        name, row["n"], len(cols), cell["positives"] / cell["n"], cell["auroc"], cell["auprc"],
        row["auroc"], row["auprc"])], RESULT_SCHEMA)


def evaluate_all(pairs: dict[str, tuple[Frame, Frame]], make_learner: Callable) -> DataFrame | None:
    """Results of many datasets; one that fails is logged and has a row without figures."""
    rows = []
    for name, (clean, dirty) in pairs.items():
        try:
            rows.append(evaluate(clean, dirty, make_learner, name))
        except Exception as exc:
            LOG.warning("%s failed: %s: %s", name, type(exc).__name__, exc)
            rows.append(SparkSession.active().createDataFrame([(name, *[None] * 7)], RESULT_SCHEMA))
    return reduce(DataFrame.unionByName, rows) if rows else None
