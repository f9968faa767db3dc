"""Whole-table scoring with FD and linear rules, explanations and summaries."""
from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tenetdq.functions.lookup import attach, settle_sized
from tenetdq.functions.values import number_in, round_even
from tenetdq.operators.fd import FdCells, count_cells
from tenetdq.plans.constraints import Constraint, FunctionalDependency, LinearConstraint
from tenetdq.plans.frame import ROW_ID, Frame

FLAG_AT = 0.5          # a row is flagged from this score on
CELL_ABOVE = 0.7       # a cell is anomalous above this score; a row is clean up to it


def split(rules: Sequence[Constraint]):
    """(dependencies, linear constraints, order constraints) in learning order."""
    fds = [r for r in rules if isinstance(r, FunctionalDependency)]
    linear = [r for r in rules if isinstance(r, LinearConstraint)]
    order = [r for r in rules if not isinstance(r, (FunctionalDependency, LinearConstraint))]
    return fds, linear, order


def residual(rule: LinearConstraint, rows: DataFrame, missing_as_zero: bool = False) -> Column:
    """sum(coefficient * column) - offset over ``rows``; null where a value is no number,
    unless ``missing_as_zero``."""
    terms = []
    for c, v in rule.coefficients:
        x = number_in(rows, c)
        terms.append(F.lit(v) * (F.coalesce(x, F.lit(0.0)) if missing_as_zero else x))
    return reduce(lambda a, b: a + b, terms) - F.lit(float(rule.offset))


def with_violations(rows: DataFrame, cells: FdCells, prefix: str = "__v") -> DataFrame:
    """One violation column per dependency. Only cells of inconsistent groups are looked up;
    every other row scores 0 without being in the table."""
    for i, fd in enumerate(cells.fds):
        table = cells.table(i, F.col("violation").alias(f"{prefix}{i}"), F.col("n").alias("__n"),
                            condition=F.col("violation") > 0)
        rows = attach(rows, table, [*fd.lhs, fd.rhs], weight="__n", small=cells.small.get(i, True)).drop("__n")
        rows = rows.withColumn(f"{prefix}{i}", F.coalesce(f"{prefix}{i}", F.lit(0.0)))
    return rows


def fd_cell_scores(frame: Frame, fds: Sequence[FunctionalDependency],
                   cells: FdCells | None = None) -> DataFrame:
    """Wide scores: per governed column the largest violation among its rules, else 0."""
    cells = cells or count_cells(frame, fds)
    rows = with_violations(frame.df, cells)
    out = []
    for c in frame.columns:
        mine = [F.col(f"__v{i}") for i, fd in enumerate(cells.fds) if fd.rhs == c]
        score = F.greatest(*mine) if len(mine) > 1 else mine[0] if mine else F.lit(0.0)
        out.append(score.alias(c))
    return rows.select(ROW_ID, *out)


def greatest_of(columns: Sequence[Column]) -> Column:
    return F.greatest(*columns) if len(columns) > 1 else columns[0]


def tuple_scores(scores: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row score: the largest cell score."""
    return scores.select(ROW_ID, greatest_of([F.col(f"`{c}`") for c in columns]).alias("score"))


def score_rows(frame: Frame, rules: Sequence[Constraint]) -> DataFrame:
    """``frame`` plus ``score`` and the ``rule`` that first reached it.

    Dependencies score 1 - count(cell)/count(group), counted on ``frame`` itself; rows are scored against
    statistics of another table by ``streaming.stream.score_stream``, static frames included. A broken linear
    rule scores 1 (text that is no number counts as 0 here). Order constraints take no part.
    """
    fds, linear, _ = split(rules)
    rows = frame.numeric_rows({c for r in linear for c in r.attributes}) if linear else frame.df
    names, parts = [], []
    if fds:
        rows = with_violations(rows, count_cells(frame, fds))
        parts += [F.col(f"__v{i}") for i in range(len(fds))]
        names += [str(fd) for fd in fds]
    for r in linear:
        parts.append((F.abs(residual(r, rows, missing_as_zero=True)) > r.tolerance).cast("double"))
        names.append(str(r))
    if not parts:
        return rows.withColumns({"score": F.lit(0.0), "rule": F.lit("")})
    rows = rows.withColumn("score", greatest_of(parts))
    picked = F.lit("")
    for part, name in reversed(list(zip(parts, names))):
        picked = F.when(part == F.col("score"), name).otherwise(picked)
    rows = rows.withColumn("rule", F.when(F.col("score") > 0, picked).otherwise(F.lit("")))
    return rows.select(ROW_ID, *frame.columns, "score", "rule")


def summarize(scored: DataFrame, threshold: float = FLAG_AT) -> DataFrame:
    return scored.agg(
        F.count("*").alias("rows"),
        F.sum((F.col("score") >= threshold).cast("long")).alias("flagged"),
        F.lit(float(threshold)).alias("threshold"), F.max("score").alias("max_score"))


def top_rows(scored: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` worst rows with a positive score; equal scores by row id."""
    return (scored.where("score > 0").orderBy(F.desc("score"), ROW_ID).limit(k)
            .select(ROW_ID, round_even(F.col("score"), 4).alias("score"), "rule"))


def long_scores(scores: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(row_id, column, score)."""
    return scores.unpivot([ROW_ID], [f"`{c}`" for c in columns], "column", "score")


def explain(frame: Frame, scores: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most violating cells with their values; ties by row id, then column.

    Values are attached to the k winners only, so no cell values are shuffled.
    """
    cols = frame.columns
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("score"))
                                for c in cols]))
    top = (scores.select(ROW_ID, cells.alias("c")).select(ROW_ID, "c.*")
           .orderBy(F.desc("score"), ROW_ID, "column").limit(k))
    value = reduce(lambda acc, c: F.when(F.col("column") == c, F.col(f"`{c}`")).otherwise(acc),
                   cols, F.lit(None).cast("string"))
    return (frame.df.join(F.broadcast(top), ROW_ID)
            .select(ROW_ID, "column", value.alias("value"), "score")
            .orderBy(F.desc("score"), ROW_ID, "column"))


def governed_columns(rules: Sequence[Constraint]) -> list[str]:
    return sorted({a for r in rules for a in r.attributes})


def annotate(cells: DataFrame, rules: Sequence[Constraint]) -> DataFrame:
    """Adds the reason: a broken rule if any rule mentions the column, else a rare value."""
    governed = governed_columns(rules)
    return cells.withColumn("reason", F.when(
        F.col("column").isin(governed), "violates a constraint"
    ).otherwise("rare value (no governing constraint)"))


def heat_counts(scores: DataFrame, columns: Sequence[str], above: float = CELL_ABOVE) -> DataFrame:
    """Per column and in total: anomalous cells, and rows with at least one of them."""
    hit = {c: (F.col(f"`{c}`") > above) for c in columns}
    any_hit = reduce(lambda a, b: a | b, hit.values())
    wide = scores.agg(*[F.sum(h.cast("long")).alias(c) for c, h in hit.items()],
                      F.sum(any_hit.cast("long")).alias("__rows"))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("cells"))
                      for c in columns],
                    F.struct(F.lit("(all)").alias("column"),
                             reduce(lambda a, b: a + b, [F.col(f"`{c}`") for c in columns]).alias("cells")))
    return wide.select(F.explode(cells).alias("x"), "__rows").select(
        "x.*", F.col("__rows").alias("rows"))


def clean_rows(frame: Frame, scores: DataFrame | None, threshold: float = CELL_ABOVE) -> DataFrame:
    """Rows whose largest cell score stays within ``threshold``; all rows without scores."""
    if scores is None:
        return frame.df
    flagged, small, _ = settle_sized(
        tuple_scores(scores, frame.columns).where(F.col("score") > threshold).select(ROW_ID))
    return attach(frame.df, flagged, [ROW_ID], how="left_anti", small=small)
