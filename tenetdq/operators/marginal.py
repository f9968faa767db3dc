"""Marginal surprise: how unusual a value is under the law of its own column."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tenetdq.functions.counting import value_counts
from tenetdq.functions.lookup import attach, attach_cells, row_width, settle_sized, within_broadcast
from tenetdq.functions.running import SMALL_HISTOGRAM, average_rank, small_rank, weighted_median
from tenetdq.functions.values import as_number, finite
from tenetdq.operators.profile import NUMERIC
from tenetdq.plans.frame import ROW_ID, Frame
from tenetdq.session import settle, settle_measured

RARITY, LENGTH, DIGITS, NUMBER = "rarity", "length", "digits", "number"
NAN = float("nan")


def _length() -> Column:
    return F.length("value").cast("double")


def _digits() -> Column:
    return F.regexp_count(F.col("value"), F.lit(r"(?U)\d")) / (F.length("value") + 1)


def _number() -> Column:
    return F.coalesce(finite(as_number(F.col("value"))), F.lit(NAN))


def robust_scores(hist: DataFrame, small: bool) -> DataFrame:
    """``hist`` (column, metric, v, n) plus ``z``.

    z = |v - median| / (MAD + 1e-9) of the metric; rarity is used as it is. Missing numbers
    (NaN) take the median, so their z is 0 while they still count towards the MAD.
    """
    given = hist.where((F.col("metric") != RARITY) & ~F.isnan("v"))
    med = weighted_median(given, ["column", "metric"], "v", "n", small, out="med")
    dev = hist.join(F.broadcast(med), ["column", "metric"], "left").withColumn(
        "dev", F.when(F.isnan("v") | F.col("med").isNull(), 0.0).otherwise(F.abs(F.col("v") - F.col("med"))))
    dev = dev if small else settle(dev)
    mad = weighted_median(dev.where(F.col("metric") != RARITY), ["column", "metric"], "dev", "n",
                          small, out="mad")
    return dev.join(F.broadcast(mad), ["column", "metric"], "left").withColumn(
        "z", F.when(F.col("metric") == RARITY, F.col("v"))
        .otherwise(F.col("dev") / (F.col("mad") + F.lit(1e-9))))


def metric_columns(rows: int) -> dict[str, Column]:
    return {RARITY: F.lit(1.0) - F.col("n") / F.lit(rows), LENGTH: _length(), DIGITS: _digits(),
            NUMBER: _number()}


def marginal_cells(frame: Frame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value, n, surprise) of every distinct value.

    Numbers: rank of the robust z. Text and identifiers: the largest of the ranks of rarity,
    length z and digit-share z. The three measures take few distinct values even where the
    column itself has many, so ranking never sorts the values.
    """
    columns = list(columns) if columns is not None else frame.columns
    kinds, total = frame.profile.kinds, frame.profile.rows
    numeric = [c for c in columns if kinds[c] == NUMERIC]
    w = frame.weighted(columns)
    hist = settle(value_counts(w.df, columns, w.weight))
    is_num = F.col("column").isin(numeric)
    expr = metric_columns(total)
    measured = hist.select("column", "n", F.explode(F.when(
        is_num, F.array(F.struct(F.lit(NUMBER).alias("metric"), expr[NUMBER].alias("v")))
    ).otherwise(F.array(*[F.struct(F.lit(m).alias("metric"), expr[m].alias("v"))
                          for m in (RARITY, LENGTH, DIGITS)]))).alias("m"))
    metrics, can_broadcast, size = settle_sized(
        measured.select("column", "m.metric", "m.v", "n").groupBy("column", "metric", "v").agg(F.sum("n").alias("n")))
    small = size <= SMALL_HISTOGRAM
    scored = robust_scores(metrics, small)
    if small:
        table = small_rank(scored, ["column", "metric"], "z", "n", out="r").select("column", "metric", "v", "r")
    else:
        scored = settle(scored)
        ranks = average_rank(scored, ["column", "metric"], "z", "n", out="r").drop("n")
        table = scored.join(ranks, ["column", "metric", "z"]).select("column", "metric", "v", "r")
    table = settle(table)
    rows = hist
    for m in ([NUMBER] if numeric else []) + ([RARITY, LENGTH, DIGITS] if len(numeric) < len(columns) else []):
        part = table.where(F.col("metric") == m).select("column", F.col("v").alias("__v"), F.col("r").alias(f"__{m}"))
        rows = attach(rows.withColumn("__v", expr[m]), part, ["column", "__v"], small=can_broadcast).drop("__v")
    found = [F.col(c) for c in rows.columns if c.startswith("__")]
    surprise = F.greatest(*found) if len(found) > 1 else found[0]
    if numeric and len(numeric) < len(columns):
        surprise = F.when(is_num, F.col(f"__{NUMBER}")).otherwise(
            F.greatest(*[F.col(f"__{m}") for m in (RARITY, LENGTH, DIGITS)]))
    return rows.select("column", "value", "n", surprise.alias("surprise"))


class MarginalSurprise:
    """Detector for columns that no constraint governs."""
    governed: set[str] = set()

    def fit(self, frame: Frame) -> "MarginalSurprise":
        return self

    def rules(self) -> list:
        return []

    def attach_scores(self, frame: Frame, rows: DataFrame, columns: Sequence[str], prefix: str) -> DataFrame:
        """``rows`` plus ``prefix + column`` for each of ``columns``."""
        if not columns:
            return rows
        cells = marginal_cells(frame, columns)
        width, own = row_width(cells), {c: F.col("column") == c for c in columns}
        cells, seen = settle_measured(cells, **{
            k: v for i, c in enumerate(columns)
            for k, v in ((f"r{i}", F.count(F.when(own[c], 1))), (f"b{i}", F.sum(F.when(own[c], width))))})
        large = [c for i, c in enumerate(columns) if not within_broadcast(seen[f"r{i}"], seen[f"b{i}"])]
        for c in columns:
            if c not in large:
                table = cells.where(F.col("column") == c).select(F.col("value").alias(c), F.col("surprise").alias(f"{prefix}{c}"))
                rows = rows.join(F.broadcast(table), [c], "left")
        if large:                                # identifiers: two shuffles of cells, however many columns
            rows = attach_cells(rows, cells, {c: f"{prefix}{c}" for c in large}, "surprise")
        return rows

    def score(self, frame: Frame) -> DataFrame:
        rows = self.attach_scores(frame, frame.df, frame.columns, "__m_")
        return rows.select(ROW_ID, *[F.col(f"`__m_{c}`").alias(c) for c in frame.columns])
