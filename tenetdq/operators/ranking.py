"""Turning scores of value combinations into ranked scores of rows."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tenetdq.functions.lookup import attach, settle_sized
from tenetdq.functions.running import SMALL_HISTOGRAM, average_rank, small_rank
from tenetdq.plans.frame import ROW_ID, Frame
from tenetdq.session import settle


@dataclass
class Cells:
    """Scores of value combinations: ``df`` holds ``keys`` (columns of the table), ``score``
    and ``n`` (rows of the combination). ``small``/``rows`` where they were measured."""
    keys: list[str]
    df: DataFrame
    small: bool | None = None
    rows: int | None = None

    def measured(self) -> "Cells":
        if self.rows is not None:
            return self
        df, small, rows = settle_sized(self.df.select(*[f"`{k}`" for k in self.keys], "score", "n"))
        return Cells(self.keys, df, small, rows)


def attach_cell_ranks(rows: DataFrame, cells: Cells, out: str, constant_to_zero: bool = True) -> DataFrame:
    """``rows`` plus ``out``: the average rank of the score of their value combination.

    Ranking the cells by weight replaces ranking the rows, which are never sorted.
    """
    cells = cells.measured()
    keys = [f"`{k}`" for k in cells.keys]
    if cells.rows <= SMALL_HISTOGRAM:
        ranked = small_rank(cells.df, [], "score", "n", constant_to_zero, out=out).select(*keys, out, "n")
    else:
        ranks = average_rank(cells.df, [], "score", "n", constant_to_zero, out=out).drop("n")
        ranked = settle(cells.df.join(ranks, "score").select(*keys, out, "n"))
    return attach(rows, ranked, cells.keys, weight="n", small=cells.small).drop("n")


def score_by_cells(frame: Frame, cells: dict[str, Cells], constant_to_zero: bool = True) -> DataFrame:
    """Wide rank scores: every column of ``cells`` by lookup, all others 0."""
    rows = frame.df
    for i, table in enumerate(cells.values()):
        rows = attach_cell_ranks(rows, table, f"__s{i}", constant_to_zero)
    at = {c: i for i, c in enumerate(cells)}
    return rows.select(ROW_ID, *[(F.col(f"__s{at[c]}") if c in at else F.lit(0.0)).alias(c)
                                 for c in frame.columns])
