"""Column kinds, cardinalities and base rates."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tenetdq.functions.counting import GRID_COLUMNS, value_counts
from tenetdq.functions.values import as_number
from tenetdq.plans.frame import Frame
from tenetdq.session import settle

CATEGORICAL, NUMERIC, IDENTIFIER = "categorical", "numeric", "identifier"
NUMERIC_SHARE = 0.95


@dataclass(frozen=True)
class ColumnProfile:
    column: str
    distinct: int          # a sketch estimate for columns far above the identifier bound
    numeric_fraction: float | None   # not measured for identifiers
    top: int               # rows holding the most frequent value (0 if not counted)
    kind: str


@dataclass(frozen=True)
class Profile:
    rows: int
    by_column: dict[str, ColumnProfile]
    id_cardinality: int

    @property
    def kinds(self) -> dict[str, str]:
        return {c: p.kind for c, p in self.by_column.items()}

    @property
    def cards(self) -> dict[str, int]:
        return {c: p.distinct for c, p in self.by_column.items()}

    def modeling(self) -> list[str]:
        return [c for c, p in self.by_column.items() if 1 < p.distinct <= self.id_cardinality]

    def numeric(self) -> list[str]:
        return [c for c in self.modeling() if self.by_column[c].kind == NUMERIC]

    def base_rate(self, column: str) -> float:
        return self.by_column[column].top / self.rows if self.rows else 0.0


WIDE = 64      # columns up to which all sketches fit one generated aggregation


def sketch(frame: Frame) -> tuple[int, dict[str, int]]:
    """Rows and approximate cardinalities of the normalized values, from one pass and no shuffle
    of values. Wide tables sketch value hashes grouped by column instead of column by column."""
    cols = frame.columns
    if len(cols) <= WIDE:
        aggs = [F.approx_count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(cols)]
        row = frame.df.agg(F.count("*").alias("rows"), *aggs).first()
        return row["rows"], {c: row[f"d{i}"] for i, c in enumerate(cols)}
    hashes = F.posexplode(F.array(*[F.xxhash64(F.col(f"`{c}`")) for c in cols])).alias("i", "h")
    got = {r["i"]: r for r in frame.df.select(hashes).groupBy("i").agg(
        F.count("*").alias("rows"), F.approx_count_distinct("h").alias("d")).collect()}
    return (got[0]["rows"] if got else 0), {c: got[i]["d"] if got else 0 for i, c in enumerate(cols)}


def value_stats(counts: DataFrame) -> DataFrame:
    """Per column of a value histogram: rows, distinct values, largest count, numeric rows.

    Only the histogram is parsed for numbers, never the rows."""
    return counts.groupBy("column").agg(
        F.sum("n").alias("rows"), F.count("*").alias("distinct"), F.max("n").alias("top"),
        F.sum(F.when(as_number(F.col("value")).isNotNull(), F.col("n")).otherwise(0)).alias("num"))


def profile_columns(frame: Frame) -> Profile:
    """Profile used by the learners.

    Columns whose sketch is more than twice the identifier bound are identifiers beyond doubt
    (the sketch errs by 5 %); only the others are counted exactly, so no identifier is ever
    shuffled. Where the remaining columns have few combinations, they are folded into weighted
    tuples on the way, and mining reads those instead of the table.
    """
    cap = frame.id_cardinality
    rows, approx = sketch(frame)
    near = [c for c in frame.columns if approx[c] <= 2 * cap]
    exact = {}
    if near and rows:
        frame.fold(near, [approx[c] + 1 for c in near], rows)
        w = frame.weighted(near)
        counts = value_counts(w.df, near, w.weight)
        if frame._folded is None and len(near) >= GRID_COLUMNS:
            counts = frame._counts = settle(counts)
        exact = {r["column"]: r for r in value_stats(counts).collect()}
    out = {}
    for c in frame.columns:
        r = exact.get(c)
        if r is None or r["distinct"] > cap:
            out[c] = ColumnProfile(c, r["distinct"] if r else approx[c], None, r["top"] if r else 0,
                                   IDENTIFIER if rows else CATEGORICAL)
        else:
            share = r["num"] / rows
            out[c] = ColumnProfile(c, r["distinct"], share, r["top"],
                                   NUMERIC if share > NUMERIC_SHARE else CATEGORICAL)
    return Profile(rows, out, cap)


def kind_column(distinct, numeric_fraction, cap: int):
    return (F.when(distinct > cap, IDENTIFIER)
            .when(numeric_fraction > NUMERIC_SHARE, NUMERIC).otherwise(CATEGORICAL))


def profile_frame(frame: Frame) -> DataFrame:
    """Exact profile of every column, identifiers included, from one value histogram.

    Per value the histogram is reduced before it is grouped by column, so a column with many
    values never gathers them in one task.
    """
    stats = value_stats(value_counts(frame.df, frame.columns))
    share = F.col("num") / F.col("rows")
    return stats.select(
        "column", "rows", "distinct", share.alias("numeric_fraction"),
        (F.col("top") / F.col("rows")).alias("base_rate"),
        kind_column(F.col("distinct"), share, frame.id_cardinality).alias("kind"),
        ((F.col("distinct") > 1) & (F.col("distinct") <= frame.id_cardinality)).alias("modeling"))


def full_value_counts(frame: Frame) -> DataFrame:
    """(column, value, n) of the columns within the identifier bound."""
    near = [c for c, p in frame.profile.by_column.items() if p.distinct <= frame.id_cardinality]
    w = frame.weighted(near)
    return value_counts(w.df, near, w.weight)


def base_rates(frame: Frame, columns: list[str]) -> DataFrame:
    w = frame.weighted(columns)
    return (value_counts(w.df, columns, w.weight).groupBy("column")
            .agg((F.max("n") / F.sum("n")).alias("base_rate")))


def average_group_size(frame: Frame, column_sets: list[list[str]]) -> DataFrame:
    """(columns, groups, avg_group_size): mean rows per combination of each column set.

    An empty set is one group. Each set is one aggregation by its own columns (map-side
    reduced); nothing is exploded.
    """
    out = None
    for cols in column_sets:
        g = frame.df.groupBy(*[f"`{c}`" for c in cols]).agg(F.count("*").alias("n"))
        row = g.agg(F.lit(", ".join(cols)).alias("columns"), F.count("*").alias("groups"),
                    (F.sum("n") / F.count("*")).alias("avg_group_size"))
        out = row if out is None else out.unionByName(row)
    return out
