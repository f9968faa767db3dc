"""A table under analysis: its value view, row identity and column profile."""
from __future__ import annotations

from dataclasses import dataclass, field
from typing import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from tenetdq.functions.counting import Weighted, fold_pays, value_counts
from tenetdq.functions.values import as_number, as_text, num_name, number_of, value_view
from tenetdq.session import settle, settle_table

ROW_ID = "row_id"

# types whose text form is one to one, so equal values can be folded before they become text
_EXACT = (T.IntegralType, T.FractionalType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass
class Frame:
    """``df`` holds ``row_id`` plus one normalized string column per entry of ``columns``;
    ``raw`` the same rows and names with their source types."""
    df: DataFrame
    columns: list[str]
    id_cardinality: int = 300
    raw: DataFrame | None = field(default=None, repr=False)
    _profile: object = field(default=None, repr=False)
    _folded: Weighted | None = field(default=None, repr=False)
    _counts: DataFrame | None = field(default=None, repr=False)     # value histogram of wide tables

    @property
    def spark(self):
        return self.df.sparkSession

    @property
    def profile(self):
        """Column profile, computed on first use (see ``operators.profile``)."""
        if self._profile is None:
            from tenetdq.operators.profile import profile_columns
            self._profile = profile_columns(self)
        return self._profile

    def with_df(self, df: DataFrame) -> "Frame":
        """Same columns and profile over other rows (a new batch, a repaired table)."""
        return Frame(df, self.columns, self.id_cardinality, None, self._profile)

    @property
    def source(self) -> DataFrame:
        return self.raw if self.raw is not None else self.df

    def fold(self, columns: Sequence[str], cards: Sequence[int], n: int) -> Weighted | None:
        """Distinct tuples of ``columns`` with their multiplicities, if that pays; kept, so
        later statistics of these columns read them instead of the rows."""
        columns = list(columns)
        if self._folded is None and columns and fold_pays(cards, n):
            types = {f.name: f.dataType for f in self.source.schema.fields}
            keys = [F.col(f"`{c}`") if isinstance(types[c], _EXACT) else as_text(F.col(f"`{c}`"), types[c]).alias(c)
                    for c in columns]
            tuples = self.source.groupBy(*keys).agg(F.count("*").alias("n"))
            plain = {f.name: f.dataType for f in tuples.schema.fields}
            self._folded = Weighted(settle(tuples.select(
                *[as_text(F.col(f"`{c}`"), plain[c]).alias(c) for c in columns], "n")))
        return self._folded

    def known_values(self, columns: Sequence[str], limit: int = 32 * 1024 * 1024) -> dict[str, list[str]] | None:
        """The distinct values of ``columns``, if the profile kept a histogram and their total size stays within ``limit``
        bytes. Columns beyond the identifier bound, which that histogram leaves out, are counted here."""
        if self._counts is None:
            return None
        kept = {r["column"] for r in self._counts.select("column").distinct().collect()}
        mine = self._counts.where(F.col("column").isin(list(columns)))
        left = [c for c in columns if c not in kept]
        if left:
            if sum(self.profile.by_column[c].distinct for c in left) * 8 > 1.2 * limit:    # sketches err by 5 %
                return None
            mine = settle(mine.unionByName(value_counts(self.df, left)))
        if (mine.agg(F.sum(F.octet_length("value") + 8)).first()[0] or 0) > limit:
            return None
        out: dict[str, list[str]] = {c: [] for c in columns}
        for r in mine.select("column", "value").collect():
            out[r["column"]].append(r["value"])
        return out

    def numeric_rows(self, columns: Sequence[str]) -> DataFrame:
        """``df`` plus the numbers of ``columns`` (see ``values.number_in``), taken from the
        source types so that typed numbers are not written as text and read back."""
        columns = sorted(set(columns))
        if self.raw is None:
            return self.df.select("*", *[as_number(F.col(f"`{c}`")).alias(num_name(c)) for c in columns])
        types = {f.name: f.dataType for f in self.raw.schema.fields}
        return self.raw.select(
            ROW_ID, *[as_text(F.col(f"`{c}`"), types[c]).alias(c) for c in self.columns],
            *[number_of(F.col(f"`{c}`"), types[c]).alias(num_name(c)) for c in columns])

    def is_folded(self, columns: Sequence[str]) -> bool:
        return self._folded is not None and set(columns) <= set(self._folded.df.columns)

    def weighted(self, columns: Sequence[str]) -> Weighted:
        """``columns`` with a weight: folded tuples where they cover the columns, else the rows."""
        columns = list(columns)
        if self.is_folded(columns):
            return Weighted(self._folded.df.select(*[f"`{c}`" for c in columns], "n"))
        return Weighted(self.df.select(*[f"`{c}`" for c in columns], F.lit(1).cast("long").alias("n")))


def from_df(df: DataFrame, row_id: str | None = None, columns: list[str] | None = None,
            id_cardinality: int = 300) -> Frame:
    """Normalize ``df``. ``row_id`` names a unique column; without one, ids that follow the
    input order are assigned once and written as Parquet to the checkpoint folder, because they would
    change if the plan were evaluated twice."""
    if row_id is None:
        df = settle_table(df.withColumn(ROW_ID, F.monotonically_increasing_id()))
        row_id = ROW_ID
    columns = columns if columns is not None else [c for c in df.columns if c != row_id]
    view = value_view(df, columns, keep=row_id)
    if row_id != ROW_ID:
        view = view.withColumnRenamed(row_id, ROW_ID)
    raw = df.select(F.col(f"`{row_id}`").alias(ROW_ID), *[f"`{c}`" for c in columns])
    return Frame(view, columns, id_cardinality, raw)
