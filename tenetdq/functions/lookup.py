"""Joining rows with a table of statistics without moving the rows when that is safe."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tenetdq.session import settle, settle_measured

BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 256 * 1024 * 1024
HOT_SHARE = 1_000          # a key is hot when it holds more than 1/HOT_SHARE of the rows


def row_width(table: DataFrame) -> Column:
    """Approximate bytes of a row."""
    width = F.lit(16 * len(table.columns))
    for f in table.schema.fields:
        if f.dataType.typeName() in ("string", "array"):
            width = width + F.coalesce(F.length(F.col(f"`{f.name}`").cast("string")), F.lit(0))
    return width


def within_broadcast(rows: int | None, size: int | None) -> bool:
    return (rows or 0) <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES


def settle_sized(table: DataFrame) -> tuple[DataFrame, bool, int]:
    """The settled table, whether it may be broadcast, and its rows (measured while writing)."""
    settled, m = settle_measured(table, rows=F.count(F.lit(1)), size=F.sum(row_width(table)))
    return settled, within_broadcast(m["rows"], m["size"]), m["rows"]


def fits_broadcast(table: DataFrame) -> bool:
    """Measures a settled table."""
    row = table.agg(F.count("*").alias("rows"), F.sum(row_width(table)).alias("size")).first()
    return within_broadcast(row["rows"], row["size"])


def attach(rows: DataFrame, table: DataFrame, keys: list[str], weight: str | None = None,
           how: str = "left", small: bool | None = None) -> DataFrame:
    """``rows`` joined with the statistics ``table`` (one row per ``keys``).

    ``small`` says whether the table was measured, or is proven, to fit a broadcast; ``None``
    measures it now (it should be settled). A table too large for that is joined by a shuffle.
    Its ``weight`` column (rows per key) then tells the hot keys: at most ``HOT_SHARE`` keys can
    hold more than 1/``HOT_SHARE`` of all rows. Each hot key is split into as many parts as its
    share of the shuffle partitions, so the rows that carry it never meet in one task; the
    table is repeated for those keys only.
    """
    if small is None:
        small = fits_broadcast(table)
    if small:
        return rows.join(F.broadcast(table), keys, how)
    if weight is None:
        return rows.join(table, keys, how)
    total = table.agg(F.sum(weight)).first()[0] or 0
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = F.col(f"`{weight}`") / F.lit(float(max(1, total)))
    hot = F.broadcast(table.where(share * HOT_SHARE > 1).select(
        *[f"`{k}`" for k in keys], F.greatest(F.lit(2), F.ceil(share * parts)).alias("__parts")))
    # the part of a row depends on the row alone, so a retried task sends it to the same place
    spread = F.pmod(F.xxhash64(*[f"`{c}`" for c in rows.columns]), F.col("__parts"))
    split_rows = rows.join(hot, keys, "left").withColumn("__part", F.coalesce(spread, F.lit(0))).drop("__parts")
    split_table = (table.join(hot, keys, "left")
                   .withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)))
                   .drop("__parts"))
    return split_rows.join(split_table, [*keys, "__part"], how).drop("__part")


def attach_cells(rows: DataFrame, table: DataFrame, columns: dict[str, str], found: str, value: str = "value",
                 weight: str = "n") -> DataFrame:
    """``rows`` plus, for each of ``columns`` (column -> name of the output), what ``table`` (column, ``value``, ``found``,
    ``weight``) says of the row's value there; null where it says nothing.

    For tables too large for a broadcast: the cells of all columns meet their statistics in one shuffle, hot values split, and
    go back to their rows in another, whatever the number of columns. ``rows`` are settled first, so that their references hold.
    """
    kind = table.schema[value].dataType
    named = settle(rows.withColumn("__ref", F.monotonically_increasing_id()))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast(kind).alias(value)) for c in columns]))
    each = named.select("__ref", cells.alias("c")).select("__ref", "c.*").where(F.col(value).isNotNull())
    met = attach(each, table.select("column", value, found, weight), ["column", value], weight=weight, how="inner", small=False)
    back = met.groupBy("__ref").agg(*[
        F.max(F.when(F.col("column") == c, F.col(found))).alias(f"__o{i}") for i, c in enumerate(columns)])
    joined = named.join(back, "__ref", "left")
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in columns.values()]
    return joined.select(*kept, *[F.col(f"__o{i}").alias(out) for i, out in enumerate(columns.values())])
