"""Readers: every source becomes a DataFrame whose columns keep their input order."""
from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from tenetdq.functions.lookup import attach, settle_sized
from tenetdq.functions.running import running

# Texts that count as missing in delimited files.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

ROWS_PER_FILE = 1 << 40      # row ids of one file start at a multiple of this


def _capped(df: DataFrame, nrows: int | None, sample: float | None = None, seed: int = 0) -> DataFrame:
    """A prefix (``nrows``) or a random share (``sample``) on request; everything by default."""
    if sample is not None:
        df = df.sample(fraction=sample, seed=seed)
    return df if nrows is None else df.limit(nrows)


def read_csv(spark: SparkSession, path: str, sep: str = ",", nrows: int | None = None,
             multiline: bool = True, sample: float | None = None) -> DataFrame:
    """Delimited text with a header; all columns strings, NA tokens null, no inference pass.

    Line breaks inside quotes are read as text, which takes one task per file; for files known to
    have none, ``multiline=False`` splits them across tasks.
    """
    df = spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=multiline,
                        nullValue="", inferSchema=False)
    df = df.select(*[F.when(~F.col(f"`{c}`").isin(NA_TOKENS), F.col(f"`{c}`")).alias(c) for c in df.columns])
    return _capped(df, nrows, sample)


def read_tsv(spark: SparkSession, path: str, nrows: int | None = None, **kw) -> DataFrame:
    return read_csv(spark, path, sep="\t", nrows=nrows, **kw)


def read_parquet(spark: SparkSession, path: str, nrows: int | None = None,
                 sample: float | None = None, row_id: str | None = None) -> DataFrame:
    """``row_id`` adds a column that numbers the rows by file and position. It is read from the
    file metadata, so it is stable without writing the table again."""
    df = spark.read.parquet(path)
    if row_id is not None:
        # file names as the scan reports them (no column is read for this), numbered without a list on the driver
        names = df.select(F.col("_metadata.file_path").alias("__file")).distinct().select(
            "__file", F.lit(0).alias("__all"), F.lit(1).cast("long").alias("__one"))
        files, small, _ = settle_sized(running(names, ["__all"], ["__file"], {"__ord": ("sum", "__one")}).select("__file", "__ord"))
        located = df.select("*", F.col("_metadata.file_path").alias("__file"),
                            F.col("_metadata.row_index").alias("__pos"))
        df = attach(located, files, ["__file"], how="inner", small=small).select(
            (F.col("__ord") * F.lit(ROWS_PER_FILE) + F.col("__pos")).alias(row_id), *df.columns)
    return _capped(df, nrows, sample)


def _first_keys(spark: SparkSession, path: str) -> list[str]:
    """Key order of the first record, however many lines it takes.

    Lines are streamed from the front until the first object closes."""
    depth, quoted, escaped, record = 0, False, False, []
    for (line,) in spark.read.text(path).toLocalIterator():
        for c in line + "\n":
            if depth or c == "{":
                record.append(c)
            if quoted:
                quoted, escaped = escaped or c != '"', not escaped and c == "\\"
            elif c == '"':
                quoted = depth > 0
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    try:
                        return list(json.loads("".join(record)))
                    except ValueError:
                        return []
    return []


def read_json(spark: SparkSession, path: str, lines: bool | None = None, nrows: int | None = None,
              sample: float | None = None) -> DataFrame:
    """JSON lines (``.jsonl``/``.ndjson``) or an array of records (``.json``). Scalars stay
    text; columns follow the first record, keys first seen later come after it."""
    if lines is None:
        lines = path.lower().endswith((".jsonl", ".ndjson"))
    df = spark.read.json(path, multiLine=not lines, primitivesAsString=True)
    first = [c for c in _first_keys(spark, path) if c in df.columns]
    df = df.select(*[f"`{c}`" for c in first + [c for c in df.columns if c not in first]])
    return _capped(df, nrows, sample)


def read_query(spark: SparkSession, query: str, nrows: int | None = None,
               tables: dict[str, str] | None = None) -> DataFrame:
    """The result of a Spark SQL query; ``tables`` registers files as views first."""
    for name, path in (tables or {}).items():
        read_any(spark, path).createOrReplaceTempView(name)
    return _capped(spark.sql(query), nrows)


def read_table(spark: SparkSession, url: str, table: str, nrows: int | None = None,
               column: str | None = None, bounds: tuple | None = None, partitions: int = 1,
               **options) -> DataFrame:
    """A database table through Spark's JDBC source, read in ``partitions`` ranges of a numeric
    ``column`` when ``bounds`` are given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column and bounds:
        reader = reader.options(partitionColumn=column, lowerBound=str(bounds[0]),
                                upperBound=str(bounds[1]), numPartitions=str(partitions))
    return _capped(reader.load(), nrows)


_BY_EXTENSION = {
    ".csv": read_csv, ".tsv": read_tsv, ".parquet": read_parquet, ".pq": read_parquet,
    ".json": read_json, ".jsonl": read_json, ".ndjson": read_json,
}


def read_any(spark: SparkSession, path: str, nrows: int | None = None, **kw) -> DataFrame:
    """Dispatch on the file extension (globs included)."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext not in _BY_EXTENSION:
        raise ValueError(f"no reader for {ext!r} (known: {' '.join(_BY_EXTENSION)})")
    return _BY_EXTENSION[ext](spark, path, nrows=nrows, **kw)
