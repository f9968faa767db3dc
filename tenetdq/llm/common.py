"""Helpers of the corpus operators: durable tables, bounded Arrow batches, stable names."""
from __future__ import annotations

import zlib
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenetdq.session import scratch_path

BATCH_ROWS = 1_000             # rows per Arrow batch: 1 000 texts fit a worker, long ones too
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"


_caches: dict[Hashable, object] = {}


def own_cache(name: Hashable, make: Callable[[], object] = dict):
    """What an operator keeps in a Python worker from task to task. Workers are reused by all stages of an application, so one that
    comes to another operator gives up what the one before kept: it holds one such cache at a time, not the sum of them."""
    kept = _caches.get(name)
    if kept is None:
        _caches.clear()
        pa.default_memory_pool().release_unused()
        kept = _caches[name] = make()
    return kept


def settled(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and go on from the files."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold at most :data:`BATCH_ROWS` rows, whatever the texts' length."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def windows(batches: Iterator[pa.RecordBatch], most_bytes: int, most_rows: int) -> Iterator[pa.Table]:
    """Consecutive batches gathered up to a size."""
    held, size, rows = [], 0, 0
    for b in batches:
        held.append(b)
        size, rows = size + b.nbytes, rows + b.num_rows
        if size >= most_bytes or rows >= most_rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size, rows = [], 0, 0
            pa.default_memory_pool().release_unused()        # else the worker keeps what its largest windows took
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def list_column(parts: list[bytes]) -> pa.ListArray:
    """Little-endian 32-bit ids, one ``bytes`` per row, as a list column without copies per id."""
    offsets = [0]
    for p in parts:
        offsets.append(offsets[-1] + len(p) // 4)
    joined = b"".join(parts)
    values = pa.Array.from_buffers(pa.int32(), len(joined) // 4, [None, pa.py_buffer(joined)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def crc32(ids: bytes | memoryview) -> int:
    return zlib.crc32(ids)


def wrapped(docs: DataFrame) -> DataFrame:
    """All columns in one struct ``row``, so that no column name clashes with the operator's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def placed(docs: DataFrame) -> DataFrame:
    """The rows as a struct ``row``, with ``file`` and ``at``: a place that stays the same in every scan, so that rows can be
    named now and fetched later without keeping a copy. A plain Parquet table has such places; anything else is written first."""
    if docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation" and "_metadata" not in docs.columns:
        try:
            return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                               F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
        except AnalysisException:                            # a source without row places
            pass
    kept = settled(wrapped(docs), "placed")
    return kept.select("row", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
