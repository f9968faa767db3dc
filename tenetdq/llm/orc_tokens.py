"""Token ids in ORC: run-length encoded integers, row indexes, Bloom filters on document ids.

Documents are range-partitioned by doc_id before they are encoded, so the texts move once and
each task writes one sorted ORC file while it encodes. ORC's integer run-length encoding packs the
ids; a row index every :data:`STRIDE` rows and a Bloom filter on ``doc_id`` let readers skip
stripes and row groups; stripes are the unit of parallel reads. A row knows its file (``part``)
and the number of ids before it there (``part_start``); ids before a file are summed from the
narrow columns alone, so global places need no pass over the ids.

Defined cases: null text counts as empty and gets the end id only; null identifiers come first;
equal identifiers are ordered by the bytes and then a hash of their text; very long texts are encoded whole, in one row; other
columns of the table are not read; an empty table gives no rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenetdq.llm.common import bounded_batches, crc32, list_column
from tenetdq.llm.tokens import encoder

STRIDE = 1_000                 # rows per row-index entry
STRIPE_BYTES = 16 << 20
PIECES = 500_000               # cache of a worker that does nothing else: 17 % of a corpus' words miss, 150 MB


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode whole texts, append ``end_id`` to each and write them by ascending doc_id."""
    bounded_batches(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        enc = encoder(tokenizer, PIECES)
        for b in batches:
            ids = [x + end for x in enc.encode(b.column("text").to_pylist())]
            counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            starts = before + np.cumsum(counts) - counts
            before += int(counts.sum())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), pa.array(counts),
                 list_column(ids)],
                ["doc_id", "part", "part_start", "n_tokens", "ids"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.octet_length("text")]     # bounds are sampled without hashing texts
    (src.repartitionByRange(*order).sortWithinPartitions(*order, F.xxhash64("text"))
        .mapInArrow(encode, "doc_id long, part int, part_start long, n_tokens long, ids array<int>")
        .write.option("orc.bloom.filter.columns", "doc_id").option("orc.create.index", "true")
        .option("orc.row.index.stride", STRIDE).option("orc.stripe.size", STRIPE_BYTES).orc(path))


def read_ids(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """The files' rows. ``where`` on doc_id is pushed into the scan and prunes stripes."""
    rows = spark.read.schema(
        "doc_id long, part int, part_start long, n_tokens long, ids array<int>").orc(path)
    return rows if where is None else rows.where(where)


def places(spark: SparkSession, path: str) -> DataFrame:
    """Ids before each file: part, before. One row per file, summed from two narrow columns."""
    sizes = read_ids(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("size"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, read back from the files: doc_id, start, n_tokens, ids_crc32."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            offsets = ids.offsets.to_numpy().astype(np.int64)
            ends = (4 * offsets).tolist()
            crc = [crc32(raw[s:e]) for s, e in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("part"), b.column("part_start"), pa.array(np.diff(offsets)),
                 pa.array(crc, pa.int64())], ["doc_id", "part", "part_start", "n_tokens", "ids_crc32"])

    rows = read_ids(spark, path).select("doc_id", "part", "part_start", "ids").mapInArrow(
        digest, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(places(spark, path)), "part").select(      # one row per file
        "doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
