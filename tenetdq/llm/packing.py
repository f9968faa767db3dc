"""Best-fit packing of token pieces into sequences, by hierarchical residual packing.

Documents are encoded once and cut into pieces of at most ``capacity`` tokens (the first piece of a
longer document takes the remainder). Pieces are dealt at random, each task packs its pieces best-fit
decreasing and emits bins that are nearly full; underfull bins become items, and groups of eight
tasks merge theirs best-fit again, level by level, until a level no longer joins bins or one group is
left. Tasks read windows of bounded size; a level's result is a table in the shared folder.

Joining whole bins pays only while some are at most half full. The tree therefore ends, its
open bins kept as they are, when a level removes less than :data:`LEAST_GAIN` of them; that
bounds what the last task of the tree may receive and drops nothing.

Defined cases: null text counts as empty (its piece is the end id alone); repeated rows are
packed each on their own; an empty table gives no rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenetdq.llm.common import bounded_batches, crc32, list_column, settled, windows
from tenetdq.llm.tokens import encoder

FAN_IN = 8
WINDOW_ROWS = 400_000
LEAST_GAIN = 0.002
NEARLY_FULL = 1 / 64           # a bin with less free room than this share is closed


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = True) -> DataFrame:
    """Encode whole texts and cut them: doc_id, piece, start, length, ids_crc32, slot (and ids)."""
    bounded_batches(docs.sparkSession)
    end, step = int(end_id).to_bytes(4, "little"), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        enc = encoder(tokenizer)
        for b in batches:
            docid, piece, start, parts = [], [], [], []
            for i, raw in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text").to_pylist()), strict=True):
                raw += end
                at = len(raw) % step or min(step, len(raw))
                edges = [0, *range(at, len(raw) + 1, step)]
                for k, (s, e) in enumerate(zip(edges, edges[1:], strict=False)):
                    docid.append(i)
                    piece.append(k)
                    start.append(s // 4)
                    parts.append(raw[s:e])
            slot = [(part << 40) + seen + k for k in range(len(parts))]
            seen += len(parts)
            cols = [pa.array(docid, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array([len(p) // 4 for p in parts], pa.int64()),
                    pa.array([crc32(p) for p in parts], pa.int64()), pa.array(slot, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "slot"]
            if with_ids:
                cols.append(list_column(parts))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, slot long"
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(cut, schema + (", ids array<int>" if with_ids else ""))


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing. For each item its bin and offset; for each bin its fill."""
    order = sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True)
    where, offset, fill = [0] * len(lengths), [0] * len(lengths), []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]    # bins by free room
    free = 0                                                     # bit r: some bin has room r
    for i in order:
        size = lengths[i]
        fits = free >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                free &= ~(1 << left)
        else:
            left, b = capacity, len(fill)
            fill.append(0)
        where[i], offset[i] = b, fill[b]
        fill[b] += size
        if left > size:
            room[left - size].append(b)
            free |= 1 << (left - size)
    return where, offset, fill


def _pack(level: int, capacity: int):
    closed = capacity - int(capacity * NEARLY_FULL)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        for win in windows(batches, 1 << 28, WINDOW_ROWS) if level == 0 else _whole_bins(batches):
            win = win.sort_by([("bin", "ascending"), ("offset", "ascending")])
            bins = win["bin"].to_numpy()
            first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
            item = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(bins))))
            size = np.add.reduceat(win["length"].to_numpy(), first)
            where, offset, fill = (np.array(x, np.int64) for x in best_fit(size.tolist(), capacity))
            base = (level << 58) + (task << 32) + made
            made += len(fill)
            name = base + where[item]
            place = win["offset"].to_numpy() + offset[item]
            total = fill[where[item]]
            out = win.drop_columns(["bin", "offset", "task", "open"])
            for col, values in (("bin", pa.array(name)), ("offset", pa.array(place)),
                                ("task", pa.array(np.full(len(name), task, np.int64))),
                                ("open", pa.array(total <= closed))):
                out = out.append_column(col, values)
            yield from out.combine_chunks().to_batches(max_chunksize=50_000)

    return pack


def _whole_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Windows of rows sorted by bin that never part a bin."""
    rest: pa.Table | None = None
    for win in windows(batches, 1 << 28, WINDOW_ROWS):
        win = win if rest is None else pa.concat_tables([rest, win])
        last = win["bin"].to_numpy()
        cut = int(np.searchsorted(last, last[-1]))
        rest = win.slice(cut)
        if cut:
            yield win.slice(0, cut).combine_chunks()
    if rest is not None:
        yield rest.combine_chunks()


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to pieces (``length`` of at most ``capacity``, unique ``slot``)."""
    bounded_batches(pieces.sparkSession)
    rows = (pieces.withColumn("bin", F.col("slot")).withColumn("offset", F.lit(0).cast("long"))
            .withColumn("task", F.lit(0).cast("long")).withColumn("open", F.lit(True)))
    own = [f for f in rows.schema.fields if f.name not in ("bin", "offset", "task", "open")]
    schema = T.StructType([*own]).add("bin", "long").add("offset", "long").add("task", "long").add("open", "boolean")
    done: DataFrame | None = None
    rest, level, before = rows.repartition(F.hash("slot")), 0, None
    while True:
        packed = settled(rest.mapInArrow(_pack(level, capacity), schema), f"packed-{level}")
        head = packed.where("offset = 0")
        seen = head.agg(F.count("*").alias("bins"), F.count(F.when(F.col("open"), 1)).alias("open"),
                        F.count_distinct(F.when(F.col("open"), F.col("task"))).alias("tasks")).first()
        stop = seen["tasks"] <= 1 or (before is not None and before - seen["bins"] < LEAST_GAIN * before)
        part = packed if stop else packed.where(~F.col("open"))
        done = part if done is None else done.unionByName(part)
        if stop:
            return done.select(*[f.name for f in own if f.name != "slot"],
                               F.col("bin").alias("sequence_id"), "offset")
        before, level = seen["open"], level + 1
        group = F.floor(F.col("task") / FAN_IN).cast("long")
        rest = packed.where("open").repartition(group).sortWithinPartitions("bin", "offset")
